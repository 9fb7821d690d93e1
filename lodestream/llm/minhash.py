"""Near-duplicates by circulant MinHash, banding, and exact checks on full shingle sets.

Two permutations are drawn. The first places each shingle on a circle; the second,
shifted by k places, gives coordinate k. Signatures are cut into bands; texts that
share a band are candidates, and every link is confirmed on full sets.

No group is expanded into all its pairs:

1. texts with equal sets become one node, so copies cost nothing more;
2. in each band, every node is compared with one leader, the node that shares most
   bands with others (an original resembles its altered copies more than they resemble
   each other), and the links found give first components;
3. only in bands that still hold several components, nodes of different components
   are paired. In a band with at most ``FEW`` nodes outside its largest component these
   meet the others block by block, if their sizes and 512 four-bit coordinates allow the
   similarity (a pair at the threshold is refused with odds of about one in 70,000;
   ``may_differ=None`` refuses none). In any other band nodes meet by what sets them
   apart from a guide (``_apart``), which loses no pair. The guide is the one that shares
   most bands of the leaders that the band's leader meets, so that bands of one crowd have
   one guide and a node is described once, not once for each band. Pairs found are checked;
   one that meets in several bands is checked once.

With 50 bands of 5 rows, a pair at a similarity of 0.75 shares no band with odds of
about one in 700,000; a more similar pair, with less.

Cases: a null or empty text, or one of white space, has an empty set, is linked with
nothing and kept. Rows with equal sets are linked, also rows repeated as a whole. A
null id sorts below all others, so a group that holds one has a null component id.
An empty table gives no rows. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.llm import scratch, shingles
from lodestream.llm.components import components
from lodestream.llm.worker import giving_back

BANDS, ROWS = 50, 5
COORDINATES, NIBBLES_IN_LONG = 512, 16
SEED = 20
PERCENT = 75
#: Pairs of one node in one key of a join; nodes of one band in one key.
SHARE, BLOCK = 256, 512
#: Nodes outside a band's largest component that meet all others of the band.
FEW = 32
#: Rows of whose sets the differences are handed back at a time.
AT_ONCE = 128
#: Coordinates of the sketch that may differ: at a similarity of 0.75 the mean is 120, the standard deviation 9.6.
MAY_DIFFER = 160

#: What stands for a null id; a real id of that value counts as null.
_NO_ID = -(2**63)
_SIGNED = "doc_key bigint, row bigint, n_shingles bigint, set_key binary, bands array<bigint>, sketch array<bigint>"


def _lists(rows: list[np.ndarray], width: int) -> pa.Array:
    flat = np.concatenate(rows) if rows else np.empty(0, dtype=np.int64)
    ends = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) for r in rows], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64()))


def _sketch(signature: np.ndarray) -> np.ndarray:
    """The low four bits of each coordinate, sixteen to a long."""
    low = (signature & np.uint32(15)).astype(np.uint64).reshape(-1, NIBBLES_IN_LONG)
    return (low << (np.arange(NIBBLES_IN_LONG, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64).view(np.int64)


def _signer(seed: int):
    none = np.empty(0, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 36
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                sizes, keys, bands, sketches = [], [], [], []
                for text in part.column(1).cast(pa.binary()):
                    found = shingles.shingle_set(text.as_py())
                    sizes.append(len(found))
                    keys.append(shingles.set_key(found))
                    if len(found):
                        signature = shingles.circulant_signature(found, COORDINATES, seed)
                        bands.append(shingles.band_keys(signature[: BANDS * ROWS], ROWS))
                        sketches.append(_sketch(signature))
                    else:
                        bands.append(none)
                        sketches.append(none)
                n = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(range(base, base + n), pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), _lists(bands, BANDS), _lists(sketches, COORDINATES // NIBBLES_IN_LONG)],
                    names=["doc_key", "row", "n_shingles", "set_key", "bands", "sketch"],
                )
                base += n

    return run


def _checker(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for b in batches:
            good = []
            ids, texts = b.column("u").to_pylist(), b.column("text_u").cast(pa.binary())
            for k, other in enumerate(b.column("text_v").cast(pa.binary())):
                if ids[k] != last:  # rows come sorted by u
                    last, held = ids[k], shingles.shingle_set(texts[k].as_py())
                good.append(shingles.jaccard_at_least(held, shingles.shingle_set(other.as_py()), percent))
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    return run


def _differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each pair the sizes of both sets, and the shingles that only one of them has."""
    last, held = None, None
    for whole in batches:
        for at in range(0, whole.num_rows, AT_ONCE):
            b = whole.slice(at, AT_ONCE)
            ids, texts, sizes, only = b.column("u").to_pylist(), b.column("text_u").cast(pa.binary()), [], []
            for k, other in enumerate(b.column("text_v").cast(pa.binary())):
                if ids[k] != last:
                    last, held = ids[k], shingles.shingle_set(texts[k].as_py())
                found = shingles.shingle_set(other.as_py())
                sizes.append((len(held), len(found)))
                only.append(np.setxor1d(held, found, assume_unique=True).view(np.int64))
            n_u, n_v = zip(*sizes, strict=True)
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v"), pa.array(n_u, pa.int64()), pa.array(n_v, pa.int64()), _lists(only, 0)], names=["u", "v", "n_u", "n_v", "only"])


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` (u, v) with text_u and text_v.

    A node that is u of many pairs is dealt over one salt for each ``SHARE`` of them, so
    that no key of the join has more than about that many.
    """
    hot = pairs.groupBy("u").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("salts")).filter("salts > 1")
    salts = F.coalesce("salts", F.lit(1))
    one = texts.select(F.col("node").alias("v"), F.col("text").alias("text_v"))
    two = texts.select(F.col("node").alias("u"), F.col("text").alias("text_u")).join(hot, "u", "left")
    two = two.select("u", "text_u", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    dealt = pairs.join(hot, "u", "left").select("u", "v", F.pmod(F.xxhash64("v"), salts).cast("int").alias("salt"))
    return dealt.join(one, "v").join(two, ["u", "salt"]).select("u", "v", "text_u", "text_v")


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (u, v) that are similar enough by their full sets."""
    return _with_texts(pairs, texts).mapInArrow(giving_back(_checker(percent)), "u bigint, v bigint")


def _apart(apart: DataFrame, percent: int) -> DataFrame:
    """(u, v), u < v: pairs of different components among nodes that were compared with one leader; no similar pair is left out.

    ``apart`` has (leader, node, root, asks, n_leader, n, only): sizes of the sets, the
    shingles that only one of them has, and whether the node neither has the leader's
    component nor is similar to it. Of two nodes of different components at least one
    asks, or both are linked by way of the leader.

    With o the leader, x one that asks and y any other node, the sets of x and y have
    |x and o| + |y and o| - |o| + |only x and only y| shingles in common. So to be similar
    they must share p(|x| + |y|) / (100 + p) less the first three terms of ``only``. As
    |x and o| < p(|x| + |o|) / (100 + p), that is more than (p|y| + 100|o|) / (100 + p)
    - |y and o|, whatever x is. So y shows all but so many of its ``only``, those first that
    the fewest ask for, and x asks with all of its own: of near copies of one text that
    differ each in its own way, few meet. Those it doesn't show count as shared.
    """
    both = ((F.col("n_leader") + F.col("n") - F.size("only")) / 2).cast("bigint")
    needs = F.floor((percent * F.col("n") + 100 * F.col("n_leader")) / (100 + percent)) - both + 1
    sides = lambda c: [F.col("node").alias(c), *(F.col(k).alias(f"{k}_{c}") for k in ("root", "n", "both", "size"))]
    each = apart.withColumn("both", both).withColumn("size", F.size("only")).withColumn("hidden", needs - 1).filter("hidden < size or asks")
    asks = each.filter("asks").select("leader", *sides("x"), F.explode("only").alias("e"))
    often = asks.groupBy("leader", "e").agg(F.count("*").alias("often"))
    shown = each.filter("hidden < size").select("leader", "n_leader", "asks", "hidden", *sides("y"), F.explode("only").alias("e"))
    shown = shown.join(often, ["leader", "e"], "left").withColumn("often", F.coalesce("often", F.lit(0)) - F.col("asks").cast("int"))
    rank = F.row_number().over(Window.partitionBy("leader", "y").orderBy("often", "e"))
    shown = shown.withColumn("rank", rank).filter("rank <= size_y - hidden and often > 0").drop("asks", "often", "rank")
    must = F.ceil(percent * (F.col("n_x") + F.col("n_y")) / (100 + percent)) - F.col("both_x") - F.col("both_y") + F.col("n_leader")
    able = (F.col("root_x") != F.col("root_y")) & (100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y")) & (must <= F.least("size_x", "size_y"))
    a, b = asks.alias("a"), shown.alias("b")
    met = a.join(b, (F.col("a.leader") == F.col("b.leader")) & (F.col("a.e") == F.col("b.e")) & able)
    shared = met.groupBy("a.leader", "x", "y").agg(F.count("*").alias("shared"), F.first(must - F.col("hidden")).alias("must"))
    return shared.filter("shared >= must").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()


#: The sketch's longs, a column each: sums over an array's elements make a method too long for the JVM to compile.
_SKETCH = [f"s{i}" for i in range(COORDINATES // NIBBLES_IN_LONG)]


def _differing() -> Column:
    """How many four-bit coordinates differ between the sketches of u and v."""
    ones = 0x1111111111111111
    total = F.lit(0)
    for c in _SKETCH:
        x = F.col(f"{c}_u").bitwiseXOR(F.col(f"{c}_v"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        total = total + F.bit_count(x.bitwiseAND(F.lit(ones)))
    return total


def _in_blocks(rows: DataFrame, first: bool, split: bool = False) -> DataFrame:
    """Rows of bands with the keys (one, two) under which they meet rows of their band.

    A band's rows are dealt into blocks of about ``BLOCK``. Two blocks meet under one
    key, so no key has the pairs of a whole band: of the earlier block the first side
    comes, of the later one the second. Where they are ``split``, rows of the band's
    ``main`` component go into the ``ahead`` first blocks (0: one block has all) and
    are no second side, so that they don't meet each other.
    """
    deal = lambda n: F.pmod(F.xxhash64("node", "band"), n)
    own, least = deal(F.col("blocks")), F.col("own")
    if split:
        rows = rows if first else rows.filter("root <> main")
        own = F.when(F.col("ahead") == 0, own).when(F.col("root") == F.col("main"), deal(F.col("ahead"))).otherwise(F.col("ahead") + deal(F.col("blocks") - F.col("ahead")))
        least = F.greatest("own", "ahead")
    others = F.sequence(least, F.col("blocks") - 1) if first else F.sequence(F.lit(0).cast("bigint"), F.col("own"))
    placed = rows.withColumn("own", own).withColumn("other", F.explode(others))
    one, two = ("own", "other") if first else ("other", "own")
    return placed.withColumn("one", F.col(one)).withColumn("two", F.col(two))


def near_duplicates(docs: DataFrame, *, percent: int = PERCENT, seed: int = SEED, may_differ: int | None = MAY_DIFFER) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` for each row of ``docs`` (doc_id: bigint, text).

    Where ``may_differ`` is None no pair is refused by its sketch: every pair of
    different components in a band is checked on full sets.
    """
    keyed = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_key"), "text")
    signed, _ = scratch.table(keyed.mapInArrow(giving_back(_signer(seed)), _SIGNED), "minhash-signed")
    full = signed.filter("n_shingles > 0")
    sets = full.groupBy("set_key").agg(F.min("row").alias("node"), F.min("doc_key").alias("label"))

    # A row for each node and band that several nodes share.
    nodes = full.select(F.col("row").alias("node"), "bands").join(sets.select("node"), "node", "left_semi")
    in_bands = nodes.select("node", F.explode("bands").alias("band"))
    shared = in_bands.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    sized, sized_path = scratch.table(in_bands.join(shared, "band"), "minhash-sized")
    ranked = sized.join(sized.groupBy("node").agg(F.sum("n").alias("met")), "node")
    leaders = ranked.groupBy("band").agg(F.max_by("node", F.struct("met", F.negate("node"))).alias("leader"), F.max("met").alias("met"))
    rows, rows_path = scratch.table(sized.select("band", "node").join(leaders, "band"), "minhash-rows")

    # Texts of those nodes, found by id and told from others with that id by their sets.
    wanted = rows.select("node").distinct()
    known = full.select(F.col("row").alias("node"), "doc_key", "set_key").join(wanted, "node", "left_semi")
    texts, texts_path = scratch.table(_texts(keyed, known), "minhash-texts")

    star, star_path = scratch.table(rows.filter("node <> leader").select(F.col("leader").alias("u"), F.col("node").alias("v")).distinct(), "minhash-star")
    links, links_path = scratch.table(_confirmed(star, texts, percent), "minhash-links")
    first = components(links, "minhash-first")

    # Bands that still hold several components: pairs across them.
    # The leader has met all of them.
    placed = rows.filter("node <> leader").join(first, "node", "left").select("band", "leader", "node", F.coalesce("root", "node").alias("root"))
    in_roots = placed.groupBy("band", "root").agg(F.count("*").alias("c"))
    mixed = in_roots.groupBy("band").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.sum("c").alias("n"), F.max("c").alias("most")).filter("most < n")
    crowded = rows.join(mixed.filter(F.col("n") - F.col("most") > FEW).select("band"), "band", "left_semi").select("leader", "node").distinct()
    guides = rows.select(F.col("node").alias("led"), "leader", "met").join(crowded.select(F.col("leader").alias("led")).distinct(), "led", "left_semi")
    guides = guides.groupBy("led").agg(F.max_by("leader", F.struct("met", F.negate("leader"))).alias("guide"))
    many = crowded.join(guides.withColumnRenamed("led", "leader"), "leader").filter("node <> guide").select(F.col("guide").alias("leader"), "node").distinct()
    many = many.join(first, "node", "left").select("leader", "node", F.coalesce("root", "node").alias("root"))
    many, many_path = scratch.table(many, "minhash-many")
    mixed = mixed.filter(F.col("n") - F.col("most") <= FEW)
    ahead = F.when(F.col("n") > BLOCK, F.ceil(F.col("most") / BLOCK)).otherwise(0)
    mixed = mixed.select("band", "main", ahead.alias("ahead"), (ahead + F.ceil((F.col("n") - F.col("most")) / BLOCK)).alias("blocks"))
    open_rows = placed.join(mixed, "band")
    sketches = full.select(F.col("row").alias("node"), F.col("n_shingles").alias("n"), "sketch").join(open_rows.select("node").distinct(), "node", "left_semi")
    # Which rows of a band meet doesn't depend on the band, so each row carries what the condition needs.
    ready, ready_path = scratch.table(open_rows.join(sketches, "node"), "minhash-open")
    longs = [F.coalesce(F.col("sketch")[i], F.lit(0).cast("bigint")).alias(c) for i, c in enumerate(_SKETCH)]
    ready = ready.select("band", "main", "ahead", "blocks", "node", "root", "n", *longs)
    kept = ("node", "root", "main", "n", *_SKETCH)
    a = _in_blocks(ready, True, True).select("band", "one", "two", *(F.col(c).alias(f"{c}_u") for c in kept))
    b = _in_blocks(ready, False, True).select("band", "one", "two", *(F.col(c).alias(f"{c}_v") for c in kept if c != "main"))
    able = (
        (F.col("root_u") != F.col("root_v"))
        & ((a["one"] != a["two"]) | (F.col("root_u") == F.col("main_u")) | (F.col("node_u") < F.col("node_v")))
        & (100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v"))
    )
    if may_differ is not None:
        able = able & (_differing() <= may_differ)
    meet = (a["band"] == b["band"]) & (a["one"] == b["one"]) & (a["two"] == b["two"])
    cross = a.join(b, meet & able).select(F.least("node_u", "node_v").alias("u"), F.greatest("node_u", "node_v").alias("v"))
    # Bands with many outside the largest component.
    apart = _with_texts(many.select(F.col("leader").alias("u"), F.col("node").alias("v")), texts).mapInArrow(giving_back(_differ), "u bigint, v bigint, n_u bigint, n_v bigint, only array<bigint>")
    apart = apart.select(F.col("u").alias("leader"), F.col("v").alias("node"), F.col("n_u").alias("n_leader"), F.col("n_v").alias("n"), "only")
    led = first.select(F.col("node").alias("leader"), F.col("root").alias("root_leader"))
    # A guide may be similar to a node that it wasn't compared with before.
    similar = (100 + percent) * (F.col("n_leader") + F.col("n") - F.size("only")) >= 2 * percent * (F.col("n_leader") + F.col("n"))
    apart = apart.join(many.join(led, "leader", "left"), ["leader", "node"]).withColumn("other", F.col("root") != F.coalesce("root_leader", "leader"))
    apart = apart.withColumn("similar", F.col("other") & similar).withColumn("asks", F.col("other") & ~similar).drop("root_leader", "other")
    apart, apart_path = scratch.table(apart, "minhash-apart")
    guided = apart.filter("similar").select(F.col("leader").alias("u"), F.col("node").alias("v"))
    cross = cross.unionByName(_apart(apart, percent)).distinct()
    cross, cross_path = scratch.table(cross, "minhash-cross")
    late = _confirmed(cross, texts, percent)
    linked = components(links.unionByName(late).unionByName(guided), "minhash-all")

    named = sets.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.join(linked.select("root").distinct(), "root", "left_semi").groupBy("root").agg(F.min("label").alias("least"))
    named = named.join(least, "root", "left").select("set_key", F.coalesce("least", "label").alias("component"))
    out = signed.select("doc_key", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.coalesce("component", "doc_key")
    out = out.select(
        F.nullif("doc_key", F.lit(_NO_ID)).alias("doc_id"), "n_shingles", F.nullif(component, F.lit(_NO_ID)).alias("component_id"), (F.col("doc_key") == component).alias("kept")
    )
    scratch.drop(docs.sparkSession, sized_path, rows_path, star_path, texts_path, links_path, ready_path, many_path, apart_path, cross_path)
    return out


def _keyed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        same = [shingles.set_key(shingles.shingle_set(t.as_py())) == k for t, k in zip(b.column("text").cast(pa.binary()), b.column("set_key").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("node"), b.column("text")], names=["node", "text"]).filter(pa.array(same, pa.bool_()))


def _texts(keyed: DataFrame, known: DataFrame) -> DataFrame:
    """(node, text), one row for each of ``known`` (node, doc_key, set_key)."""
    found = keyed.join(known, "doc_key").select("node", "set_key", "text")
    return found.mapInArrow(giving_back(_keyed_texts), "node bigint, text string").dropDuplicates(["node"])


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` whose document is kept, with all their columns. Rows that share an id go or stay together."""
    kept = near_duplicates(docs, **options).filter("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")
