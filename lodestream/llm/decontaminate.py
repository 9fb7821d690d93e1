"""Benchmark decontamination by spaced seeds, with Spark's own expressions only.

A seed is a window of up to 11 words of which a fixed mask reads six; the words
between may differ. No mask reads more than four of six neighbouring words, so that a
common phrase is no seed. Masked hashes of every position of every text meet those of
the benchmark. The first hit of a run on a diagonal is verified: among the word pairs
from 24 places before the seed to 36 after its start, some 20 neighbouring ones (all,
where the texts share fewer, but at least 12) must hold four fifths of equal pairs.
Substituted words are so tolerated, at whatever places: of every placing that the rule
accepts for 12 to 20 words, some mask reads equal words only (``tests/llm`` enumerates
them). Inserted and deleted words start another diagonal.

A text is worked on in pieces of ``PIECE`` places, each with the words around them that
a verification may read, and of a hit only the words that it compares go on: what a
task holds at once doesn't grow with hits times the text's length.

The benchmark's hashes are broadcast in blocks of ``BLOCK_HASHES`` at most, and its
words in blocks of ``BLOCK_ITEMS`` at most: the texts are never shuffled, and a
passage that a third of them shares costs no more than another. What is shuffled
are verified hits.

An item of fewer than 12 words is matched whole and without substitutions, by one
hash of all its words: anywhere in a text from ``WHOLE_FROM`` words on, and below
that, where it would meet ordinary phrases, only where it is the whole text.

Words are runs of letters and digits in lower case. Cases: null and empty texts
match nothing, be they documents or items. Rows that share an id, also a null one,
count as one document. An empty table gives no rows. Other columns, whatever their
names, are left out.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN, AROUND, WIDTH = 12, 24, 20
#: Places that each mask reads.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 8, 9, 10), (0, 2, 5, 6, 8, 10), (0, 1, 2, 3, 7, 10))
#: Words from which a short item is found inside longer texts.
WHOLE_FROM = 5
#: Places of a text that are worked on at once.
PIECE = 2048
#: Bounds of what is broadcast at once: 24 bytes a hash, some hundred words an item.
BLOCK_HASHES, BLOCK_ITEMS = 1_500_000, 10_000

Masks = tuple[tuple[int, ...], ...]


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; of a text without any, one empty word."""
    return F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")


def _keys(hashes: str, at: str, masks: Masks) -> Column:
    """The masked hash of each mask at a place. Past the end it reads fewer words, so that it equals no whole seed's."""
    return F.array(*(F.xxhash64(F.lit(m), *(F.get(F.col(hashes), F.col(at) + p) for p in mask)) for m, mask in enumerate(masks)))


def _pieces(texts: DataFrame, carried: list[str], masks: Masks, piece: int) -> DataFrame:
    """(carried, n, first, last, begin, w): a row for each ``piece`` places of a text of ``n`` words, from ``first`` to ``last``; ``w`` are the words around them, from place ``begin`` on."""
    last = F.greatest(F.size("w") - 1 - min(mask[-1] for mask in masks), F.lit(0))
    long = F.size("w") >= min([SPAN, *map(len, masks[len(MASKS) :])])
    # A filter of texts, also one that the plain form infers, would cut each text again.
    cut = texts.select(*carried, "w", F.explode_outer(F.when(long, F.sequence(F.lit(0), last, F.lit(piece)))).alias("first")).filter("first is not null")
    cut = cut.withColumn("begin", F.greatest(F.col("first") - AROUND, F.lit(0)))
    own = F.slice("w", F.col("begin") + 1, F.col("first") - F.col("begin") + piece + SPAN + AROUND)
    return cut.select(*carried, F.size("w").alias("n"), "first", F.least(F.col("first") + piece - 1, last).alias("last"), "begin", own.alias("w"))


def _positions(texts: DataFrame, carried: list[str], masks: Masks = MASKS, piece: int = PIECE) -> DataFrame:
    """(carried, n, begin, w, at, mask, key) for each place and mask of a text, with the piece that it is in."""
    hashed = _pieces(texts, carried, masks, piece).withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    placed = hashed.select(*carried, "n", "begin", "w", "h", F.explode_outer(F.sequence(F.col("first") - F.col("begin"), F.col("last") - F.col("begin"))).alias("place"))
    keyed = placed.select(*carried, "n", "begin", "w", "place", F.posexplode_outer(_keys("h", "place", masks)).alias("mask", "key"))
    return keyed.select(*carried, "n", "begin", "w", (F.col("begin") + F.col("place")).alias("at"), "mask", "key")


def _equal(doc_at: Column, item_at: Column) -> Column:
    return F.get(F.col("w"), doc_at - F.col("begin")) == F.get(F.col("item_w"), item_at)


def _begins_run() -> Column:
    """Whether the same mask doesn't also hit one place earlier on the diagonal."""
    reads = F.get(F.array(*(F.array(*map(F.lit, mask)) for mask in MASKS)), F.col("mask"))
    # As one function, which Spark doesn't compile: beside the loops over places it would make them too large to be compiled.
    before = F.forall(reads, lambda p: F.coalesce(_equal(F.col("at") - 1 + p, F.col("item_at") - 1 + p), F.lit(False)))
    return (F.col("at") == 0) | (F.col("item_at") == 0) | ~F.coalesce(before, F.lit(False))


def leaks(docs: DataFrame, benchmark: DataFrame, block_hashes: int = BLOCK_HASHES, block_items: int = BLOCK_ITEMS, piece: int = PIECE) -> DataFrame:
    """``doc_id``, ``item_id``, ``matched``, ``hits``: items that a document overlaps; the best window's equal words, and the verified runs of all masks (of a short item, its places)."""
    items = benchmark.select("item_id", words(F.col("text")).alias("item_w")).filter("item_w[0] <> ''")
    # Ten whole numbers at most: how long the short items are.
    lengths = sorted(r[0] for r in items.filter(F.size("item_w") < SPAN).select(F.size("item_w")).distinct().collect())
    masks = (*MASKS, *(tuple(range(n)) for n in lengths))
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("item_w") * len(MASKS)), F.lit(0)).alias("hashes")).first()
    blocks = max(1, math.ceil(size["hashes"] / block_hashes), math.ceil(size["n"] / block_items))
    texts = docs.select("doc_id", words(F.col("text")).alias("w"))
    parts = []
    for k in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "item_w"), F.lit(blocks)) == k) if blocks > 1 else items
        # Items of one id and other words are told apart by a hash of the words.
        own = own.withColumn("item_key", F.xxhash64("item_w"))
        seeds = _seeds(own, masks)
        found = _positions(texts, ["doc_id"], masks, piece).join(F.broadcast(seeds), (F.col("key") == F.col("seed")) & (F.col("mask") == F.col("seed_mask")))
        found = _around(found)
        found = found.join(F.broadcast(own.select("item_id", "item_key", "item_w").distinct()), "item_key")
        whole = (F.size("item_w") >= WHOLE_FROM) | (F.col("n") == F.size("item_w"))
        parts.append(_verified(found.filter(_begins_run() & whole)))
    hits = reduce(DataFrame.unionByName, parts)
    return hits.groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"), F.count("*").alias("hits"))


def _seeds(items: DataFrame, masks: Masks) -> DataFrame:
    """(item_key, item_at, seed_mask, seed): every mask at every place of a long item; of a short one, the mask of all its words."""
    ends = F.get(F.array(*(F.lit(mask[-1]) for mask in masks)), F.col("mask"))
    placed = _positions(items.select("item_key", F.col("item_w").alias("w")).distinct(), ["item_key"], masks).select("item_key", "n", "at", "mask", "key").distinct()
    long = (F.col("n") >= SPAN) & (F.col("mask") < len(MASKS)) & (F.col("at") + ends < F.col("n"))
    short = (F.col("n") < SPAN) & (F.col("mask") >= len(MASKS)) & (F.col("at") == 0) & (ends + 1 == F.col("n"))
    return placed.filter(long | short).select("item_key", F.col("at").alias("item_at"), F.col("mask").alias("seed_mask"), F.col("key").alias("seed"))


def _around(found: DataFrame) -> DataFrame:
    """Masked hits with just the words of the text that may be read for them, as ``w`` from place ``begin`` on."""
    start = F.greatest(F.col("at") - AROUND - 1, F.col("begin"))
    own = F.slice("w", start - F.col("begin") + 1, F.col("at") - start + SPAN + AROUND)
    return found.select("doc_id", "n", "at", "mask", "item_key", "item_at", start.alias("begin"), own.alias("w"))


def _windows(hits: DataFrame) -> DataFrame:
    """(doc_id, item_id, mask, n, own, others): the words of the text and of the item that a hit compares; ``n``, the item's number of words."""
    low = F.greatest(-F.col("at"), -F.col("item_at"), F.lit(-AROUND))
    high = F.least(F.col("n") - F.col("at"), F.size("item_w") - F.col("item_at"), F.lit(SPAN + AROUND))
    own, others = F.slice("w", F.col("at") - F.col("begin") + low + 1, high - low), F.slice("item_w", F.col("item_at") + low + 1, high - low)
    return hits.select("doc_id", "item_id", "mask", F.size("item_w").alias("n"), own.alias("own"), others.alias("others"))


def _verified(hits: DataFrame) -> DataFrame:
    flags = F.transform(F.sequence(F.lit(0), F.size("own") - 1), lambda k: F.when(F.get("own", k) == F.get("others", k), 1).otherwise(0))
    # "own" is read twice, so that Spark doesn't cut the windows here, to where whole pieces would go then.
    bounded = _windows(hits).select("doc_id", "item_id", "mask", flags.alias("flags"), "n")
    width = F.least(F.size("flags"), F.lit(WIDTH))
    sums = F.transform(F.sequence(F.lit(1), F.size("flags") - width + 1), lambda s: F.aggregate(F.slice("flags", s, width), F.lit(0), lambda a, b: a + b))
    best = bounded.select("doc_id", "item_id", "mask", "n", F.array_max(sums).alias("matched"), width.alias("width"))
    good = F.when(F.col("n") < SPAN, F.col("matched") == F.col("n")).otherwise((F.col("width") >= SPAN) & (5 * F.col("matched") >= 4 * F.col("width")))
    # A plain filter would go into the join, as one expression that makes the flags anew for each of their sums, and
    # the join, which can't be compiled then, would get a copy of the text for each masked hit.
    judged = best.select("doc_id", "item_id", "mask", F.explode_outer(F.array(F.when(good, F.col("matched")))).alias("matched"))
    return judged.filter("matched is not null")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose document overlaps no item, with all their columns."""
    leaky = leaks(docs, benchmark).select(F.col("doc_id").alias("leaky_id")).distinct()
    return docs.join(leaky, docs["doc_id"].eqNullSafe(leaky["leaky_id"]), "left_anti")
