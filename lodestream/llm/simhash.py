"""Near-duplicates by SimHash fingerprints, found by multi-index hashing.

A text's fingerprint has a bit for each bit of the hashes of its 3-word shingles,
repeats included: 1 if set in over half of them. Texts of one fingerprint are one
node, so copies cost nothing more. Two nodes are linked at ``BITS`` = 3 or fewer
differing bits, all of them, and exactly:

1. A fingerprint is cut into two segments of 32 bits. Of two linked ones, some segment
   differs in at most one bit. Each node stands in the table under both of its
   segments; it asks for every value in the ball of radius one around each segment.
   (Values that differ in one bit meet from the one that has it: half of the ball is
   enough.) What answers is verified by the complete distance, in the join.
2. A value under which more than ``CROWDED`` nodes stand is not compared as a whole:
   the other 32 bits of these nodes are cut into two segments of 16 and asked for by
   whole balls, under that value; where this is crowded too, so are the last 16 bits,
   in segments of 8. There 56 bits are given, so at most 256 nodes stand under a key.

So no node is compared with more than ``CROWDED`` others for each key that it asks
for, however many fingerprints share a segment, and no pair is lost.

Hashes are XXH64, seed 42, of the shingle's UTF-8, its words joined by single spaces.
Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.

Cases: a null or empty text, or one of white space, has fingerprint zero and is
linked like any other. A text of fewer than three words is one shingle. Repeated rows
are linked. A null id sorts below all others, so a group that holds one has a null
component id. An empty table gives no rows. Other columns, whatever their names, are
left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.llm import scratch, shingles
from lodestream.llm.components import components
from lodestream.llm.worker import giving_back

WIDTH, HASH_SEED = 3, 42
BITS = 3
#: Widths of the segments of each level; those of a level halve what the level before left.
SEGMENTS = (32, 16, 8)
#: Nodes that stand under one key at most before it is split further.
CROWDED = 512

#: What stands for a null id; a real id of that value counts as null.
_NO_ID = -(2**63)


def fingerprint(text: bytes | None) -> int:
    """The 64-bit fingerprint of a text, unsigned."""
    words = shingles.words(text)
    if not words:
        return 0
    width = min(WIDTH, len(words))
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    starts = np.cumsum(sizes) - sizes
    last = starts[width - 1 :] + sizes[width - 1 :] - 1
    n = len(last)
    hashed = map(partial(xxhash.xxh64_intdigest, seed=HASH_SEED), (joined[a:b] for a, b in zip(starts.tolist(), last.tolist(), strict=False)))
    h = np.fromiter(hashed, dtype="<u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 2000):
            part = b.slice(at, 2000)
            found = np.array([fingerprint(t.as_py()) for t in part.column("text").cast(pa.binary())], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_key"), pa.array(found.view(np.int64))], names=["doc_key", "fp"])


def _part(rest: Column, k: int, width: int) -> Column:
    return F.shiftrightunsigned(rest, k * width).bitwiseAND(F.lit((1 << width) - 1))


def _under(rows: DataFrame, width: int, ball: str) -> DataFrame:
    """``rows`` (fp, key, rest) with a longer key for each value of each segment of ``rest``: the segment's own, its lower half ball's, or its whole ball's."""
    placed = []
    for k in range(2):
        own = _part(F.col("rest"), k, width)
        if ball == "own":
            values = F.array(own)
        elif ball == "lower":
            values = F.array_distinct(F.array(own, *(own.bitwiseAND(F.lit(~(1 << i))) for i in range(width))))
        else:
            values = F.array(own, *(own.bitwiseXOR(F.lit(1 << i)) for i in range(width)))
        key = F.shiftleft(F.shiftleft("key", 1).bitwiseOR(F.lit(k)), width)
        placed.append(rows.select("fp", key.alias("base"), F.explode(values).alias("value"), _part(F.col("rest"), 1 - k, width).alias("rest")).select("fp", F.col("base").bitwiseOR(F.col("value")).alias("key"), "rest"))
    return placed[0].unionByName(placed[1])


def links(nodes: DataFrame, bits: int = BITS, crowded: int = CROWDED) -> DataFrame:
    """(u, v) with u < v: all pairs of ``nodes`` (fp: distinct) at ``bits`` (3 at most) or fewer differing bits. Pairs may come more than once."""
    if bits > 3:
        raise ValueError("two segments at one bit each find up to three differing bits")
    spark = nodes.sparkSession
    standing = asking = nodes.select("fp", F.lit(0).cast("bigint").alias("key"), F.col("fp").alias("rest"))
    found, before = [], ()
    for level, width in enumerate(SEGMENTS):
        standing, asking = _under(standing, width, "own"), _under(asking, width, "whole" if level else "lower")
        full = standing.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > crowded).select("key", F.lit(True).alias("full"))
        full, full_path = scratch.table(full, f"simhash-full-{level}")
        more = level + 1 < len(SEGMENTS) and not full.isEmpty()
        here, there = standing, asking
        if more:
            here, there = (rows.join(full, "key", "left_anti") for rows in (standing, asking))
        a, b = there.select("key", F.col("fp").alias("u")), here.select("key", F.col("fp").alias("v"))
        near = (F.col("u") != F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits)
        met = a.join(b, (a["key"] == b["key"]) & near).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        found.append(scratch.table(met, f"simhash-links-{level}")[0])
        if more:
            after = [scratch.table(rows.join(full, "key", "left_semi"), f"simhash-rows-{level}") for rows in (standing, asking)]
            (standing, one), (asking, two) = after
        scratch.drop(spark, full_path, *before)
        if not more:
            break
        before = (one, two)
    return reduce(DataFrame.unionByName, found)


def near_duplicates(docs: DataFrame, *, bits: int = BITS, crowded: int = CROWDED) -> DataFrame:
    """``doc_id``, ``fingerprint``, ``component_id`` for each row of ``docs`` (doc_id: bigint, text)."""
    keyed = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_key"), "text")
    signed, _ = scratch.table(keyed.mapInArrow(giving_back(_sign), "doc_key bigint, fp bigint"), "simhash-signed")
    nodes, _ = scratch.table(signed.groupBy("fp").agg(F.min("doc_key").alias("label")), "simhash-nodes")
    linked = components(links(nodes.select("fp"), bits, crowded), "simhash-components")
    rooted = nodes.join(linked.withColumnRenamed("node", "fp"), "fp")
    least = rooted.groupBy("root").agg(F.min("label").alias("least"))
    named = rooted.join(least, "root").select("fp", "least")
    named = nodes.join(named, "fp", "left").select("fp", F.coalesce("least", "label").alias("component"))
    out = signed.join(named, "fp", "left")
    return out.select(F.nullif("doc_key", F.lit(_NO_ID)).alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.nullif("component", F.lit(_NO_ID)).alias("component_id"))
