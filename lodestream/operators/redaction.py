"""Redaction of free text: spans, their union with attribution, replacement, and the ledger."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions.rules import TEXT_RULES, Rule
from lodestream.functions.scan import Span, scanner
from lodestream.sources.spread import dealt, pieces

#: Bytes of spans, as Spark estimates them, that one task sorts.
SPANS_BYTES = 8 << 20


def sentinel(rule: Column) -> Column:
    return F.concat(F.lit("__REDACTED:"), rule, F.lit("__"))


def is_sentinel(value: Column) -> Column:
    """Whether a value is one sentinel and nothing else."""
    return value.rlike(r"^__REDACTED:[a-z0-9-]+__\z")


def _bytes(text: str, spans: list[Span]) -> list[tuple[int, int]]:
    """Places of ordered spans in bytes; one pass over the text."""
    if text.isascii():
        return [(s, e) for s, e, _, _ in spans]
    out, at, size = [], 0, 0
    for s, e, _, _ in spans:
        size += len(text[at:s].encode()) if s >= at else -len(text[s:at].encode())
        out.append((size, size + len(text[s:e].encode())))
        at = s
    return out


def spans(rows: DataFrame, key: str, text: str, rules: tuple[Rule, ...] = TEXT_RULES, user: str = "") -> DataFrame:
    """(key, s, e, p, r, m): one row for each match, with its byte offsets; rows without any give none. Only the key and the matches leave the task."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(rules, user)
        for b in pieces(batches):
            at, out = [], []
            for n, t in enumerate(b.column("t").to_pylist()):
                found = sorted(scan.spans(t)) if t else []
                at += [n] * len(found)
                out += [(*place, x[2], x[3], t[x[0] : x[1]]) for place, x in zip(_bytes(t, found), found, strict=True)] if found else []
            columns = [pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column("k").take(pa.array(at, pa.int32())), *columns], names=["k", "s", "e", "p", "r", "m"])

    found = rows.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, s bigint, e bigint, p int, r string, m string")
    return found.withColumnRenamed("k", key)


def gates(rows: DataFrame, key: str, text: str, rules: tuple[Rule, ...] = TEXT_RULES) -> DataFrame:
    """(key, rule): the rules whose keywords a text holds, letters in either case; those without keywords always."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(rules, "")
        for b in pieces(batches):
            masks = [(n, scan.seen(t)) for n, t in enumerate(b.column("t").to_pylist()) if t is not None]
            found = [(n, r.name) for n, mask in masks for k, r in enumerate(rules) if mask >> k & 1]
            yield pa.RecordBatch.from_arrays([b.column("k").take(pa.array([n for n, _ in found], pa.int32())), pa.array([r for _, r in found], pa.string())], names=["k", "rule"])

    return rows.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, rule string").withColumnRenamed("k", key)


def merged(found: DataFrame, key: str) -> DataFrame:
    """(key, s, e, r): overlapping spans united and attributed to the first by (start, class, longest, rule). Spans that only touch stay apart.

    Keys are dealt over so many tasks that each has about ``SPANS_BYTES`` of spans, and a
    task sorts them once: an island's end and attribution come from windows in that order.
    """
    order = [F.col("s"), F.col("p"), F.col("e").desc(), F.col("r")]
    w = Window.partitionBy(key).orderBy(*order)
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    rows = dealt(found.select(key, "s", "e", "p", "r"), SPANS_BYTES, key).withColumn("reach", F.max("e").over(before))
    rows = rows.withColumn("new", F.coalesce(F.col("reach").isNull() | (F.col("s") >= F.col("reach")), F.lit(False)))
    # The largest (island, end) of the rows before the next island, or of all rows of the key, is this island's end.
    last = F.max(F.struct("island", "e"))
    rows = rows.withColumn("island", F.count_if("new").over(upto)).withColumn("ended", last.over(before)).withColumn("whole", last.over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    end = F.coalesce(F.lead("ended").over(w), F.col("whole"))
    return rows.filter("new").select(key, "s", end["e"].alias("e"), "r")


def ledger(rows: DataFrame, text: str, by: str, rules: tuple[Rule, ...] = TEXT_RULES, user: str = "") -> DataFrame:
    """(by, rule, hits, bytes_redacted, bytes_total): what a scrub of all rows redacts, by group and rule.

    Each task sums its batches; only those sums are shuffled. Groups without a hit
    have no row. A null text counts as empty.
    """
    kind = rows.schema[by].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(rules, user)
        for b in pieces(batches):
            hits, redacted, total = Counter(), Counter(), Counter()
            for group, t in zip(b.column("by").to_pylist(), b.column("t").to_pylist(), strict=True):
                if t:
                    total[group] += len(t.encode())
                    found = scan.spans(t)
                    if found or (scan.user and scan.user in t):
                        for rule, n, size in scan.tally(t, found):
                            hits[group, rule] += n
                            redacted[group, rule] += size
                else:
                    total[group] += 0
            keys = [*hits, *((g, None) for g in total)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([g for g, _ in keys], b.column("by").type),
                    pa.array([r for _, r in keys], pa.string()),
                    pa.array([hits[k] for k in keys], pa.int64()),
                    pa.array([redacted[k] if k[1] else total[k[0]] for k in keys], pa.int64()),
                ],
                names=["by", "rule", "hits", "bytes"],
            )

    sums = rows.select(F.col(by).alias("by"), F.col(text).alias("t")).mapInArrow(run, f"by {kind}, rule string, hits bigint, bytes bigint").groupBy("by", "rule").agg(F.sum("hits").alias("hits"), F.sum("bytes").alias("bytes"))
    total = F.max(F.when(F.col("rule").isNull(), F.col("bytes"))).over(Window.partitionBy("by"))
    out = sums.withColumn("bytes_total", total).filter("rule is not null")
    return out.select(F.col("by").alias(by), "rule", "hits", F.col("bytes").alias("bytes_redacted"), "bytes_total")


def scrubbed(rows: DataFrame, key: str, text: str, rules: tuple[Rule, ...] = TEXT_RULES, user: str = "") -> DataFrame:
    """(key, text, hits): every row's text with its united regions replaced by sentinels. A null text stays null."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(rules, user)
        for b in pieces(batches):
            out = [scan.applied(t, scan.spans(t)) if t else (t, {}, 0) for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array([x[0] for x in out], pa.string()), pa.array([sum(x[1].values()) for x in out], pa.int64())], names=["k", "t", "hits"])

    found = rows.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, t string, hits bigint")
    return found.select(F.col("k").alias(key), F.col("t").alias(text), "hits")


def density(ledgers: DataFrame, by: str) -> DataFrame:
    """(by, density): the mean of redacted to all bytes over the files of each group that had something to redact."""
    share = F.col("bytes_redacted") / F.col("bytes_total")
    return ledgers.groupBy(by).agg(F.avg(F.when(share > 0, share)).alias("density"))


def slowest(runs: DataFrame, by: str) -> DataFrame:
    """(by, slowest): the row of the longest ``seconds`` of each group; of ties that with more ``bytes``, then the least ``id``."""
    order = F.struct(F.col("seconds"), F.col("bytes"), -F.col("id"))
    return runs.groupBy(by).agg(F.max_by(F.struct("id", "seconds", "bytes"), order).alias("slowest"))
