"""Event logs: windows, changes of a series, rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def buckets(events: DataFrame, width: str) -> DataFrame:
    """Counts and sums in tumbling windows; works on a stream as on a table."""
    w = F.window("ts", width)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("bucket"), "event_type", "n", "total")


def changed(series: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Whether a snapshot differs from the one before; the first one does."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return series.withColumn("changed", F.coalesce(F.col(value) != before, F.lit(True)))


def rate_limited(events: DataFrame, capacity: float, refill_s: float) -> DataFrame:
    """(event_id, user_id, allowed): a token bucket for each user, filled lazily, in order of (ts, event_id).

    A user's events come to one task in batches, sorted; only the bucket's state is held.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, tokens, last = None, capacity, None
        for part in parts:
            out = []
            for event, who, at in zip(part["event_id"], part["user_id"], part["ts"].astype("int64") / 1e9, strict=True):
                if who != user or last is None:
                    user, tokens, last = who, capacity, at
                tokens, last = min(capacity, tokens + (at - last) / refill_s), at
                out.append(tokens >= 1)
                tokens -= out[-1]
            yield pd.DataFrame({"event_id": part["event_id"], "user_id": part["user_id"], "allowed": out})

    dealt = events.select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts")).repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id")
    return dealt.mapInPandas(run, "event_id bigint, user_id bigint, allowed boolean")


def throttled(events: DataFrame, gap_s: float) -> DataFrame:
    """(user_id, ts): the stamps that are written if a user's last written one must be ``gap_s`` old at least, in order of (ts, event_id).

    A user's events come to one task in batches, sorted; only the last written stamp
    is held. Events without a time write nothing; those without a user are one user's.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, last = None, None
        for part in parts:
            keep = []
            for who, at in zip(part["user_id"].to_pylist(), part["ts"].cast("timestamp[us]").cast("int64").to_pylist(), strict=True):
                keep.append(last is None or who != user or at - last >= gap_s * 1e6)
                if keep[-1]:
                    user, last = who, at
            yield part.select(["user_id", "ts"]).filter(pa.array(keep, pa.bool_()))

    dealt = events.filter("ts is not null").select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts")).repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id")
    return dealt.mapInArrow(run, "user_id bigint, ts timestamp_ntz").withColumn("ts", F.col("ts").cast(events.schema["ts"].dataType))


def audit_tail(lines: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The last ``most`` entries of a log of two generations, the oldest first, and how many lines were passed over.

    ``lines`` has (generation, line_no, line), the rotated file being generation 0. A
    line that is no JSON object, a torn one, say, is no entry. Each task keeps ``most``
    entries at most before any are moved.
    """
    read = lines.withColumn("entry", F.from_json("line", "map<string,string>")).filter(F.trim("line") != "")
    bad = read.agg(F.count_if(F.col("entry").isNull()).alias("malformed"))
    last = read.filter("entry is not null").orderBy(F.desc("generation"), F.desc("line_no")).limit(most)
    return last.orderBy("generation", "line_no").select("generation", "line_no", "line", "entry"), bad


def failure_log(outcomes: DataFrame, by: str, order: list[str], most: int) -> DataFrame:
    """(by, streak, first, log): the failures since the last success of each group (``failed``, ``message``), their number, when the streak began, and the last ``most`` of them, the oldest first.

    No more than ``most`` messages of a group are gathered in one place.
    """
    at = F.struct(*order)
    good = outcomes.filter("not failed").groupBy(by).agg(F.max(at).alias("_good"))
    since = outcomes.filter("failed").join(good, by, "left").filter(F.col("_good").isNull() | (at > F.col("_good")))
    counts = since.groupBy(by).agg(F.count("*").alias("streak"), F.min(order[0]).alias("first"))
    last = since.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy(*(F.desc(c) for c in order)))).filter(F.col("_rank") <= most)
    log = last.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, "message"))), lambda x: x["message"]).alias("log"))
    return counts.join(log, by)
