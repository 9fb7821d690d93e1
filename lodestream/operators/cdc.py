"""Change data capture: snapshot against remembered state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["source_id", "id"]


def classify(now: DataFrame, state: DataFrame) -> DataFrame:
    """``now`` (source_id, id, size, hash) with ``decision``: new, parked, unchanged, shrunk or changed."""
    was = state.select(*KEY, F.col("size").alias("_size"), F.col("hash").alias("_hash"), "parked", F.lit(True).alias("_known"))
    decision = (
        F.when(F.col("_known").isNull(), "new")
        .when(F.col("parked"), "parked")
        .when((F.col("_size") == F.col("size")) & (F.col("_hash") == F.col("hash")), "unchanged")
        .when(F.col("size") < F.col("_size"), "shrunk")
        .otherwise("changed")
    )
    return now.join(was, KEY, "left").withColumn("decision", decision).drop("_size", "_hash", "_known", "parked")


def before_reading(recompute_s: int = 24 * 3600, live: bool = False) -> Column:
    """``skipped``, ``unchanged`` or ``read``, by what is known without reading a file.

    A parked file waits until ``backoff_until`` unless a new snapshot of its series is
    there. One of the remembered size, time and path whose hash is known and whose
    policy is met needs no reading; of a ``live`` source only once it is older than the
    recompute window.
    """
    skip = F.col("parked") & (F.col("now") < F.col("backoff_until")) & ~F.col("new_snapshot")
    same = ~F.col("parked") & F.col("policy_met") & (F.col("size") == F.col("was_size")) & (F.col("mtime") == F.col("was_mtime")) & (F.col("was_hash") != "") & (F.col("path") == F.col("was_path"))
    if live:
        same = same & (F.col("now") - F.col("mtime") >= recompute_s)
    return F.when(skip, "skipped").when(F.coalesce(same, F.lit(False)), "unchanged").otherwise("read")


def policy_met(forced: Column, target: Column, sealed: Column) -> Column:
    """Whether a file needs no new sending: none is forced, or it was sealed under the (known) target policy."""
    return ~forced | ((target != "") & sealed.eqNullSafe(target))


def vanished(state: DataFrame, now: DataFrame) -> DataFrame:
    """State rows without a row in ``now``, of sources that ``now`` holds at all."""
    return state.join(now.select("source_id").distinct(), "source_id", "left_semi").join(now.select(*KEY), KEY, "left_anti")


def upper_median(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, upper_median): the middle value of each group, of two the greater. From counts of equal values, so no group's values meet in one place."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(by).orderBy(value))
    total = F.sum("n").over(Window.partitionBy(by))
    placed = counts.withColumns({"upto": upto, "middle": F.floor(total / 2) + 1})
    return placed.filter((F.col("upto") >= F.col("middle")) & (F.col("upto") - F.col("n") < F.col("middle"))).select(by, F.col(value).cast("bigint").alias("upper_median"))


def report(outcomes: DataFrame) -> DataFrame:
    """Counters by source, and the upper median of shipped sizes."""
    shipped = F.col("decision").isin("new", "changed", "shrunk")
    counts = outcomes.groupBy("source_id").agg(
        F.count_if(F.col("decision") == "new").alias("n_new"),
        F.count_if(F.col("decision").isin("changed", "shrunk")).alias("n_shipped"),
        F.count_if(F.col("decision") == "unchanged").alias("n_unchanged"),
        F.count_if(F.col("decision") == "parked").alias("n_parked"),
    )
    return counts.join(upper_median(outcomes.filter(shipped), "source_id", "size"), "source_id", "left")


def resend_outstanding(state: DataFrame, by: str, target: str) -> DataFrame:
    """(by, outstanding): remembered files that were sent, under another policy than ``target``."""
    waits = (F.coalesce(F.col("hash"), F.lit("")) != "") & ~F.col("policy").eqNullSafe(F.lit(target))
    return state.groupBy(by).agg(F.count_if(waits).alias("outstanding"))


def of_spec(state: DataFrame, specs: DataFrame) -> DataFrame:
    """State rows whose source is still read as ``specs`` (source_id, spec) says; rows of another generation, or of a source that is gone, count as never seen."""
    return state.join(specs.select("source_id", "spec").distinct(), ["source_id", "spec"], "left_semi")


def backoff(attempt: str) -> Column:
    """Seconds: one minute doubled by attempt, at most an hour."""
    return F.least(F.lit(60) * F.power(F.lit(2), F.least(F.col(attempt), F.lit(8))).cast("bigint"), F.lit(3600)).cast("bigint")


def refreshed(now: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What was read (``now``: source_id, id, path, size, mtime, hash) against the state (as ``now``, and parked, attempts, policy_met): decisions, and the state's next rows.

    The content's hash decides: a file of the remembered hash whose policy is met is
    ``unchanged``, and only what is remembered of its place, size and time is written
    anew; whatever parked it is over. Another one is ``shipped``, as ``shrunk`` if it is
    smaller than remembered under the same path. Rows of the state that weren't read stay.
    """
    was = state.select(*KEY, *(F.col(c).alias(f"_{c}") for c in ("path", "size", "hash", "policy_met")), F.lit(True).alias("_known"))
    both = now.join(was, KEY, "left")
    same = F.coalesce(F.col("_known") & F.col("_policy_met") & (F.col("_hash") == F.col("hash")), F.lit(False))
    shrunk = F.coalesce((F.col("size") < F.col("_size")) & (F.col("path") == F.col("_path")), F.lit(False))
    told = both.withColumn("decision", F.when(same, "unchanged").when(shrunk, "shrunk").otherwise("shipped"))
    after = told.select(*KEY, "path", "size", "mtime", "hash", F.lit(False).alias("parked"), F.lit(0).alias("attempts"), F.lit(True).alias("policy_met"))
    kept = state.join(now.select(*KEY), KEY, "left_anti").select(*after.columns)
    return told.select(*now.columns, "decision"), after.unionByName(kept)


def pending(files: DataFrame, state: DataFrame, specs: DataFrame) -> DataFrame:
    """``files`` (source_id, id, size, mtime, spec, session) with ``pending``: whether a report counts them as still to be sent.

    All files of a source whose remembered spec (``specs``: source_id, spec) is another
    one are. Of the others a file is if the state (source_id, id, size, mtime, hash,
    parked) doesn't have it, or with another size or time. A database's ``session`` has
    no size or time of its own: it is if it isn't there, was never sent, is parked, or
    wasn't committed by the last run that committed any session of its source.
    """
    was = state.select(*KEY, F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), F.col("hash").alias("_hash"), F.col("parked").alias("_parked"), F.lit(True).alias("_known"))
    both = files.join(was, KEY, "left").join(specs.select("source_id", F.col("spec").alias("_spec")), "source_id", "left")
    checked = both.filter("session and _known").groupBy("source_id").agg(F.max("_mtime").alias("_checked"))
    both = both.join(checked, "source_id", "left")
    new_spec = F.col("_spec").isNotNull() & (F.col("_spec") != F.col("spec"))
    old_session = (F.coalesce("_hash", F.lit("")) == "") | F.col("_parked") | (F.col("_mtime") < F.col("_checked"))
    waits = F.when(new_spec | F.col("_known").isNull(), True).when(F.col("session"), old_session).otherwise((F.col("_size") != F.col("size")) | (F.col("_mtime") != F.col("mtime")))
    return both.select(*files.columns, F.coalesce(waits, F.lit(True)).alias("pending"))
