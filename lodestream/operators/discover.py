"""Discovery: path verdicts, identity collapse, sample grids, remotes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions.detect import glob_pattern


def any_glob(path: str, globs: list[str]) -> Column:
    """Whether one of the globs matches; ``<root>/**`` matches the root as well."""
    patterns = [glob_pattern(g) for g in globs] + [glob_pattern(g[:-3]) for g in globs if g.endswith("/**")]
    return reduce(lambda a, b: a | b, [F.col(path).rlike(p.replace(r"\[", "[").replace(r"\]", "]")) for p in patterns], F.lit(False))


def verdict(path: str, include: list[str], exclude: list[str], deny: list[str]) -> Column:
    """``denied``, ``excluded``, ``included`` or ``unmatched``, the first that holds."""
    return F.when(any_glob(path, deny), "denied").when(any_glob(path, exclude), "excluded").when(any_glob(path, include), "included").otherwise("unmatched")


def keep_best(forms: DataFrame, identity: str, order: list) -> DataFrame:
    """One row for each identity, the first by ``order``; rows with an empty identity all stay."""
    named, bare = forms.filter(F.col(identity) != ""), forms.filter(F.coalesce(F.col(identity), F.lit("")) == "")
    best = named.withColumn("_rank", F.row_number().over(Window.partitionBy(identity).orderBy(*order))).filter("_rank = 1").drop("_rank")
    return best.unionByName(bare)


def sample_grid(rows: DataFrame, by: str, size: str, tie: str, points: int) -> DataFrame:
    """``points`` evenly spread rows of each group in order of (size, tie), first and last included; all rows of smaller groups.

    Places come from counts of equal sizes; only rows of the sizes that hold a wanted
    place are ordered, so no group is sorted as a whole.
    """
    counts = rows.groupBy(by, size).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(by)
    placed = counts.withColumns({"_past": F.sum("_n").over(w.orderBy(size)) - F.col("_n"), "_all": F.sum("_n").over(w)})
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.floor(k * (F.col("_all") - 1) / (points - 1)).cast("bigint"))
    every = F.sequence(F.lit(0).cast("bigint"), F.col("_all") - 1)
    places = F.filter(F.when(F.col("_all") <= points, every).otherwise(grid), lambda x: (x >= F.col("_past")) & (x < F.col("_past") + F.col("_n")))
    wanted = placed.withColumn("_at", F.transform(places, lambda x: x - F.col("_past"))).filter(F.size("_at") > 0).select(by, size, "_at")
    some = rows.join(wanted, [by, size])
    rank = F.row_number().over(Window.partitionBy(by, size).orderBy(tie)) - 1
    return some.withColumn("_rank", rank.cast("bigint")).filter(F.array_contains("_at", F.col("_rank"))).drop("_rank", "_at")


def within_budget(rows: DataFrame, by: str, size: str, tie: str, most: int) -> DataFrame:
    """``rows`` with ``admitted`` and ``remaining``: the first ``most`` of each group in order of (size, tie) are admitted.

    The last admitted row of a group is found among ``most`` rows of each task; all
    others are only compared with it.
    """
    order = Window.partitionBy(by).orderBy(size, tie)
    last = rows.select(by, size, tie).withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= most).groupBy(by).agg(F.max(F.struct(size, tie)).alias("_last"))
    counts = rows.groupBy(by).agg(F.greatest(F.count("*") - most, F.lit(0)).alias("remaining"))
    return rows.join(last.join(counts, by), by).withColumn("admitted", F.struct(size, tie) <= F.col("_last")).drop("_last")


def remote(url: str) -> tuple[Column, Column]:
    """Host and path of a git remote in URL or scp form; user, port and ``.git`` are dropped."""
    bare = F.regexp_replace(F.regexp_replace(F.col(url), "^[a-z+]+://", ""), "^[^@/]*@", "")
    host = F.lower(F.regexp_extract(bare, "^([^:/]+)", 1))
    path = F.regexp_replace(F.regexp_extract(bare, "^[^:/]+(?::[0-9]+)?[:/](.*)$", 1), r"(\.git)?/*$", "")
    return host.alias("host"), path.alias("path")


def pick_root(candidates: DataFrame, by: str) -> DataFrame:
    """(by, root, reasons): the first of a source's ``candidates`` (place, root, expands, exists, denied, fits) that can be used, and why those before it can't."""
    why = F.when(~F.col("expands"), "unset variable").when(F.col("denied"), "denied").when(~F.col("exists"), "absent").when(~F.col("fits"), "no such folder in it")
    told = candidates.withColumn("_why", why)
    first = F.min(F.when(F.col("_why").isNull(), F.col("place")))
    picked = told.groupBy(by).agg(first.alias("_first"), F.min_by("root", F.when(F.col("_why").isNull(), F.col("place"))).alias("root"))
    refused = told.filter("_why is not null").join(picked, by).filter(F.col("_first").isNull() | (F.col("place") < F.col("_first")))
    reasons = refused.groupBy(by, "_why").agg(F.count("*").alias("n")).groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_why", "n")))).alias("reasons"))
    return picked.join(reasons, by, "left").select(by, "root", "reasons")
