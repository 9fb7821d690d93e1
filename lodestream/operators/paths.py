"""Paths in trees: the nearest governing ancestor, marker vetoes, anchor attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ancestors(path: Column) -> Column:
    """All directories above a path, the nearest first, with their depths."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    depths = F.when(F.size(parts) > 1, F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.transform(depths, lambda d: F.struct(d.alias("depth"), F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, d), "/")).alias("dir")))


def nearest(files: DataFrame, key: str, path: str, roots: DataFrame) -> DataFrame:
    """(key, root): the deepest of ``roots`` (dir) above each file; null where none is. Equality joins on ancestors, no prefix comparison of all pairs."""
    above = files.select(key, F.explode(ancestors(F.col(path))).alias("a")).select(key, "a.depth", "a.dir")
    best = above.join(roots.select("dir").distinct(), "dir").groupBy(key).agg(F.max_by("dir", "depth").alias("root"))
    return files.select(key).join(best, key, "left")


def unmarked(files: DataFrame, key: str, path: str, markers: DataFrame) -> DataFrame:
    """``files`` without those below a directory that ``markers`` (dir) lists."""
    above = files.select(key, F.explode(ancestors(F.col(path))).alias("a")).select(key, F.col("a.dir").alias("dir"))
    return files.join(above.join(markers.select("dir").distinct(), "dir", "left_semi"), key, "left_anti")


def short_paths(message: Column, most: int) -> Column:
    """A message with long paths cut to their last two segments, and cut at its front to ``most`` characters."""
    return F.right(F.regexp_replace(message, r"(?:/[^/\s]+)+(/[^/\s]+/[^/\s]+)", "…$1"), F.lit(most))


def bounded(text: Column, most: int) -> Column:
    """Trimmed, cut to ``most`` characters, without control characters."""
    return F.regexp_replace(F.left(F.trim(text), F.lit(most)), r"\p{Cc}", "")
