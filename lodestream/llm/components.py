"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm import scratch


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Count and an order-free sum of hashes: equal for equal edge tables."""
    got = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return int(got["n"]), int(got["h"] or 0)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for each node of ``edges`` (u, v: bigint); root is the component's least node.

    Each round hangs a node's larger neighbours on its least one (large star), then
    its smaller neighbours and itself on the least of those (small star), by
    aggregations and joins that AQE may split; it ends when a round changes nothing.
    Rounds are written to the shared folder. Roots are listed too. No edges, no rows.
    """
    spark = edges.sparkSession
    down = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, path = scratch.table(down, name)
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lower, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .filter("u <> v")
            .distinct()
        )
        after, after_path = scratch.table(small, name)
        scratch.drop(spark, path)
        was, now, path, mark = mark, after, after_path, _mark(after)
        if was == mark:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
