"""Running sums over one global order, and budgets that they gate, without a window in a single task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodestream.sources.shared import new_path


def _running(values: list[str], schema: StructType):
    """Within a task, whose rows come in order: each row's sums of the rows before it, and the task's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = dict.fromkeys(values, 0)
        task = TaskContext.get().partitionId()
        for b in batches:
            columns, names = list(b.columns), list(b.schema.names)
            for v in values:
                x = np.nan_to_num(b.column(names.index(v)).to_numpy(zero_copy_only=False)).astype(np.int64)
                until = np.cumsum(x) + held[v]
                columns.append(pa.array(until - x))
                held[v] = int(until[-1]) if len(until) else held[v]
            columns.append(pa.array(np.full(b.num_rows, task, dtype=np.int64)))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return run


def running_sums(rows: DataFrame, order: list[str], values: list[str], parts: int | None = None) -> DataFrame:
    """``rows`` with ``<value>_before``: each row's sum of ``values`` (longs; null: 0) over all rows before it in ``order``, which must tell all rows apart.

    Rows are dealt by ranges of the order and summed up within each; one row for each
    range then says what all ranges before it hold. That table, which has as many rows as
    there are ranges, is the only thing in one place; it is broadcast. The ranges are
    written to the shared folder, as a second look could draw them otherwise.
    """
    spark = rows.sparkSession
    n = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = rows.withColumns({v: F.coalesce(F.col(v).cast("bigint"), F.lit(0).cast("bigint")) for v in values}).repartitionByRange(n, *order).sortWithinPartitions(*order)
    schema = StructType([*ranged.schema.fields, *(StructField(f"_{v}", LongType()) for v in values), StructField("_range", LongType())])
    path = new_path(spark, "running-sums")
    ranged.mapInArrow(_running(values, schema), schema).write.parquet(path)
    summed = spark.read.schema(schema).parquet(path)
    sums = summed.groupBy("_range").agg(*(F.sum(v).alias(f"_{v}_all") for v in values))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_range", *(F.coalesce(F.sum(f"_{v}_all").over(before), F.lit(0)).alias(f"_{v}_start") for v in values))
    whole = summed.join(F.broadcast(starts), "_range")
    return whole.select(*rows.columns, *((F.col(f"_{v}") + F.col(f"_{v}_start")).alias(f"{v}_before") for v in values))


def gated(rows: DataFrame, order: list[str], size: str, spent: Column, most: int | None = None, most_bytes: int | None = None) -> DataFrame:
    """``rows`` with ``admitted``: what a walk in ``order`` takes before its budget ends.

    Each row taken reserves one of ``most`` files and its ``size`` of ``most_bytes``;
    where it isn't ``spent`` (it turned out to be unchanged, say) both are given back.
    The walk ends before the first row that a budget doesn't hold. A row larger than
    ``most_bytes`` is taken where nothing was spent before it.
    """
    one = rows.withColumn("_files", spent.cast("bigint")).withColumn("_bytes", F.when(spent, F.coalesce(F.col(size), F.lit(0))).otherwise(0).cast("bigint"))
    summed = running_sums(one, order, ["_files", "_bytes"])
    full = F.lit(False)
    if most is not None:
        full = full | (F.col("_files_before") >= most)
    if most_bytes is not None:
        full = full | ((F.col("_bytes_before") > 0) & (F.col("_bytes_before") + F.coalesce(F.col(size), F.lit(0)) > most_bytes))
    end = summed.filter(full).agg(F.min(F.struct(*order)).alias("_end"))
    out = summed.join(F.broadcast(end))  # one row
    return out.select(*rows.columns, (F.col("_end").isNull() | (F.struct(*order) < F.col("_end"))).alias("admitted"))
