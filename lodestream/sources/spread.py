"""Small tables for many cores."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows that a Python worker makes objects of at a time.
ROWS = 128

#: From here on a size is a default or a product of defaults.
UNKNOWN = 1 << 50


def _bytes(text: str) -> int:
    """A size as Spark's settings write it."""
    units = {"k": 10, "m": 20, "g": 30, "t": 40}
    bare = text.strip().lower().removesuffix("b")
    return int(bare[:-1]) << units[bare[-1]] if bare[-1:] in units else int(bare)


def _size(table: DataFrame) -> int:
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def dealt(table: DataFrame, most: int, *keys: str) -> DataFrame:
    """``table`` dealt by ``keys`` over a task for each ``most`` bytes that Spark takes it for, and no fewer than its session shuffles by: what a task holds doesn't grow with the table. Where Spark knows no size, as of rows that came from Python, it is the session's number."""
    size, least = _size(table), int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return table.repartition(max(least, -(-size // most)) if size < UNKNOWN else least, *keys)


def spread(table: DataFrame) -> DataFrame:
    """``table`` dealt over all cores, where it lies in fewer files than there are cores and is so small that its scan would leave cores idle.

    A file is read by as many tasks as it has row groups at most, so that a table of one
    row group is worked on by one core. Larger tables stay as they are: they have tasks
    enough, and their rows aren't shuffled.
    """
    spark = table.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if _size(table) >= cores * _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes")) or len(table.inputFiles()) >= cores:
        return table
    return table.repartition(cores)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in parts of ``ROWS`` rows: objects and results of one part are given back before those of the next are made."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)
