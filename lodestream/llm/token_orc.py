"""Token ids in ORC files that prune by document id and split by stripe.

ORC's integer run-length encoding packs the ids. Files are ranges of ``doc_id``
in ascending order, with row indexes and a Bloom filter on ``doc_id``: a reader
that wants a few documents skips files, stripes and row groups, and a reader of
all of them takes stripes in parallel.

Cases: a null text is empty and has the end id alone. Null ids come first, as in
Spark's ascending order. Rows with equal ids are ordered by a hash of the text;
rows equal in both are alike, so their order can't be told. An empty table gives
files without rows. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.llm import tokenization as tk

END_ID = 1
#: Bytes of compressed input for each shard.
SHARD_BYTES = 64 << 20


def _encoder(vocabulary: str, end_id: int, id_type: pa.DataType | None = None):
    tail = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = tk.memo(vocabulary)
        shard, before = TaskContext.get().partitionId(), 0
        for b in batches:
            ids, texts = b.column(0), b.column(1).cast(pa.binary())
            first, held, size = 0, [], 0
            for row, text in enumerate(texts):
                held.append(memo.encode(text.as_py()) + tail)
                size += len(held[-1]) // 4
                if size >= tk.BATCH_TOKENS or row + 1 == len(texts):
                    lists = tk.id_lists(held)
                    ends = lists.offsets.to_numpy().astype("int64")
                    n = len(held)
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(first, n), pa.array([shard] * n, pa.int32()), pa.array(before + ends[:-1]), pa.array(ends[1:] - ends[:-1]), lists],
                        names=["doc_id", "shard", "shard_start", "n_tokens", "ids"],
                    )
                    before += int(ends[-1])
                    first, held, size = row + 1, [], 0

    return run


def _estimated_bytes(docs: DataFrame) -> int:
    """The size of a table as the optimizer estimates it, for files from their lengths; nothing is read. 0 where it has no estimate (an exabyte and more)."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def write_tokens(
    docs: DataFrame,
    path: str,
    *,
    vocabulary: str = tk.WORD_BPE,
    end_id: int = END_ID,
    shards: int | None = None,
    stripe_bytes: int = 64 << 20,
    row_group: int = 1000,
    bloom_fpp: float = 0.01,
) -> None:
    """Encode ``text`` of all ``docs`` and write ORC below ``path``: ``data`` and ``index``.

    ``index`` has a row for each shard: its first id's place among all ids, and the
    range of its document ids. Where ``shards`` isn't given there is one for each
    ``SHARD_BYTES`` of the table by Spark's own estimate, and as many as Spark's shuffle
    partitions at least.
    """
    spark = docs.sparkSession
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(_estimated_bytes(docs) / SHARD_BYTES))
    kind = docs.schema["doc_id"].dataType.simpleString()
    ranged = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).repartitionByRange(shards, "doc_id", "tie")
    ordered = ranged.sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    coded = ordered.mapInArrow(_encoder(vocabulary, end_id), f"doc_id {kind}, shard int, shard_start bigint, n_tokens bigint, ids array<int>")
    options = {
        "orc.create.index": "true",
        "orc.row.index.stride": str(row_group),
        "orc.stripe.size": str(stripe_bytes),
        "orc.bloom.filter.columns": "doc_id",
        "orc.bloom.filter.fpp": str(bloom_fpp),
        "compression": "zstd",
    }
    coded.write.options(**options).orc(f"{path}/data")
    sizes = (
        spark.read.orc(f"{path}/data")
        .groupBy("shard")
        .agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs"), F.min("doc_id").alias("least_id"), F.max("doc_id").alias("greatest_id"))
    )
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard, not for each document
    sizes.withColumn("base", F.coalesce(F.sum("n_tokens").over(upto), F.lit(0))).coalesce(1).write.orc(f"{path}/index")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids`` of what ``write_tokens`` wrote.

    A filter on ``doc_id`` reaches the scan: stripe statistics, row indexes and Bloom filters prune it.
    The joined table has one small row for each shard.
    """
    index = spark.read.orc(f"{path}/index").select("shard", "base")
    data = spark.read.orc(f"{path}/data")
    return data.join(F.broadcast(index), "shard").select("doc_id", (F.col("base") + F.col("shard_start")).alias("start"), "n_tokens", "ids")


def token_digest(tokens: DataFrame) -> DataFrame:
    """Per document: where its ids start, how many they are, and their crc32."""
    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(tk.digest(["doc_id", "start", "n_tokens"]), f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")
