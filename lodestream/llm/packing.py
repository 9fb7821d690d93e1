"""Packing by power-of-two decomposition.

A document's ids are cut into pieces of the longest length, then into one piece
for each binary digit of what remains, longest first. Each piece is a sequence of
its own: no sequence crosses documents and none is padded. Sequences of a length
lie in one folder of the output, ``bucket=<length>``, from which batches of one
shape are read. Tasks write what they read: nothing is shuffled.

Cases: a null text is empty, and so a piece of the end id alone. Rows with equal
or null ids are documents of their own. An empty table gives no sequences. Other
columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm import tokenization as tk
from lodestream.llm.worker import giving_back

END_ID = 2
MAX_LENGTH = 4096


def pieces(n: int, longest: int = MAX_LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; ``longest`` is a power of two."""
    out = [(s, longest) for s in range(0, n - longest + 1, longest)]
    at = len(out) * longest
    for bit in range(longest.bit_length() - 1, -1, -1):
        if (n - at) >> bit & 1:
            out.append((at, 1 << bit))
            at += 1 << bit
    return out


def _packer(vocabulary: str, end_id: int, longest: int):
    tail = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = tk.memo(vocabulary)
        task, made = TaskContext.get().partitionId(), 0
        for b in batches:
            ids, texts = b.column(0), b.column(1).cast(pa.binary())
            held: list[bytes] = []
            rows: list[tuple[int, int, int, int]] = []
            size = 0
            for row, text in enumerate(texts):
                coded = memo.encode(text.as_py()) + tail
                n = len(coded) // 4
                for start, length in pieces(n, longest):
                    held.append(coded[4 * start : 4 * (start + length)])
                    rows.append((row, start, length, n))
                size += n
                if size >= tk.BATCH_TOKENS or row + 1 == len(texts):
                    at, starts, lengths, totals = (list(c) for c in zip(*rows, strict=True))
                    names = pa.array([(task << 36) + made + k for k in range(len(rows))], pa.int64())
                    made += len(rows)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(at)), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(totals, pa.int64()), names, tk.id_lists(held), pa.array(lengths, pa.int32())],
                        names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "ids", "bucket"],
                    )
                    held, rows, size = [], [], 0

    return run


def write_sequences(docs: DataFrame, path: str, *, vocabulary: str = tk.WORD_BPE, end_id: int = END_ID, longest: int = MAX_LENGTH) -> None:
    """Encode and cut ``text`` of all ``docs``; write the sequences as Parquet below ``path``, a folder for each length.

    A sequence's id joins its task's number and its place in that task.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = docs.select("doc_id", "text").mapInArrow(
        giving_back(_packer(vocabulary, end_id, longest)), f"doc_id {kind}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, ids array<int>, bucket int"
    )
    cut.write.partitionBy("bucket").option("compression", "zstd").parquet(path)


def read_sequences(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """The sequences, one row each; a filter on ``bucket`` prunes folders."""
    return spark.read.schema(f"doc_id {id_type}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, ids array<int>, bucket int").parquet(path)


def piece_digest(sequences: DataFrame) -> DataFrame:
    """Per piece: its place in document and sequence, and the crc32 of its ids. A piece starts its sequence, so ``offset`` is 0."""
    kind = sequences.schema["doc_id"].dataType.simpleString()
    kept = ["doc_id", "start", "length", "doc_tokens", "sequence_id"]
    out = sequences.select(*kept, "ids").mapInArrow(tk.digest(kept), f"doc_id {kind}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, ids_crc32 bigint")
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.lit(0).cast("bigint").alias("offset"))
