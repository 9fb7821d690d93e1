"""Labelled rows that a classifier may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a classifier is fitted on at most, those of the least hashes of their ids.
FIT_ROWS = 20_000


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row's label may not be learnt from: crc32 of the id as text is divisible by 5. A null id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_texts(docs: DataFrame, labels: DataFrame, label: str, rows: int = FIT_ROWS) -> DataFrame:
    """(text, y) of documents whose ``label`` is 0 or 1 and that aren't held out.

    The joined side is broadcast: it has ``rows`` rows at most.
    """
    usable = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    some = usable.select("doc_id", F.col(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "y")
