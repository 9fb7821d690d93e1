"""Files as a stream: each tick takes the oldest new ones, scrubs their lines, and appends them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lodestream.functions import fields
from lodestream.operators import jsonl


def lines(spark: SparkSession, root: str, most: int) -> DataFrame:
    """(path, modified, line) of new files below ``root``, the oldest first, ``most`` files at a time."""
    found = spark.readStream.format("text").option("maxFilesPerTrigger", most).option("latestFirst", "false").option("recursiveFileLookup", "true").load(root)
    return found.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("line"))


def scrubbed(stream: DataFrame, family: str = "", user: str = "") -> DataFrame:
    """(path, modified, line, mode, hits, redacted, rule_hits) of a stream of lines, by the field lists of ``family``."""
    one = stream.select(F.struct("path", "modified").alias("of"), "line")
    out = jsonl.scrub(one, "of", "line", drops=fields.drops_for(family), exempt=fields.exempt_for(family), user=user)
    return out.select("of.path", "of.modified", *(c for c in out.columns if c != "of"))


def tick(spark: SparkSession, root: str, out: str, state: str, *, most: int = 1000, family: str = "", user: str = "") -> StreamingQuery:
    """One run over all files that no run before has taken; ``state`` remembers them, so a run that was cut off is taken up again."""
    stream = scrubbed(lines(spark, root, most), family, user)
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
