"""Raw commits of a stream of transcripts, each followed by its enrichment.

A tick takes the oldest new files below a folder, a bounded slice at a time. Of a slice
the lines are first kept aside as they are (``staged``), then scrubbed and committed
(``raw``); only then are its units enriched from the side store, and the objects made
are scrubbed and written (``derived``), but for those whose output hash and policy are
the ones remembered (``state``). The outcome of each unit is kept (``outcomes``); the
staged lines go when all that is done.

Every step writes a folder named after the slice's number, and a slice that is run
again after a stop at any point rewrites its own folders with the same rows: it looks
at the state of earlier slices only, and a raw commit that is whole is not made again.
The state of all slices before is put together every ``WHOLE`` slices, so that what is
read stays bounded by the number of units.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lodestream.functions import fields
from lodestream.operators import enrich, jsonl

WHOLE = 20
_STATE = "path string, source_hash string, output_hash string, policy string, slice bigint"

#: (store or None, why it can't be read or None), asked for once a slice.
Store = Callable[[SparkSession], tuple[DataFrame | None, str | None]]


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def is_whole(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    fs, at = _folder(spark, f"{path}/_SUCCESS")
    return fs.exists(at)


def _numbers(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of the whole folders ``kind=number`` below ``path``, in order."""
    fs, at = _folder(spark, path)
    if not fs.exists(at):
        return []
    names = (str(f.getPath().getName()) for f in fs.listStatus(at))
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{kind}=") and is_whole(spark, f"{path}/{n}"))


def state_before(spark: SparkSession, path: str, number: int) -> DataFrame:
    """One row for each path: what the slices before ``number`` left."""
    start = max((k for k in _numbers(spark, path, "upto") if k < number), default=None)
    parts = [f"{path}/slice={k}" for k in _numbers(spark, path, "slice") if k < number and (start is None or k > start)]
    parts += [f"{path}/upto={start}"] if start is not None else []
    if not parts:
        return spark.createDataFrame([], _STATE)
    all_ = spark.read.schema(_STATE).parquet(*parts)
    last = F.max_by(F.struct("source_hash", "output_hash", "policy", "slice"), "slice").alias("s")
    return all_.groupBy("path").agg(last).select("path", "s.source_hash", "s.output_hash", "s.policy", "s.slice")


def _scrubbed(lines: DataFrame, family: str, user: str) -> DataFrame:
    out = jsonl.scrub(lines.select(F.struct("path", "line_no").alias("of"), "line"), "of", "line", drops=fields.drops_for(family), exempt=fields.exempt_for(family), user=user)
    return out.select("of.path", "of.line_no", "line", "hits", "redacted")


def slice_done(batch: DataFrame, number: int, *, out: str, store: Store, policy: str, family: str = "", user: str = "") -> None:
    """Commit a slice (path, begin, line; the lines of a file in order of ``begin`` and of the rows) and enrich its units."""
    spark = batch.sparkSession
    at = lambda kind: f"{out}/{kind}/slice={number}"
    if not (is_whole(spark, at("raw")) and is_whole(spark, at("staged"))):
        if is_whole(spark, at("outcomes")):
            return  # all was done, but for the stream's own note of it
        enrich.numbered(batch.withColumn("row", F.monotonically_increasing_id()), ["begin", "row"]).write.mode("overwrite").parquet(at("staged"))
        _scrubbed(spark.read.parquet(at("staged")), family, user).write.mode("overwrite").parquet(at("raw"))
    staged = spark.read.parquet(at("staged"))

    def cut(found: DataFrame) -> DataFrame:
        found.write.mode("overwrite").parquet(at("aligned"))
        return spark.read.schema(found.schema).parquet(at("aligned"))

    outcomes, made = enrich.enrich(staged, *store(spark), cut)
    named = outcomes.withColumn("path", enrich.derived_path(F.col("path")))
    told = enrich.decided(named, state_before(spark, f"{out}/state", number), policy).withColumn("decided_in", F.lit(number).cast("bigint"))
    told.write.mode("overwrite").parquet(at("decisions"))
    told = spark.read.parquet(at("decisions"))
    shipped = told.filter("decision = 'shipped'")
    objects = made.withColumn("path", enrich.derived_path(F.col("path"))).join(shipped.select("path"), "path", "left_semi")
    _scrubbed(objects, family, user).write.mode("overwrite").parquet(at("derived"))
    shipped.select("path", "source_hash", "output_hash", F.lit(policy).alias("policy"), F.col("decided_in").alias("slice")).write.mode("overwrite").parquet(f"{out}/state/slice={number}")
    if number % WHOLE == WHOLE - 1:
        state_before(spark, f"{out}/state", number + 1).write.mode("overwrite").parquet(f"{out}/state/upto={number}")
    told.drop("decided_in").write.mode("overwrite").parquet(at("outcomes"))
    for kind in ("staged", "aligned", "decisions"):
        fs, path = _folder(spark, at(kind))
        fs.delete(path, True)


def latest(spark: SparkSession, out: str) -> DataFrame:
    """(path, line_no, line) of the object last written for each path."""
    state = state_before(spark, f"{out}/state", 1 << 62)
    lines = spark.read.option("basePath", f"{out}/derived").parquet(f"{out}/derived")
    return lines.withColumn("slice", F.col("slice").cast("bigint")).join(state.select("path", "slice"), ["path", "slice"]).select("path", "line_no", "line")


def tick(
    spark: SparkSession, root: str, out: str, store: Store, *, most: int = 1000, policy: str = "", family: str = "", user: str = "", native: Callable[[Column], Column] = lambda p: p, step: Callable[..., None] = slice_done
) -> StreamingQuery:
    """One run over all files below ``root`` that no run before has taken, ``most`` at a time; ``native`` makes a unit's path of a file's."""
    found = spark.readStream.format("text").option("maxFilesPerTrigger", most).option("latestFirst", "false").option("recursiveFileLookup", "true").load(root)
    lines = found.select(native(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_block_start").alias("begin"), F.col("value").alias("line"))
    one = partial(step, out=out, store=store, policy=policy, family=family, user=user)
    return lines.writeStream.foreachBatch(one).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
