"""Lists of records: strict ones, which the first bad record refuses, and lenient ones with a channel of what was refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: An inventory's metadata columns, rows, and characters of a value at most.
KEYS, ROWS, CHARACTERS = 16, 1000, 256
_BAD = "_refused"
_COLUMNS = KEYS + 2  # the host name, and one more, so that longer rows are seen


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, line_no, line) of text files, from 1.

    A line's number is its place in its piece of the file and the lines of the pieces
    before it; only the pieces' counts meet, no file does.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    pieces = raw.groupBy("path", "begin").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return raw.join(pieces.select("path", "begin", "first", before.alias("before")), ["path", "begin"]).select("path", (F.col("at") - F.col("first") + F.col("before") + 1).alias("line_no"), "line")


def strict(spark: SparkSession, path: str | list[str], schema: StructType, check: Column | None = None, what: str = "record") -> DataFrame:
    """The records of JSON lines. The first one that isn't one, or that ``check`` doesn't hold of, ends the job: such lists are authoritative."""
    found = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if check is None:
        return found
    # The record goes with its check, so that no plan leaves the check out.
    whole = F.struct(*schema.names)
    kept = F.when(F.coalesce(check, F.lit(False)), whole).otherwise(F.raise_error(F.concat(F.lit(f"{what} refused: "), F.to_json(whole))).cast(schema))
    return found.select(kept.alias("r")).select("r.*")


def lenient(spark: SparkSession, path: str | list[str], schema: StructType, checks: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(good records, refused ones) of JSON lines. Refused are (path, line_no, line, reason): what isn't a record of the schema, or the first of ``checks`` that doesn't hold."""
    wide = StructType([*schema.fields, StructField(_BAD, StringType())])
    read = lines(spark, path).filter(F.trim("line") != "").withColumn("r", F.from_json("line", wide, {"columnNameOfCorruptRecord": _BAD, "mode": "PERMISSIVE"}))
    broken = F.col("r").isNull() | F.col(f"r.{_BAD}").isNotNull()
    flat = read.select("path", "line_no", "line", broken.alias(_BAD), *(F.col(f"r.{n}").alias(n) for n in schema.names))
    reason = F.coalesce(F.when(F.col(_BAD), "not a record"), *(F.when(~F.coalesce(c, F.lit(False)), name) for name, c in (checks or {}).items()))
    told = flat.withColumn("reason", reason)
    return told.filter("reason is null").select(*schema.names), told.filter("reason is not null").select("path", "line_no", "line", "reason")


def inventory(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(hostname, metadata) of an inventory, and what is refused of it: (row, reason), row 0 being the whole file.

    The file is CSV with quoted fields, which may hold commas, line ends and doubled
    quotes. Its header is ``hostname`` and one to sixteen different keys (``[a-z][a-z0-9_]*``,
    32 characters at most); it has 1,000 rows at most. A row needs a host name and as many
    fields as the header, of 256 characters at most and without control characters. Empty
    rows don't count. A file whose header or size is refused has no rows.
    """
    options = {"multiLine": "true", "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD, "unescapedQuoteHandling": "RAISE_ERROR"}

    def rows(width: int) -> DataFrame:
        columns = [f"c{k}" for k in range(width)]
        schema = StructType([*(StructField(c, StringType()) for c in columns), StructField(_BAD, StringType())])
        raw = spark.read.schema(schema).options(**options).csv(path).withColumn("at", F.monotonically_increasing_id())
        fields = F.array(*(F.coalesce(c, F.lit("")) for c in columns))
        return raw.select("at", fields.alias("f"), F.col(_BAD).isNotNull().alias("odd")).filter(F.exists("f", lambda x: x != ""))

    # The header says how many fields a row has; Spark's reader marks rows of more and of fewer.
    head = rows(_COLUMNS).orderBy("at").select("f").first()
    names = list(head["f"]) if head else []
    while names and not names[-1]:
        names.pop()
    # One file of a thousand rows is read by one task; more rows are counted and refused.
    numbered = rows(max(len(names), 1)).withColumn("row", (F.row_number().over(Window.orderBy("at")) - 1).cast("bigint")).cache()
    n = numbered.count() - 1
    reason = None
    whole = numbered.filter("row = 0 and odd").isEmpty()
    good = whole and names[:1] == ["hostname"] and 2 <= len(names) <= KEYS + 1 and len(set(names)) == len(names) and spark.range(1).select(F.forall(F.array(*map(F.lit, names)), lambda x: x.rlike("^[a-z][a-z0-9_]{0,31}$"))).first()[0]
    if not good:
        reason = "the header must be hostname and 1 to 16 different keys of lower-case letters, digits and underscores"
    elif not 1 <= n <= ROWS:
        reason = f"an inventory has 1 to {ROWS} rows"
    if reason:
        none = numbered.filter(F.lit(False)).select(F.lit("").alias("hostname"), F.create_map().cast("map<string,string>").alias("metadata"))
        return none, spark.createDataFrame([(0, reason)], "row bigint, reason string")
    said = F.coalesce(
        F.when(F.col("odd"), F.lit(f"must have {len(names)} columns, and quotes around whole fields alone")),
        F.when(F.get("f", F.lit(0)) == "", "must have a hostname"),
        F.when(F.exists("f", lambda x: F.length(x) > CHARACTERS), F.lit(f"values have at most {CHARACTERS} characters")),
        F.when(F.exists("f", lambda x: x.rlike(r"\p{Cc}")), "values have no control characters"),
    )
    told = numbered.filter("row > 0").withColumn("reason", said)
    pairs = F.map_from_arrays(F.array(*map(F.lit, names[1:])), F.slice("f", 2, len(names) - 1))
    return told.filter("reason is null").select(F.get("f", F.lit(0)).alias("hostname"), pairs.alias("metadata")), told.filter("reason is not null").select("row", "reason")
