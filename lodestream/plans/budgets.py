"""Queries of budgets over one order, of lists of records, and of what a fleet accepts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lodestream.operators import fleet, prefix
from lodestream.plans.registry import query, read
from lodestream.sources import lists
from lodestream.sources.shared import new_path


@query(
    """with d as (select doc_id, coalesce(n_chars, 0) as n, doc_id % 3 <> 0 as spent from documents),
            s as (select doc_id, n, coalesce(sum(case when spent then 1 else 0 end) over w, 0) as files, coalesce(sum(case when spent then n else 0 end) over w, 0) as size,
                    row_number() over (order by n, doc_id) as rn from d window w as (order by n, doc_id rows between unbounded preceding and 1 preceding)),
            e as (select min(rn) as rn from s where files >= 400 or (size > 0 and size + n > 150000))
       select doc_id, files::bigint as files_before, coalesce(s.rn < e.rn, true) as admitted from s, e"""
)
def gated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in one order of size: those that a budget of files and of bytes admits, unchanged ones giving theirs back."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("n_chars"), (F.col("doc_id") % 3 != 0).cast("bigint").alias("files"))
    admitted = prefix.gated(docs, ["n_chars", "doc_id"], "n_chars", F.col("files") == 1, 400, 150_000).select("doc_id", "admitted")
    return prefix.running_sums(docs, ["n_chars", "doc_id"], ["files"]).select("doc_id", "files_before").join(admitted, "doc_id")


@query(
    """with a as (select l_orderkey as doc, l_linenumber as "at", l_partkey as id, l_quantity as q from lineitem),
            o as (select doc, min("at") as "at", id from a where id not in (select p_partkey from part where p_size > 10)
                    and (doc, id) not in (select doc, id from a where ("at" % 2 = 1 and q < 25) or q > 45) group by doc, id),
            f as (select doc, min("at") as "at", arg_min(id, ("at", id)) as id from o group by doc)
       select o_orderkey as doc, f."at", f.id from (select distinct l_orderkey as o_orderkey from lineitem) x left join f on f.doc = x.o_orderkey"""
)
def first_unaccepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as collections of parts: the first part of each that no report, no stored copy and no confirmation covers."""
    asked = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("at"), F.col("l_partkey").alias("id"), "l_quantity")
    reported = read(spark, sf_dir, "part").filter("p_size > 10").select(F.col("p_partkey").alias("id"))
    return fleet.accepted(asked, reported, asked.filter("at % 2 = 1 and l_quantity < 25"), asked.filter("l_quantity > 45"))


@query(
    """select conv_id, turn, 'good' as what from conversations where conv_id % 5 <> 0 and turn % 4 <> 3 and turn <> 0
       union all select conv_id, turn, 'refused: turn 0' as what from conversations where conv_id % 5 <> 0 and turn % 4 <> 3 and turn = 0
       union all select conv_id, turn, 'refused: not a record' as what from conversations where conv_id % 5 = 0 or turn % 4 = 3"""
)
def refused_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns written as JSON lines, some of them torn and some of another shape, and read by a lenient reader: what is good, what is refused, and why."""
    turns = read(spark, sf_dir, "conversations")
    line = F.to_json(F.struct("conv_id", "turn", "role", "text"))
    torn = F.concat(F.format_string('{"conv_id":%d,"turn":%d,"te', "conv_id", "turn"))
    odd = F.concat(F.format_string('{"conv_id":%d,"turn":%d,"text":"x","role":{', "conv_id", "turn"))
    path = new_path(spark, "records")
    turns.select(F.when(F.col("conv_id") % 5 == 0, torn).when(F.col("turn") % 4 == 3, odd).otherwise(line).alias("value")).write.text(path)
    schema = StructType([StructField("conv_id", LongType()), StructField("turn", LongType()), StructField("role", StringType()), StructField("text", StringType())])
    good, refused = lists.lenient(spark, path, schema, {"turn 0": F.col("turn") != 0})
    at = lambda name: F.regexp_extract("line", f'"{name}":(\\d+)', 1).cast("bigint").alias(name)
    told = refused.select(at("conv_id"), at("turn"), F.concat(F.lit("refused: "), "reason").alias("what"))
    return good.select("conv_id", "turn", F.lit("good").alias("what")).unionByName(told)
