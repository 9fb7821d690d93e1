"""Queries of transcripts enriched by a side store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators import enrich
from lodestream.plans.registry import query, read
from lodestream.sources.shared import new_path


@query(
    """with t as (
         select conv_id, 's/' || conv_id || case when conv_id % 11 = 0 then '.txt' else '.jsonl' end as path,
                row_number() over (partition by conv_id order by turn, role, text) as n,
                conv_id % 5 <> 0 and conv_id % 11 <> 0 and not (conv_id % 7 = 3 and turn % 3 = 1) and not (conv_id % 7 = 5 and turn >= 2) as kept from conversations),
       l as (select *, max(case when kept then n end) over (partition by conv_id) as last from t),
       u as (select path, count(*) as lines, count(*) filter (kept) as matched, count(*) filter (not kept and n < last) as mismatches, count(*) filter (not kept and n > last) as tail from l group by path),
       s as (select *, case when matched = 0 then 'skipped' when mismatches > 0 then 'mismatch' else 'ok' end as status from u)
       select path, status, mismatches::bigint as mismatches, tail::bigint as tail, case when status = 'ok' then 'shipped' end as decision,
         (case when status = 'ok' then lines else 0 end)::bigint as lines, (case when status = 'ok' then matched else 0 end)::bigint as enriched from s"""
)
def enriched_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as transcripts, enriched from a store that lacks some of them, some turns, or their ends: routes, counts and the objects' lines."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), F.concat_ws(" ", F.concat_ws("-", "conv_id", "turn", F.lit(".")), "text").alias("text"))
    path = F.concat(F.lit("s/"), F.col("conv_id").cast("string"), F.when(F.col("conv_id") % 11 == 0, ".txt").otherwise(".jsonl"))
    line = F.to_json(F.struct("role", F.struct(F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content")).alias("message")))
    lines = enrich.numbered(turns.select(path.alias("path"), line.alias("line"), "turn", "role", "text"), ["turn", "role", "text"])
    kept = turns.filter("conv_id % 5 <> 0 and not (conv_id % 7 = 3 and turn % 3 = 1) and not (conv_id % 7 = 5 and turn >= 2)")
    store = kept.select("conv_id", F.col("turn").alias("pos"), "role", "text", F.concat_ws("/", "conv_id", "turn").alias("row_id"))

    def cut(found: DataFrame) -> DataFrame:
        # Conversations are walked once, though outcomes and lines both ask for what was found.
        path = new_path(spark, "enriched-aligned")
        found.write.parquet(path)
        return spark.read.schema(found.schema).parquet(path)

    outcomes, made = enrich.enrich(lines, store, cut=cut)
    state = spark.createDataFrame([], "path string, source_hash string, output_hash string, policy string")
    told = enrich.decided(outcomes, state, "")
    held = made.groupBy("path").agg(F.count("*").alias("lines"), F.count_if(F.contains("line", F.lit('"_enrich":['))).alias("enriched"))
    return told.join(held, "path", "left").select("path", "status", "mismatches", "tail", "decision", *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("lines", "enriched")))
