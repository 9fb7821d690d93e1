"""The pipeline's stages in turn, and the registered queries against their SQL."""

import duckdb
import pytest

import corpus_pipeline
from lodestream.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        ids, kept = ({r[0] for r in d.select("doc_id").collect()} for d in (before, after))
        assert kept < ids or (name != "near_dedup" and kept == ids)
        before = after
    out = corpus_pipeline.run(spark, SF)
    assert {r[0] for r in out.select("doc_id").distinct().collect()} == kept


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for t in ("embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), con.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_all_queries_are_there():
    names = [n.split("_")[0] for n in queries.QUERIES]
    assert sorted(names) == sorted(["pipeline", *(f"op{k}" for k in range(1, 14))])
