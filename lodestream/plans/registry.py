"""Registration of queries together with the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name; ``sql`` is the DuckDB equivalent."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def relational(name: str, text: str, duckdb: str | None = None) -> None:
    """Register a query that is one SQL statement; ``{table}`` names an input table."""
    tables = sorted(set(re.findall(r"\{(\w+)\}", text)))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{t: read(spark, sf_dir, t) for t in tables})

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = re.sub(r"\{(\w+)\}", r"\1", duckdb or text)
