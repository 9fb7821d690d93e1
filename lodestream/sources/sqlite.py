"""SQLite files as tables. Spark reads the files from any store; each is opened from its bytes, in memory."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one file beyond which its result is marked as truncated.
MOST_ROWS = 200_000
#: Key prefixes that are never read, and exact keys that are read all the same (fixed values).
DENIED = ("secret://", "auth/", "token/")
ALLOWED = ("auth/plan", "auth/email", "auth/tier", "auth/region")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files below ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")


def _opened(content: bytes) -> sqlite3.Connection:
    con = sqlite3.connect(":memory:")
    con.deserialize(bytes(content))
    con.text_factory = lambda b: b.decode("utf-8", "replace")
    return con


def key_values(found: DataFrame, table: str, prefixes: list[str], most: int = MOST_ROWS) -> DataFrame:
    """(path, key, value, truncated) of the rows whose key has one of the prefixes and isn't denied, in order of key."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                con = _opened(content)
                likes = [p.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%" for p in prefixes]
                where = " or ".join(["key like ? escape '\\'"] * len(likes)) or "1"
                rows = con.execute(f'select key, value from "{table}" where {where} order by key limit {most + 1}', likes).fetchall()
                con.close()
                text = [v if isinstance(v, str) or v is None else bytes(v).decode("utf-8", "replace") if isinstance(v, bytes) else str(v) for _, v in rows[:most]]
                yield pd.DataFrame({"path": path, "key": [k for k, _ in rows[:most]], "value": text, "truncated": len(rows) > most})

    low = F.lower("key")
    denied = F.lit(False)
    for p in DENIED:
        denied = denied | F.startswith(low, F.lit(p))
    return found.mapInPandas(run, "path string, key string, value string, truncated boolean").filter(~denied | low.isin(*ALLOWED))


def records(found: DataFrame, tables: dict[str, str], drop: tuple[str, ...] = ()) -> DataFrame:
    """(path, session_id, type, json): the rows of ``tables`` (type to table) as sorted JSON objects; ``sessions`` rows go by their own id, others by ``session_id``."""
    import json

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                con = _opened(content)
                con.row_factory = sqlite3.Row
                con.execute("begin")
                there = {r[0] for r in con.execute("select name from sqlite_master where type = 'table'")}
                for kind, table in tables.items():
                    if table not in there:
                        continue
                    rows = [{k: r[k] for k in r.keys() if k not in drop} for r in con.execute(f'select * from "{table}" order by rowid')]
                    ids = [str(r.get("session_id", r.get("id"))) for r in rows]
                    yield pd.DataFrame({"path": path, "session_id": ids, "type": kind, "json": [json.dumps(r, sort_keys=True, ensure_ascii=False) for r in rows]})
                con.close()

    return found.mapInPandas(run, "path string, session_id string, type string, json string")
