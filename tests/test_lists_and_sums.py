"""Running sums and budgets against loops; strict and lenient lists; inventories."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from lodestream.operators import prefix
from lodestream.sources import lists


def walked(rows, most, most_bytes):
    """(key, admitted) by the loop that reserves and gives back."""
    files, size, out, ended = 0, 0, [], False
    for _, key, n, spent in sorted(rows):
        n = n or 0
        ended = ended or (most is not None and files >= most) or (most_bytes is not None and size > 0 and size + n > most_bytes)
        out.append((key, not ended))
        if spent and not ended:
            files, size = files + 1, size + n
    return sorted(out)


@pytest.mark.parametrize(("most", "most_bytes"), [(5, None), (None, 300), (7, 300), (0, 300), (None, 0), (1000, 10**9), (None, None)])
def test_budgets_are_those_of_a_loop(spark, most, most_bytes):
    r = random.Random(str((most, most_bytes)))
    rows = [(r.randrange(20), f"k{k:03}", r.choice([None, 0, 1, 50, 120, 400]), r.random() < 0.6) for k in range(200)]
    df = spark.createDataFrame(rows, "mtime int, key string, size bigint, spent boolean").repartition(5)
    got = prefix.gated(df, ["mtime", "key"], "size", F.col("spent"), most, most_bytes)
    assert sorted((x["key"], x["admitted"]) for x in got.select("key", "admitted").collect()) == walked(rows, most, most_bytes)


def test_running_sums_of_one_large_group(spark):
    """Ten million rows of one group in one order: no window sees more than a row for each range."""
    n = 10_000_000
    rows = spark.range(n).select(((F.col("id") * 7_919 + 5) % n).alias("k"), (F.col("id") % 3).alias("v"))
    got = prefix.running_sums(rows, ["k"], ["v"], parts=16)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "hashpartitioning(k" not in plan
    inverse = pow(7_919, -1, n)
    marks = [0, 1, 2, 999_999, 5_000_000, n - 1]
    found = {r["k"]: (r["v"], r["v_before"]) for r in got.filter(F.col("k").isin(marks)).collect()}
    values = (((__import__("numpy").arange(n, dtype="int64") - 5) * inverse % n) % 3).cumsum()
    assert found == {k: (int(values[k] - (values[k - 1] if k else 0)), int(values[k - 1]) if k else 0) for k in marks}


def test_running_sums_of_no_rows_nulls_and_other_columns(spark):
    df = spark.createDataFrame([("b", 2, None, "x"), ("a", 1, 5, None), ("c", 3, -2, "y")], "v_after string, k int, v bigint, _t string")
    got = prefix.running_sums(df, ["k"], ["v"]).orderBy("k").collect()
    assert [(r["k"], r["v_before"]) for r in got] == [(1, 0), (2, 5), (3, 5)]
    assert prefix.running_sums(df.limit(0), ["k"], ["v"]).count() == 0
    assert prefix.gated(df.limit(0), ["k"], "v", F.lit(True), 3).count() == 0


SCHEMA = StructType([StructField("id", StringType()), StructField("schema", IntegerType())])


def test_strict_lists_end_at_the_first_bad_record(spark, tmp_path):
    (tmp_path / "good").write_text("".join(json.dumps({"id": str(k), "schema": 1}) + "\n" for k in range(9)))
    assert lists.strict(spark, str(tmp_path / "good"), SCHEMA, F.col("schema") == 1).count() == 9
    (tmp_path / "torn").write_text('{"id":"1","schema":1}\n{"id":\n')
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        lists.strict(spark, str(tmp_path / "torn"), SCHEMA).collect()
    (tmp_path / "old").write_text('{"id":"1","schema":1}\n{"id":"2","schema":0}\n{"id":"3"}\n')
    for use in (lambda d: d.collect(), lambda d: d.select("id").collect()):
        with pytest.raises(Exception, match='grant refused: .*"2"|grant refused: .*"3"'):
            use(lists.strict(spark, str(tmp_path / "old"), SCHEMA, F.col("schema") == 1, "grant"))


def test_lenient_lists_say_what_they_refuse_and_where(spark, tmp_path):
    rows = ['{"id":"a","schema":1}', "torn {", "", '{"id":"b","schema":2}', '{"id":null,"schema":1}', '{"schema":"x"}', '{"id":"c","schema":1}']
    (tmp_path / "x.jsonl").write_text("\n".join(rows))
    (tmp_path / "y.jsonl").write_text("torn\n")
    good, refused = lists.lenient(spark, str(tmp_path), SCHEMA, {"has no id": F.col("id").isNotNull(), "unsupported schema": F.col("schema") == 1})
    assert sorted(map(tuple, good.collect())) == [("a", 1), ("c", 1)]
    got = sorted((r["path"][-7:], r["line_no"], r["reason"]) for r in refused.collect())
    assert got == [("x.jsonl", 2, "not a record"), ("x.jsonl", 4, "unsupported schema"), ("x.jsonl", 5, "has no id"), ("x.jsonl", 6, "not a record"), ("y.jsonl", 1, "not a record")]


def test_line_numbers_over_pieces_of_files(spark, tmp_path):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "4096")
    try:
        for f in range(3):
            (tmp_path / f"f{f}.txt").write_text("".join(f"{f}:{k} {'x' * (k % 50)}\n" for k in range(2000)))
        got = lists.lines(spark, str(tmp_path)).collect()
        assert len({r["path"] for r in got}) == 3 and len(got) == 6000
        assert all(int(r["line"].split()[0].split(":")[1]) == r["line_no"] - 1 for r in got)
    finally:
        spark.conf.set(name, before)


@pytest.mark.parametrize(
    ("text", "rows", "refused"),
    [
        ('hostname,team\na.example,"x, ""y""\nz"\n', "control", [(1, "values have no control characters")]),
        ('﻿hostname,team,site\r\n"a",b,\r\n\r\n,,\r\nc,"d,e",f\r\n', [("a", {"team": "b", "site": ""}), ("c", {"team": "d,e", "site": "f"})], []),
        ('hostname,team\na,"say ""hi"""\n', [("a", {"team": 'say "hi"'})], []),
        ("hostname,team\na,b,c\n,x\nd\n" + f"e,{'y' * 257}\nf,{'é' * 256}\n", [("f", {"team": "é" * 256})], [(1, "must have 2 columns"), (2, "must have a hostname"), (3, "must have 2 columns"), (4, "values have at most 256 characters")]),
        ("host,team\na,b\n", [], [(0, "header")]), ("hostname\na\n", [], [(0, "header")]), ("hostname,a,a\nx,y,z\n", [], [(0, "header")]), ("hostname,Team\na,b\n", [], [(0, "header")]),
        ("hostname," + ",".join(f"k{k}" for k in range(17)) + "\n", [], [(0, "header")]), ("hostname,a\n", [], [(0, "1 to 1000 rows")]), ("", [], [(0, "header")]), ("hostname,a\n" + "x,y\n" * 1001, [], [(0, "1 to 1000 rows")]),
    ],
)
def test_inventories(spark, tmp_path, text, rows, refused):
    (tmp_path / "i.csv").write_bytes(text.encode())
    good, bad = lists.inventory(spark, str(tmp_path / "i.csv"))
    got = sorted((r["hostname"], r["metadata"]) for r in good.collect())
    assert rows == "control" and got == [] or got == rows
    told = sorted(map(tuple, bad.collect()))
    assert [r for r, _ in told] == [r for r, _ in refused] and all(want in have for (_, have), (_, want) in zip(told, refused))
