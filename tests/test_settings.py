"""Case tables of settings."""

import pytest
from pyspark.sql import functions as F

from lodestream.operators import settings

ENV = {"A": "/a", "B": "b", "EMPTY": "", "LOOP": "$A"}


@pytest.mark.parametrize(
    ("template", "path"),
    [
        ("~/x", "/home/u/x"), ("$A/x", "/a/x"), ("${A}/../y", "/y"), ("${A}${B}", "/ab"), ("/x/$B.d", "/x/b.d"), ("$NONE/x", None), ("/x/$EMPTY", None), ("x/y", None), ("", None), (None, None),
        ("$LOOP/x", None), ("/p$LOOP", "/p$A"), ("/x/~", "/x/~"), ("/a//b/./c/", "/a/b/c"), ("$A", "/a"), ("~", "/home/u"),
    ],
)
def test_templates(spark, template, path):
    df = spark.createDataFrame([(template, ENV)], "t string, env map<string,string>")
    assert df.select(settings.expanded(F.col("t"), F.col("env"), F.lit("/home/u"))).first()[0] == path


@pytest.mark.parametrize(
    ("text", "ns", "warned"),
    [
        (None, 900e9, False), ("  ", 900e9, False), ("5m", 300e9, False), ("1h30m", 5400e9, False), ("1.5h", 5400e9, False), (".5h", 1800e9, False), ("90s", 90e9, False), ("60000ms", 60e9, False), ("59s", 60e9, True),
        ("0", 900e9, True), ("-5m", 900e9, True), ("5", 900e9, True), ("m", 900e9, True), ("5m x", 900e9, True), ("5 m", 900e9, True), ("+2m", 120e9, False), ("61000000us", 61e9, False), ("61000000µs", 61e9, False), ("1d", 900e9, True), ("1m1m", 120e9, False), (".s", 900e9, True), ("2.m", 120e9, False),
    ],
)
def test_ticks(spark, text, ns, warned):
    got = spark.createDataFrame([(text,)], "t string").select(settings.tick(F.col("t")).alias("r")).first()["r"]
    assert got["ns"] == int(ns) and (got["warning"] is not None) == warned


@pytest.mark.parametrize(
    ("pattern", "good"),
    [
        ("a/**/b.ts", True), ("*.{js,ts}", True), ("{a,{b,c}}/x", True), ("[abc]/[!x-z]", True), ("a]b", True), ("[]a]", False), ("[a", False), ("[a-]", False), ("{a", False), ("a}", False), ("}{", False), ("[{]", True), ("[}]x", True),
        ("", False), (None, False), ("/a", False), ("~/a", False), ("$X/a", False), ("c:/x", False), ("a//b", False), ("./a", False), ("a/..", False), ("a/", False), ("a\\b", False), ("a\0b", False), ("...", True),
    ],
)
def test_patterns(spark, pattern, good):
    fault = spark.createDataFrame([(pattern,)], "p string").select(settings.pattern_fault(F.col("p"))).first()[0]
    assert (fault is None) == good


def test_a_catalog_refuses_ids_that_are_there_twice(spark):
    kind = "family string, sources array<struct<id:string,root:string>>"
    good = settings.catalog(spark.createDataFrame([("x", [("b", "/b"), ("a", "/a")]), ("y", [("c", None)])], kind)).collect()
    assert [(r["family"], r["id"], r["root"]) for r in good] == [("x", "a", "/a"), ("x", "b", "/b"), ("y", "c", None)]
    with pytest.raises(Exception, match='source id "a" declared twice .family x and y'):
        settings.catalog(spark.createDataFrame([("x", [("a", "1")]), ("y", [("a", "2")])], kind)).collect()
    with pytest.raises(Exception, match="a source of family y has no id"):
        settings.catalog(spark.createDataFrame([("x", [("a", "1")]), ("y", [(None, "2")])], kind)).collect()


def test_pause_flags(spark):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    flags = [(None, False), ("{}", True), ("", True), ("torn {", True), ('{"paused":false}', True), ('{"until":"2024-01-01T00:00:00Z"}', False), ('{"until":"2024-01-02T00:00:00Z"}', False), ('{"until":"2024-01-02T00:00:01Z"}', True), ('{"until":"soon"}', True)]
    df = spark.createDataFrame([(k, f) for k, (f, _) in enumerate(flags)], "k int, f string")
    got = {r["k"]: r["p"]["paused"] for r in df.select("k", settings.paused(F.col("f"), now).alias("p")).collect()}
    assert got == {k: want for k, (_, want) in enumerate(flags)}
