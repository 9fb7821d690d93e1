"""Operators that SQL can't express, against plain loops; and every query against its SQL."""

import datetime as dt

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestream.operators import align, cdc, discover, documents, eventlog, fleet
from lodestream.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_rate_limit_is_that_of_a_loop(spark):
    got = {r["event_id"]: r["allowed"] for r in catalogue.QUERIES["token_bucket"](spark, SF).collect()}
    rows = duckdb.sql(f"select event_id, user_id, epoch(ts) from '{SF}/events.parquet' order by user_id, ts, event_id").fetchall()
    state, want = {}, {}
    for event, user, at in rows:
        tokens, last = state.get(user, (5, at))
        tokens = min(5, tokens + (at - last) / 3600)
        want[event] = tokens >= 1
        state[user] = (tokens - want[event], at)
    assert got == want


def test_throttle_is_that_of_a_loop(spark, tmp_path):
    start = dt.datetime(2023, 12, 31, 23, 0)
    times = [(1, 20 * k) for k in range(300)] + [(2, 0), (2, 59), (2, 60), (2, 60), (2, 119), (2, 120), (3, 4 * 86400), (None, 0), (None, 30), (None, 60)]
    rows = [(n, user, start + dt.timedelta(seconds=s)) for n, (user, s) in enumerate(times)]
    spark.createDataFrame([*rows, (len(rows), 1, None)], "event_id bigint, user_id bigint, ts timestamp").write.parquet(str(tmp_path / "events.parquet"))
    last, want = {}, []
    for _, user, at in rows:
        if user not in last or at - last[user] >= dt.timedelta(minutes=1):
            last[user] = at
            want.append((user, at))
    got = [tuple(r) for r in catalogue.QUERIES["last_seen_throttled"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    days = sorted(map(tuple, catalogue.QUERIES["usage_days"](spark, str(tmp_path)).collect()))
    assert [d[0] for d in days] == [dt.date(2023, 12, 31) + dt.timedelta(days=k) for k in range(5)]
    assert sum(d[1] for d in days) == len(rows) and [d[2] for d in days] == [True, True, True, False, False]


def test_batches_are_those_of_a_loop(spark):
    got = {r["o_orderkey"]: r["batch"] for r in catalogue.QUERIES["batch_packing"](spark, SF).collect()}
    rows = duckdb.sql(f"select o_orderkey, o_custkey, o_totalprice from '{SF}/orders.parquet' order by o_custkey, o_orderdate, o_orderkey").fetchall()
    state, want = {}, {}
    for key, cust, price in rows:
        batch, n, total = state.get(cust, (0, 0, 0.0))
        if n and (n >= 5 or total + price > 400_000):
            batch, n, total = batch + 1, 0, 0.0
        want[key] = batch
        state[cust] = (batch, n + 1, total + price)
    assert got == want


def _aligned(blocks, store):
    """Blocks and rows are texts of the user, or (role, text, name, arguments)."""
    full = lambda x: x if isinstance(x, tuple) else ("user", x, None, None)
    a = pd.DataFrame([(1, k, *full(x)) for k, x in enumerate(blocks)], columns=["conv_id", "turn", "role", "text", "name", "input"])
    b = pd.DataFrame([(1, k, *full(x)) for k, x in enumerate(store)], columns=["store_conv", "store_pos", "store_role", "store_text", "store_tool", "store_args"])
    got = align._align(a, b)
    return [(s, None if pd.isna(r) else int(r)) for s, r in zip(got["status"], got["store_row"], strict=True)]


STATUS = '{"command":"git status --short","cwd":"/x"}'
CALL = ("assistant", None, "Shell", STATUS)
ROW = ("assistant", None, "run_terminal_cmd", '{"command":"git status --short","toolCallId":"t1"}')
NO_ARGS = ("assistant", None, "run_terminal_cmd", "{}")


@pytest.mark.parametrize(
    ("blocks", "store", "want"),
    [
        (["aaa", "ccc"], ["aaa", "ccc"], [("matched", 0), ("matched", 1)]),
        (["aaa", "x", "ccc"], ["aaa", "ccc"], [("matched", 0), ("mismatch", None), ("matched", 1)]),
        (["aaa", "zzz"], ["aaa"], [("matched", 0), ("tail", None)]),
        (["aaa"], [], [("mismatch", None)]),
        (["aaa", "aaa"], ["aaa"], [("matched", 0), ("tail", None)]),
        ([None], ["aaa"], [("matched", 0)]),
        (["[REDACTED]", "aaa"], ["aaa"], [("skipped", None), ("matched", 0)]),
        (["<timestamp>now</timestamp> <user_query>hello\r\nthere</user_query>"], ["hello\nthere"], [("matched", 0)]),
        (["s" * 64 + "one"], ["s" * 64 + "two"], [("matched", 0)]),
        (["bbb", "aaa"], ["aaa", "bbb"], [("matched", 1), ("matched", 0)]),  # behind the place
        (["zz9", *["x"] * 3], [*[f"row{k}" for k in range(20)], "zz9"], [("mismatch", None)] * 4),  # beyond sixteen
        ([("assistant", "aaa", None, None)], ["aaa"], [("mismatch", None)]),
        ([CALL], [ROW], [("matched", 0)]),
        ([CALL], [NO_ARGS], [("matched", 0)]),
        ([CALL], [("assistant", None, "read_file", "{}")], [("mismatch", None)]),
        ([CALL], [("assistant", None, "run_terminal_cmd", '{"command":"git log"}')], [("mismatch", None)]),
        ([CALL], [NO_ARGS, ROW], [("matched", 1)]),  # what speaks for a row goes before what speaks against none
        ([CALL, CALL], [ROW], [("matched", 0), ("repeat", None)]),
        ([CALL, CALL], [ROW, NO_ARGS], [("matched", 0), ("ambiguous", None)]),
        ([CALL, CALL], [ROW, ROW], [("matched", 0), ("matched", 1)]),
    ],
)
def test_alignment_cases(blocks, store, want):
    assert _aligned(blocks, store) == want


@pytest.mark.parametrize(
    ("given", "stored", "want"),
    [
        (None, "{}", (align.NEUTRAL, 0)),
        ('{"a":"long enough"}', "null", (align.NEUTRAL, 0)),
        ('{"a":"long enough"}', '{"b":"long enough"}', (align.FOR, 1)),
        ('{"a":"long enough","n":3}', '{"b":"long enough"}', (align.WEAK, 1)),
        ('{"a":"long enough","b":"another one"}', '{"b":"long enough"}', (align.WEAK, 1)),
        ('{"a":"' + "x" * 40 + '","b":"another one"}', '{"b":"' + "x" * 40 + '"}', (align.PARTIAL, 1)),
        ('{"a":"another one"}', '{"b":"long enough"}', (align.AGAINST, 0)),
        ('{"cwd":"/somewhere"}', '{"b":"long enough"}', (align.NEUTRAL, 0)),
        ('{"a":"' + "x" * 40 + '"}', "torn {" + "x" * 40, (align.FOR, 1)),
        ("raw text", "torn raw text", (align.FOR, 1)),
    ],
)
def test_arguments_as_evidence(given, stored, want):
    assert align.arguments(given, stored) == want


def test_names_match_in_spark_as_in_python(spark):
    names = ["Shell", "run_terminal_cmd", "StrReplace", "search_replace", "CallMcpTool", "mcp_a", "Write", "create_file_v2", "", None, "Read"]
    pairs = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    got = pairs.select("a", "b", align.names_match(F.col("a"), F.col("b")).alias("ok")).collect()
    assert all(r["ok"] == align._names_match(r["a"], r["b"]) for r in got)


def test_scaffolding(spark):
    rows = [(None, None, False, None, ""), (None, None, True, None, "x"), (None, None, False, "c", "x"), ("t", None, True, None, ""), (None, "think", True, None, ""), (None, None, None, None, "x")]
    got = spark.createDataFrame(rows, "t string, r string, s boolean, c string, x string").select(align.scaffolding(*map(F.col, "trscx"))).collect()
    assert [r[0] for r in got] == [True, True, True, False, False, False]


def test_holding_is_brute_force(spark):
    texts = ["abcdefgh " * 6, "cdefgh abcdefgh abcdefgh abcdefgh abcdef", "fgh ab", "x", "<user_query>fgh ab</user_query>", "y" * 64 + "1", "y" * 64 + "2", "", None, " x "]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id int, text string")
    turns = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "conv_id int, turn int, text string")
    plain = [align.plain(t) for t in texts]
    alike = lambda a, b: len(a) >= 64 and len(b) >= 64 and a[:64] == b[:64]
    want = sorted((i, 1, k) for i, a in enumerate(plain) for k, b in enumerate(plain) if a and b and (a in b or b in a or alike(a, b)))
    assert sorted(map(tuple, align.holding(items, turns).distinct().collect())) == want


def test_grids_budgets_and_medians_are_brute_force(spark):
    sizes = {"a": [5, 1, 1, 1, 9, 9, 2], "b": [3], "c": list(range(50)) * 3, "d": [7] * 11}
    rows = [(g, s, k) for g, v in sizes.items() for k, s in enumerate(v)]
    df = spark.createDataFrame(rows, "g string, s int, k int")
    ordered = {g: sorted((s, k) for gg, s, k in rows if gg == g) for g in sizes}
    grid = sorted((g, *v[i]) for g, v in ordered.items() for i in ({*range(len(v))} if len(v) <= 5 else {i * (len(v) - 1) // 4 for i in range(5)}))
    assert sorted(map(tuple, discover.sample_grid(df, "g", "s", "k", 5).select("g", "s", "k").collect())) == grid
    budget = sorted((g, s, k, n < 4, max(0, len(v) - 4)) for g, v in ordered.items() for n, (s, k) in enumerate(v))
    assert sorted(map(tuple, discover.within_budget(df, "g", "s", "k", 4).select("g", "s", "k", "admitted", "remaining").collect())) == budget
    medians = {r["g"]: r["upper_median"] for r in cdc.upper_median(df, "g", "s").collect()}
    assert medians == {g: v[len(v) // 2][0] for g, v in ordered.items()}


def test_stream_and_table_give_the_same_buckets(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = eventlog.buckets(stream, "1 hour").writeStream.format("memory").queryName("b").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("b").drop("total").collect())) == sorted(map(tuple, eventlog.buckets(events, "1 hour").drop("total").collect()))


def test_ambiguous_hosts(spark):
    a = spark.createDataFrame([(1, "A.x"), (2, "b"), (3, "c"), (4, "C.y")], "i int, host string")
    b = spark.createDataFrame([(7, "a.corp"), (8, "c")], "j int, host string")
    assert sorted(map(tuple, fleet.match_hosts(a, "i", b, "j").collect()), key=str) == [(1, "matched", 7), (2, "unmatched", None), (3, "ambiguous", None), (4, "ambiguous", None)]


def _rows(df: pd.DataFrame) -> list:
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return ""
        if isinstance(v, (pd.Timestamp, dt.date, dt.datetime)):
            return str(pd.Timestamp(v))
        return f"{float(v):.3f}" if hasattr(v, "__float__") and not isinstance(v, str) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).values)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), con.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_holding_of_long_texts_and_common_beginnings(spark):
    """Texts of 200,000 characters, and items that begin alike: no row carries a text until hashes have met."""
    import random
    import time

    r = random.Random(6)
    letters = "abcdefgh é日🙂"
    long = "".join(r.choice(letters) for _ in range(200_000))
    opening = "the same beginning of all items, longer than any stretch. "[:58]
    items = [(k, opening + f"then item {k} goes on on its own way {k * k}") for k in range(300)] + [(900, long[70_000:150_000]), (901, long[5:15]), (902, long[199_990:]), (903, "zz" * 40), (904, long + "x")]
    turns = [(1, 1, long), (1, 2, "x" * 100 + items[7][1] + "y"), (1, 3, opening), (1, 4, items[8][1][:70]), (2, 1, "a" * 100_000)]
    began = time.time()
    got = set(map(tuple, align.holding(spark.createDataFrame(items, "item_id bigint, text string"), spark.createDataFrame(turns, "conv_id bigint, turn bigint, text string")).collect()))
    want = {(i, c, t) for i, a in items for c, t, b in turns if a in b or b in a or (len(a) >= 64 <= len(b) and a[:64] == b[:64])}
    assert got == want and (900, 1, 1) in want and (904, 1, 1) in want
    assert time.time() - began < 60
    assert align.holding(spark.createDataFrame([], "item_id bigint, text string"), spark.createDataFrame(turns, "conv_id bigint, turn bigint, text string")).count() == 0


def test_stretches_taken_are_few_and_all_taken_of_what_a_text_holds():
    """Before, each text gave the hashes of all its stretches, of every length below 32 that was asked for."""
    import random

    import pyarrow as pa

    r = random.Random(8)
    text = "".join(r.choice("abcdefgh é日🙂") for _ in range(3000))
    large = align._rolled(text)
    for n in [*range(1, 40), 200]:
        cut = align._cut(n, 16)
        held = set(align._taken(text, *cut, *large).tolist())
        for at in r.sample(range(3000 - n), 40):
            small = text[at : at + n]
            taken = set(align._taken(small, *cut, *align._rolled(small)).tolist())
            assert taken and taken <= held
    cuts = sorted({align._cut(n, 16) for n in range(12, 40)})
    batch = pa.RecordBatch.from_pydict({"large": pa.array([1], pa.int64()), "text": [text]})
    assert sum(b.num_rows for b in align._places(cuts)(iter([batch]))) < 2 * len(text)


def test_equal_rows_count_in_checksums(spark):
    rows = lambda *ids: spark.createDataFrame([("s", i, 0) for i in ids], "source string, id int, attempts int")
    of = lambda df: documents.checksums(df, "source").first()["checksum"]
    assert len({of(rows(1, 1)), of(rows(2, 2)), of(rows(1, 2)), of(rows(1, 1, 1)), of(rows(1))}) == 5 and of(rows(1, 2, 2)) == of(rows(2, 1, 2).repartition(3))


def test_long_conversations_with_many_calls():
    """Six thousand calls, each like its neighbours in part, take seconds: only rows that share a telling value are weighed again."""
    import json
    import time

    n = 6000
    args = lambda k: json.dumps({"path": f"/src/module_{k}/file.py", "mode": "edit", "n": k})
    blocks = pd.DataFrame({"conv_id": [1] * (n + 2), "turn": range(n + 2), "role": ["assistant"] * (n + 2), "text": [None] * (n + 2), "name": ["Write"] * (n + 2), "input": [args(k) for k in range(n)] + [args(5), args(n + 1)]})
    store = pd.DataFrame({"store_conv": [1] * n, "store_pos": range(n), "store_role": ["assistant"] * n, "store_text": [None] * n, "store_tool": ["write_file"] * n, "store_args": [args(k) for k in range(n)]})
    began = time.time()
    got = align._align(blocks, store)
    assert time.time() - began < 30
    assert got["status"].tolist() == ["matched"] * n + ["repeat", "tail"] and got["store_row"].tolist()[:n] == list(range(n))


def test_spans_are_sorted_once_in_tasks_that_dont_grow(spark, monkeypatch, tmp_path):
    """Odd spans too (empty, backwards, endless, nested): as by hand, from one sort; more bytes, more tasks."""
    from lodestream.operators import redaction

    import random

    r = random.Random(3)
    rows = [(r.randrange(40), s, r.choice([None, s, s - 3, *[s + r.randrange(12)] * 9]), r.randrange(3), f"r{r.randrange(4)}") for s in (r.randrange(60) for _ in range(900))]
    want = []
    for k in range(40):
        islands, reach = [], None
        for _, s, e, _, rule in sorted((x for x in rows if x[0] == k), key=lambda x: (x[1], x[3], x[2] is None, -(x[2] or 0), x[4])):
            if reach is None or s >= reach:
                islands.append([k, s, None, rule])
            ends = [x for x in (islands[-1][2], e) if x is not None]
            islands[-1][2] = max(ends, default=None)
            reach = max((x for x in (reach, e) if x is not None), default=None)
        want += map(tuple, islands)
    spans = spark.createDataFrame(rows, "k int, s int, e int, p int, r string")
    got = redaction.merged(spans, "k")
    order = lambda t: [x if x is not None else -99 for x in t]
    assert sorted(map(tuple, got.collect()), key=order) == sorted(map(tuple, want), key=order)
    assert redaction.merged(spans, "k")._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    monkeypatch.setattr(redaction, "SPANS_BYTES", 200)
    spans.write.parquet(str(tmp_path / "spans"))
    assert redaction.merged(spark.read.parquet(str(tmp_path / "spans")), "k").rdd.getNumPartitions() > 10
