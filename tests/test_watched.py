"""Keyed state: a stream and a table give the same decisions, whatever order and batches snapshots come in."""

import random
from datetime import datetime, timedelta

import pytest

from lodestream.streaming import changes

T0 = datetime(2024, 3, 1)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def at(minutes):
    return T0 + timedelta(minutes=minutes)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    yield spark
    spark.conf.set(name, before) if before else spark.conf.unset(name)


def told(df):
    return sorted(repr((r["id"], r["at"], r["decision"], r["attempts"], r["until"], r["size"], r["path"])) for r in df.collect())


def streamed(spark, tmp_path, batches, **options):
    for b in batches:
        spark.createDataFrame(b, changes.SNAPSHOT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(changes.SNAPSHOT).parquet(str(tmp_path / "in"))
        out = changes.watched(stream, **options).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
        out.trigger(availableNow=True).start().awaitTermination(200)
    return spark.read.parquet(str(tmp_path / "out"))


def test_parked_files_wait_and_wake_without_new_input(rocks, tmp_path):
    waits = [changes.wait("s", "f", k) for k in range(1, 10)]
    assert all(timedelta(minutes=min(2**k, 60)) * 7 / 8 <= w <= timedelta(minutes=min(2**k, 60)) for k, w in enumerate(waits, 1))
    rows = [("s", "f", at(0), "p", 5, "h", None), ("s", "f", at(1), "p", 6, "h2", "locked"), ("s", "f", at(2), "p", 6, "h2", None)]
    clock = lambda m: [("s", "clock", at(m), "c", 1, "h", None)]
    # The second batch holds nothing of the file: the clock's row alone moves the watermark past its waiting time.
    got = streamed(rocks, tmp_path, [rows + clock(2), clock(30), clock(60)], late="0 seconds")
    mine = [(r["at"], r["decision"], r["attempts"]) for r in got.filter("id = 'f'").orderBy("at").collect()]
    assert mine == [(at(0), "new", 0), (at(1), "parked", 1), (at(2), "skipped", 1), (at(1) + changes.wait("s", "f", 1), "due", 1)]


def test_a_new_snapshot_of_a_series_does_not_wait(spark):
    rows = [("s", "f", at(0), "p1", 5, "h", "locked"), ("s", "f", at(0.5), "p1", 5, "h", None), ("s", "f", at(0.6), "p2", 4, "g", None), ("s", "f", at(1), "p2", 3, "i", None), ("s", "f", at(2), "p2", 3, "j", "gone"), ("s", "f", at(9), "p2", 3, "j", "gone")]
    got = changes.decided(spark.createDataFrame(rows, changes.SNAPSHOT), at(200), forget=timedelta(hours=1)).orderBy("at").collect()
    second = at(9) + changes.wait("s", "f", 2)
    assert [(r["at"], r["decision"]) for r in got] == [
        (at(0), "parked"), (at(0.5), "skipped"), (at(0.6), "new"), (at(1), "shrunk"), (at(2), "parked"), (at(2) + changes.wait("s", "f", 1), "due"), (at(9), "parked"), (second, "due"), (at(61), "forgotten"),
    ]


def test_stream_and_table_agree_on_shuffled_and_split_input(rocks, tmp_path):
    rng = random.Random(4)
    rows = []
    for k in range(240):
        name = f"f{rng.randrange(5)}"
        error = "locked" if rng.random() < 0.25 else None
        rows.append(("s", name, at(k // 2 + rng.random()), f"{name}/{rng.randrange(2)}" if name == "f0" else name, rng.randrange(4), f"h{rng.randrange(3)}", error))
    # Files that are seen early only, so that they are forgotten without input of their own.
    rows += [("s", f"once{k}", at(3 + k), "p", k, None, None) for k in range(4)]
    rows.sort(key=lambda r: r[2] + timedelta(minutes=rng.uniform(0, 14)))
    batches = [rows[i : i + 61] for i in range(0, len(rows), 61)] + [[("s", "clock", at(400), "c", 1, "h", None)]]
    got = streamed(rocks, tmp_path, batches, late="15 minutes", forget=timedelta(minutes=50))
    table = rocks.createDataFrame([r for b in batches for r in b], changes.SNAPSHOT)
    want = changes.decided(table, at(385), forget=timedelta(minutes=50))
    shuffled = changes.decided(rocks.createDataFrame(rng.sample(rows, len(rows)), changes.SNAPSHOT), at(385), forget=timedelta(minutes=50))
    assert told(got) == told(want) == told(shuffled)
    assert {r["decision"] for r in want.collect()} == {"new", "unchanged", "changed", "shrunk", "parked", "skipped", "due", "forgotten"}


def test_null_fields_and_no_rows(spark):
    rows = [("s", "f", at(0), None, None, None, None), ("s", "f", at(1), None, None, None, None), ("s", "f", at(2), None, 3, None, None)]
    got = changes.decided(spark.createDataFrame(rows, changes.SNAPSHOT), at(9)).orderBy("at").collect()
    assert [r["decision"] for r in got] == ["new", "unchanged", "changed"]
    assert changes.decided(spark.createDataFrame([], changes.SNAPSHOT), at(9)).count() == 0
