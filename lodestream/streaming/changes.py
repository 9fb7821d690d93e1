"""Change detection on a stream of file snapshots, with keyed state."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The first wait of a file that can't be read, doubled with each further attempt up to the longest one.
FIRST_WAIT, LONGEST_WAIT = timedelta(minutes=1), timedelta(hours=1)

SNAPSHOT = "source_id string, id string, at timestamp, path string, size bigint, hash string, error string"
DECISION = "source_id string, id string, at timestamp, path string, size bigint, hash string, decision string, attempts int, until timestamp"
_EVENT = "at timestamp, path string, size bigint, hash string, error string"
_FIELDS = ("at", "path", "size", "hash", "error")
_KNOWN = "path string, size bigint, hash string, seen timestamp"
_PARKED = "path string, attempts int, until timestamp, waiting boolean"


def _decide(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    was = state.get if state.exists else None
    whole = pd.concat(list(parts)).sort_values(["mtime", "size", "hash"])
    rows = []
    for r in whole.itertuples():
        decision = "new" if was is None else "unchanged" if was == (r.size, r.hash) else "shrunk" if r.size < was[0] else "changed"
        was = (int(r.size), r.hash)
        rows.append((*key, int(r.size), r.hash, decision))
    yield pd.DataFrame(rows, columns=["source_id", "id", "size", "hash", "decision"])
    if was is not None:
        state.update(was)


def decisions(snapshots: DataFrame) -> DataFrame:
    """(source_id, id, size, hash, decision) of a stream of (source_id, id, size, hash, mtime). State is the last size and hash of each key.

    A key's rows of one batch are put in order of ``mtime``; those of a later batch count
    as later. ``watched`` also orders rows across batches.
    """
    return snapshots.groupBy("source_id", "id").applyInPandasWithState(
        _decide, "source_id string, id string, size bigint, hash string, decision string", "size bigint, hash string", "append", GroupStateTimeout.NoTimeout
    )


def wait(source_id: str, file_id: str, attempts: int) -> timedelta:
    """How long a file waits: doubled by attempt, capped, and up to an eighth less by its key, so that those that failed together don't wake together."""
    whole = min(FIRST_WAIT * 2 ** min(attempts, 8), LONGEST_WAIT)
    return whole - whole * (zlib.crc32(f"{source_id}\0{file_id}".encode()) % 9) / 64


@dataclass
class Watch:
    """What is remembered of a file: what was last read of it, and whether it waits for another attempt."""

    source_id: str
    file_id: str
    forget: timedelta | None
    known: tuple | None = None  # path, size, hash, when seen
    parked: tuple | None = None  # path, attempts, until, whether it hasn't been woken yet

    def row(self, at: datetime, path: str | None, size: int | None, hash_: str | None, decision: str) -> tuple:
        attempts, until = (self.parked[1], self.parked[2]) if self.parked else (0, None)
        return self.source_id, self.file_id, at, path, size, hash_, decision, attempts, until

    def timers(self) -> list[datetime]:
        """When something happens to the file without a snapshot of it."""
        due = [self.parked[2]] if self.parked and self.parked[3] else []
        return due + ([self.known[3] + self.forget] if self.known and self.forget else [])

    def until(self, now: datetime) -> list[tuple]:
        """What happens without a snapshot up to and with ``now``: a parked file is due, one not seen for long is forgotten."""
        out = []
        while times := [t for t in self.timers() if t <= now]:
            at = min(times)
            if self.parked and self.parked[3] and self.parked[2] == at:
                self.parked = (*self.parked[:3], False)
                out.append(self.row(at, self.parked[0], None, None, "due"))
            else:
                out.append(self.row(at, self.known[0], None, None, "forgotten"))
                self.known = None
        return out

    def see(self, at: datetime, path: str | None, size: int | None, hash_: str | None, error: str | None) -> tuple:
        """What is done about a snapshot.

        A parked file is skipped before its time, unless the snapshot is another one of
        its series (another path). One that couldn't be read is parked, and so long as it
        can't be, waits longer; there is no last attempt.
        """
        if self.parked and at < self.parked[2] and path == self.parked[0]:
            return self.row(at, path, size, hash_, "skipped")
        if error is not None:
            attempts = (self.parked[1] if self.parked else 0) + 1
            self.parked = (path, attempts, at + wait(self.source_id, self.file_id, attempts), True)
            return self.row(at, path, size, hash_, "parked")
        was, self.known, self.parked = self.known, (path, size, hash_, at), None
        decision = "new" if was is None else "unchanged" if was[1:3] == (size, hash_) else "shrunk" if (size or 0) < (was[1] or 0) else "changed"
        return self.row(at, path, size, hash_, decision)

    def walk(self, events: list[tuple], now: datetime) -> list[tuple]:
        """All decisions up to ``now``, in order of time."""
        out = []
        for e in events:
            out += [*self.until(e[0]), self.see(*e)]
        return out + self.until(now)


def _plain(value: object) -> object:
    """A value of a row as Python's own, times without a zone and in UTC."""
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, datetime):
        value = value.to_pydatetime() if isinstance(value, pd.Timestamp) else value
        return value.astimezone(timezone.utc).replace(tzinfo=None) if value.tzinfo else value
    return value.item() if hasattr(value, "item") else value


def _in_order(events: list[tuple]) -> list[tuple]:
    return sorted(events, key=lambda e: tuple((x is not None, x if x is not None else 0) for x in e))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["source_id", "id", "at", "path", "size", "hash", "decision", "attempts", "until"])
    return out.astype({"size": "Int64", "attempts": "int32", "at": "datetime64[us]", "until": "datetime64[us]"})


def _ms(at: datetime) -> int:
    """The first whole millisecond not before ``at``."""
    gap = at - datetime(1970, 1, 1)
    return -(-(gap // timedelta(microseconds=1)) // 1000)


class Watcher(StatefulProcessor):
    """Snapshots wait in state until the watermark has passed them; then they are decided in order of time, whatever batches they came in."""

    def __init__(self, forget: timedelta | None) -> None:
        self.forget = forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _EVENT)
        self.known = handle.getValueState("known", _KNOWN)
        self.parked = handle.getValueState("parked", _PARKED)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        for part in rows:
            events = [tuple(map(_plain, r)) for r in part[list(_FIELDS)].itertuples(index=False)]
            if events:
                self.waiting.appendList(events)
                for at in {_ms(e[0]) for e in events}:
                    self.handle.registerTimer(at)
        yield _frame([])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = datetime(1970, 1, 1) + timedelta(milliseconds=timerValues.getCurrentWatermarkInMs())
        held = [tuple(map(_plain, e)) for e in self.waiting.get()] if self.waiting.exists() else []
        ready, later = _in_order([e for e in held if e[0] <= now]), [e for e in held if e[0] > now]
        watch = Watch(key[0], key[1], self.forget, *(tuple(map(_plain, s.get())) if s.exists() else None for s in (self.known, self.parked)))
        before = set(watch.timers())
        out = watch.walk(ready, now)
        if ready:
            self.waiting.put(later) if later else self.waiting.clear()
        for state, value in ((self.known, watch.known), (self.parked, watch.parked)):
            state.update(value) if value is not None else state.clear()
        for at in set(watch.timers()) - before:
            self.handle.registerTimer(_ms(at))
        yield _frame(out)

    def close(self) -> None:
        return


def watched(snapshots: DataFrame, late: str = "10 minutes", forget: timedelta | None = None) -> DataFrame:
    """What is done about each of a stream of snapshots (``SNAPSHOT``), and what happens to files in between (``DECISION``).

    Snapshots may come up to ``late`` after later ones, in any order and any batches: a
    key's are decided in order of time once the watermark has passed them. Timers wake
    parked files (``due``), and drop what is known of a file not read for ``forget``
    (``forgotten``), whether or not snapshots of that file come. ``error`` says why a
    file couldn't be read. Needs the RocksDB state store.
    """
    keyed = snapshots.withWatermark("at", late).groupBy("source_id", "id")
    return keyed.transformWithStateInPandas(Watcher(forget), DECISION, "append", "eventTime")


def decided(snapshots: DataFrame, now: datetime, forget: timedelta | None = None) -> DataFrame:
    """The same as ``watched`` of a table of snapshots, as if the watermark stood at ``now``."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        events = [tuple(map(_plain, r)) for r in rows[list(_FIELDS)].itertuples(index=False)]
        return _frame(Watch(key[0], key[1], forget).walk(_in_order(events), now))

    return snapshots.filter(F.col("at") <= F.lit(now.replace(tzinfo=timezone.utc))).groupBy("source_id", "id").applyInPandas(run, DECISION)


def settled_days(events: DataFrame, late: str = "24 hours") -> DataFrame:
    """Counts of each day, given out once no event of it can be later than ``late``."""
    w = F.window("ts", "1 day")
    return events.withWatermark("ts", late).groupBy(w.alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "n")
