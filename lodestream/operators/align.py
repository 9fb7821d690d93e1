"""Ordered alignment of transcripts with a side store, tool names, and text overlap joins."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.sources.shared import new_path

#: Store rows that are looked at from the place on and before it, and characters at which two texts may begin alike.
AHEAD, BEHIND, PREFIX = 16, 64, 64
#: Characters from which an argument's value says something, and from which it says much.
TELLING, LONG = 4, 32
#: What a pair of block and row shows, the less the earlier.
AGAINST, WEAK, NEUTRAL, PARTIAL, FOR = range(5)

# Fields of stored arguments that say nothing, and of given ones; names that one tool has on both sides.
STORED_NOISE = frozenset({"toolCallId", "parsingResult", "requestedSandboxPolicy", "commandDescription", "cwd"})
GIVEN_NOISE = frozenset({"working_directory", "cwd", "description", "explanation"})
ALIASES = {"shell": ("runterminalcommandv2", "runterminalcmd"), "strreplace": ("editfilev2", "searchreplace"), "write": ("editfilev2", "writefile", "createfilev2")}

STORE = ("pos", "role", "text", "tool", "args")
_STAMP = re.compile(r"<timestamp>.*?(?:</timestamp>|\Z)", re.S)
_QUERY = re.compile(r"<user_query>(.*?)</user_query>", re.S)


def plain(text: str | None) -> str:
    """A text without time stamps and query tags, with line feeds alone, trimmed. An open query tag cuts it."""
    bare = _QUERY.sub(r"\1", _STAMP.sub("", text or ""))
    return bare.split("<user_query>", 1)[0].replace("\r\n", "\n").strip()


def overlaps(a: str, b: str) -> bool:
    """Whether one plain text holds the other, or both begin alike for 64 characters (the shorter one's, if it has fewer)."""
    return bool(a and b) and (a in b or b in a or a[: min(len(a), len(b), PREFIX)] == b[: min(len(a), len(b), PREFIX)])


def bare_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]", "")


def names_match(shown: Column, stored: Column) -> Column:
    """Whether two tools may be one: a name is missing or holds the other, is its alias, or both call other servers' tools."""
    a, b = bare_name(shown), bare_name(stored)
    known = reduce(lambda x, y: x | y, [(a == k) & b.isin(*v) for k, v in ALIASES.items()])
    return (a == "") | (b == "") | F.contains(a, b) | F.contains(b, a) | ((a == "callmcptool") & F.startswith(b, F.lit("mcp"))) | known


def _names_match(shown: str | None, stored: str | None) -> bool:
    a, b = (re.sub("[^a-z0-9]", "", (x or "").lower()) for x in (shown, stored))
    return a in b or b in a or (a == "callmcptool" and b.startswith("mcp")) or b in ALIASES.get(a, ())


def _leaves(value: object, skip: frozenset[str]) -> Iterator[tuple[str, bool]]:
    """(value, whether it says something) of the texts and numbers in a JSON value."""
    if isinstance(value, str):
        if value:
            yield value, len(value) >= TELLING
    elif isinstance(value, bool) or value is None:
        return
    elif isinstance(value, int | float):
        yield f"{value:g}", False
    else:
        for x in value if isinstance(value, list) else (v for k, v in sorted(value.items()) if k not in skip):
            yield from _leaves(x, skip)


@lru_cache(maxsize=4096)
def _stored(stored: str) -> tuple[tuple[tuple[str, bool], ...], frozenset[str], bool]:
    """The leaves of stored arguments, their values, and whether they could be read."""
    try:
        kept = tuple(_leaves(json.loads(stored, parse_int=float), STORED_NOISE))
    except ValueError:
        return (), frozenset(), False
    return kept, frozenset(v for v, _ in kept), True


@lru_cache(maxsize=64)
def _given(given: str) -> tuple[tuple[str, bool], ...] | None:
    """The leaves of a call's arguments; None if they aren't an object."""
    try:
        asked = json.loads(given, parse_int=float)
    except ValueError:
        return None
    return tuple(_leaves(asked, GIVEN_NOISE)) if isinstance(asked, dict) else None


def arguments(given: str | None, stored: str | None) -> tuple[int, int]:
    """What the arguments of a call show against those stored, and how many telling values are the same."""
    if not given or (stored or "").strip() in ("", "{}", "null"):
        return NEUTRAL, 0
    kept, have, read = _stored(stored)
    if read and not any(telling for _, telling in kept):
        return NEUTRAL, 0
    values = _given(given)
    if values is None:
        return (FOR, 1) if not read and given in stored else (AGAINST, 0)
    telling = [v for v, says in values if says]
    same = [v for v in telling if v in have or (not read and len(v) >= LONG and (v in stored or json.dumps(v, ensure_ascii=False)[1:-1] in stored))]
    if not telling:
        return NEUTRAL, 0
    unexplained = read and any(v not in have for v, says in values if not says)
    if same and ((len(same) == len(telling) and not unexplained) or not read):
        return FOR, len(same)
    if not same:
        return AGAINST, 0
    return (PARTIAL if any(len(v) >= LONG for v in same) else WEAK), len(same)


class _Store:
    """A conversation's store rows, what became of each, and the place that the walk has reached."""

    def __init__(self, rows: list[dict]):
        self.rows, self.place = rows, 0
        self.taken: dict[int, tuple[int, int]] = {}
        self.declined: set[int] = set()
        # Which rows' arguments hold a value, and which can't be read: only those can speak for a call.
        self.holding: dict[str, list[int]] = {}
        self.unread: list[int] = []
        for i, row in enumerate(rows):
            if row["tool"] is not None and row["args"]:
                _, have, read = _stored(row["args"])
                if not read:
                    self.unread.append(i)
                for v in have:
                    self.holding.setdefault(v, []).append(i)

    def asked(self, block: dict) -> list[int]:
        """The rows, in order, that share a telling value with a call, or can't be read."""
        values = _given(block["input"]) if block["input"] else ()
        found = {i for v, says in values or () if says for i in self.holding.get(v, ())}
        return sorted(found.union(self.unread))

    def weigh(self, block: dict, row: dict) -> tuple[int, int]:
        if row["role"] and row["role"] != block["role"]:
            return AGAINST, 0
        if block["name"] is not None or block["input"] is not None:
            return arguments(block["input"], row["args"]) if row["tool"] is not None else (AGAINST, 0)
        if row["tool"] is not None:
            return AGAINST, 0
        a, b = plain(block["text"]), row["plain"]
        if overlaps(a, b):
            return FOR, 1
        return (NEUTRAL, 0) if not (a and b) else (AGAINST, 0)

    def find(self, block: dict) -> tuple[int | None, str]:
        """The row that a block takes, and ``matched``, ``repeat``, ``ambiguous`` or ``none``."""
        tool = block["name"] is not None or block["input"] is not None
        free = lambda i: i not in self.taken and i not in self.declined
        shown = lambda i: (i, *self.weigh(block, self.rows[i]), not tool or _names_match(block["name"], self.rows[i]["tool"]))
        ahead = [shown(i) for i in range(self.place, min(len(self.rows), self.place + AHEAD)) if i not in self.declined]
        behind = [shown(i) for i in range(self.place - 1, max(-1, self.place - BEHIND - 1), -1) if free(i)]
        for side in (ahead, behind):  # what speaks for a row wins, the most first, then the nearest
            sure = [x for x in side if x[1] == FOR]
            if sure:
                return self._take(*max(sure, key=lambda x: x[2])[:3])
        if not tool:
            behind = []
        rest = self._rest(ahead, behind)
        able = self.asked(block) if tool else []
        again = [self.taken[i] for i in able if i in self.taken and i < self.place and self.taken[i][0] >= PARTIAL and self.weigh(block, self.rows[i]) == self.taken[i]]
        if again:
            if any(free(i) and self.weigh(block, self.rows[i])[0] == FOR for i in able):
                return None, "none"
            if rest and rest[1] == NEUTRAL:
                self.declined.add(rest[0])
                return None, "ambiguous"
            if not rest or rest[1:] < max(again):
                return None, "repeat"
        return self._take(*rest) if rest else (None, "none")

    @staticmethod
    def _rest(ahead: list, behind: list) -> tuple[int, int, int] | None:
        """Of rows that nothing speaks for: a lone partial one, else the nearest ahead, then behind, then those of weak evidence; names must match but for partial ones."""
        partial = [x for x in [*ahead, *behind] if x[1] == PARTIAL]
        if len(partial) == 1:
            return partial[0][:3]
        for levels in ((PARTIAL, NEUTRAL), (WEAK,)):
            for side in (ahead, behind):
                for x in side:
                    if x[1] in levels and (x[1] == PARTIAL or x[3]):
                        return x[:3]
        return None

    def _take(self, i: int, ev: int, n: int) -> tuple[int, str]:
        self.taken[i] = (ev, n)
        self.place = max(self.place, i + 1)
        return i, "matched"


def _align(blocks: pd.DataFrame, store: pd.DataFrame) -> pd.DataFrame:
    if blocks.empty:
        return pd.DataFrame({"conv_id": [], "turn": [], "store_row": [], "status": []})
    store = store.rename(columns={f"store_{c}": c for c in STORE})
    if store.empty:  # it may have no columns then
        store = pd.DataFrame({c: [] for c in STORE})
    blocks, store = blocks.sort_values("turn"), store.sort_values(["pos", "role", "text"])
    read = lambda df, names: [dict(zip(names, (None if pd.isna(v) else v for v in r), strict=True)) for r in df[names].itertuples(index=False)]
    held = _Store([r | {"plain": plain(r["text"])} for r in read(store, ["role", "text", "tool", "args"])])
    out = []
    for b in read(blocks, ["role", "text", "name", "input"]):
        withheld = (b["text"] or "").strip() == "[REDACTED]"
        out.append((None, "skipped") if withheld else held.find(b))
    last = max((k for k, (_, s) in enumerate(out) if s == "matched"), default=None)
    status = [("tail" if last is not None and k > last else "mismatch") if s == "none" else s for k, (_, s) in enumerate(out)]
    return pd.DataFrame({"conv_id": blocks["conv_id"].to_numpy(), "turn": blocks["turn"].to_numpy(), "store_row": pd.array([i for i, _ in out], dtype="Int64"), "status": status})


def align(blocks: DataFrame, store: DataFrame) -> DataFrame:
    """(conv_id, turn, store_row, status) of ``blocks`` (conv_id, turn, role, text, and for tool calls name, input) against ``store`` (conv_id, pos, role, text, and tool, args).

    A block takes the row that speaks most for it, of the 16 from the place on, then of
    the 64 before it; failing that a row that nothing speaks against. The place moves
    past each row taken, never back. A call that shows the same as one matched before
    is a ``repeat``; one that could as well be a row without arguments is ``ambiguous``,
    and neither takes a row. A block without a row is ``tail`` after the last match of
    its conversation, else ``mismatch``; withheld reasoning is ``skipped``. The walk is
    by its nature one of each conversation, which meets in one task.
    """
    empty = lambda df, names: df.select("*", *(F.lit(None).cast("string").alias(c) for c in names if c not in df.columns))
    # New names: columns that both sides take from one table would be one column, and pruned with the other.
    side = empty(store, ["tool", "args"]).select(F.col("conv_id").alias("store_conv"), *(F.col(c).alias(f"store_{c}") for c in STORE))
    both = empty(blocks, ["name", "input"]).groupBy("conv_id").cogroup(side.groupBy("store_conv"))
    kind = blocks.schema["conv_id"].dataType.simpleString()
    return both.applyInPandas(lambda a, b: _align(a, b), f"conv_id {kind}, turn bigint, store_row bigint, status string")


def scaffolding(tool: Column, reasoning: Column, step: Column, capability: Column, text: Column) -> Column:
    """Whether a store row only holds the conversation together: no tool, no reasoning, and a step, a capability, or no text."""
    none = lambda c: F.coalesce(c, F.lit("")) == ""
    return none(tool) & none(reasoning) & (F.coalesce(step, F.lit(False)) | ~none(capability) | none(text))


def ordered_rows(headers: DataFrame, inline: DataFrame, rows: DataFrame) -> DataFrame:
    """(conv_id, row_id, place): a conversation's rows as its headers list them, gaps left out; without any, as its own list has them; else by time.

    ``headers`` and ``inline`` have (conv_id, pos, row_id), ``rows`` (conv_id, row_id, created).
    """
    listed = headers.join(rows.select("conv_id", "row_id"), ["conv_id", "row_id"]).select("conv_id", "row_id", F.lit(0).alias("tier"), F.col("pos").cast("string").alias("at"), F.col("pos").alias("n"))
    own = inline.select("conv_id", "row_id", F.lit(1).alias("tier"), F.lit("").alias("at"), F.col("pos").alias("n"))
    timed = rows.select("conv_id", "row_id", F.lit(2).alias("tier"), F.coalesce(F.col("created").cast("string"), F.lit("")).alias("at"), F.lit(0).cast("bigint").alias("n"))
    both = listed.withColumn("at", F.lit("")).unionByName(own).unionByName(timed)
    best = both.groupBy("conv_id").agg(F.min("tier").alias("tier"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("at", "n", "row_id"))
    return both.join(best, ["conv_id", "tier"]).select("conv_id", "row_id", place.cast("bigint").alias("place"))


def holding(items: DataFrame, turns: DataFrame, key: int = 16) -> DataFrame:
    """(item_id, conv_id, turn): turns and items of which one holds the other's whole plain text, or that begin alike for 64 characters.

    Texts go by a digest; what is joined first are hashes of stretches. Of each few
    neighbouring stretches the one of the least hash is taken (``_cut``), so a text that
    holds another also has all that were taken of the other. Of some of these, spread
    over the other text, the one that occurs in the fewest texts is looked for; if one
    occurs nowhere, nothing is. A common beginning is so no hot key. Stretches have
    ``key`` characters in texts that are longer by four, and fewer in shorter texts; the
    shortest are looked for whole, by length. Digests that met are confirmed on the
    whole texts.
    """
    a = items.select("item_id", _plain(F.col("text")).alias("text")).filter("text <> ''").withColumn("id", F.md5("text"))
    b = turns.select("conv_id", "turn", _plain(F.col("text")).alias("text")).filter("text <> ''").withColumn("id", F.md5("text"))
    one, two = (side.select("id", "text").dropDuplicates(["id"]) for side in (a, b))
    pairs = _holds(one, two, key).select(F.col("small").alias("a"), F.col("large").alias("b")).unionByName(_holds(two, one, key).select(F.col("large").alias("a"), F.col("small").alias("b")))
    begins = lambda side, name: side.filter(F.length("text") >= PREFIX).select(F.col("id").alias(name), F.md5(F.left("text", F.lit(PREFIX))).alias("k"))
    alike = begins(one, "a").join(begins(two, "b"), "k").select("a", "b")
    found = pairs.unionByName(alike).distinct()
    return found.join(a.select(F.col("id").alias("a"), "item_id"), "a").join(b.select(F.col("id").alias("b"), "conv_id", "turn"), "b").select("item_id", "conv_id", "turn")


def _plain(text: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)<timestamp>.*?(?:</timestamp>|\z)", ""), r"(?s)<user_query>(.*?)</user_query>", "$1")
    return F.regexp_replace(F.replace(F.substring_index(bare, "<user_query>", 1), F.lit("\r\n"), F.lit("\n")), r"^\s+|\s+$", "")


#: Stretches of a text that are looked for in others.
ANCHORS = 8
#: An odd base of the rolled hash, and what undoes it, both modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_UNDO = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), dtype=np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


def _stretches(text: str, n: int, rolled: np.ndarray, undo: np.ndarray) -> np.ndarray:
    """A hash of each stretch of ``n`` characters, from the running sums of the whole text."""
    count = len(text) - n + 1
    h = (rolled[n:] - rolled[:count]) * undo[:count] + np.uint64(n)
    h ^= h >> np.uint64(32)
    return (h * np.uint64(_BASE)).view(np.int64)


def _rolled(text: str) -> tuple[np.ndarray, np.ndarray]:
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
    return np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(letters * _powers(_BASE, len(letters)), dtype=np.uint64)]), _powers(_UNDO, len(letters))


def _cut(n: int, key: int) -> tuple[int, int]:
    """How long the stretches are by which a text of ``n`` characters is looked for, and of how many neighbours one is taken."""
    if n >= key + 4:
        return key, 5
    if n >= key:
        return key - 2, 3
    return (key - 4, 1) if n >= key - 4 else (n, 1)


def _taken(text: str, n: int, neighbours: int, rolled: np.ndarray, undo: np.ndarray) -> np.ndarray:
    """Of each so many neighbouring stretches of ``n`` characters the least hash; none if the text has fewer."""
    h = _stretches(text, n, rolled, undo) if n <= len(text) else np.empty(0, dtype=np.int64)
    count = len(h) - neighbours + 1
    return np.minimum.reduce([h[i : i + count] for i in range(neighbours)]) if count > 0 else h[:0]


#: Hashes in one Arrow batch that a task hands back.
HASHES = 100_000


def _places(cuts: list[tuple[int, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The distinct hashes that are taken of each text, for all ``cuts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda names, found: pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(names, dtype=np.int64), [len(h) for h in found])), pa.array(np.concatenate(found))], names=["large", "h"])
        for batch in batches:
            names, found, held = [], [], 0
            for name, text in zip(batch.column("large").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rolled, undo = _rolled(text)
                found.append(np.unique(np.concatenate([_taken(text, *cut, rolled, undo) for cut in cuts])))
                names.append(name)
                held += len(found[-1])
                if held >= HASHES:
                    yield made(names, found)
                    names, found, held = [], [], 0
            if names:
                yield made(names, found)

    return run


def _anchors(key: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Some of the hashes that are taken of each text, spread over it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                h = _taken(text, *_cut(len(text), key), *_rolled(text))
                rows += [(name, int(h[at])) for at in sorted({int(x) for x in np.linspace(0, len(h) - 1, ANCHORS)})]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int64()))], names=["small", "h"])

    return run


def _holds(small: DataFrame, large: DataFrame, key: int) -> DataFrame:
    """(small, large): digests of texts of which ``large`` (id, text) holds ``small`` (id, text)."""
    sizes = [r[0] for r in small.select(F.least(F.length("text"), F.lit(key + 4)).alias("n")).distinct().collect()]  # a few numbers
    cuts = sorted({_cut(n, key) for n in sizes})
    if not cuts:
        return small.select(F.col("id").alias("small"), F.col("id").alias("large"))
    # Two texts under one number are both looked at.
    large = large.select(F.xxhash64("id").alias("large"), "id", "text")
    asked = small.select("id", "text").mapInArrow(_anchors(key), "small string, h bigint").distinct()
    placed = large.select("large", "text").mapInArrow(_places(cuts), "large bigint, h bigint").join(asked.select("h").distinct(), "h", "left_semi")
    # Read twice, and the hashes of all texts are shuffled once.
    path = new_path(small.sparkSession, "stretches")
    placed.write.parquet(path)
    placed = small.sparkSession.read.schema(placed.schema).parquet(path)
    counted = asked.join(placed.groupBy("h").agg(F.count("*").alias("often")), "h", "left").groupBy("small").agg(F.min(F.struct(F.coalesce("often", F.lit(0).cast("bigint")).alias("often"), "h")).alias("best"))
    rarest = counted.filter("best.often > 0").select("small", F.col("best.h").alias("h"))
    met = rarest.join(placed, "h").select("small", "large").distinct()
    texts = met.join(small.select(F.col("id").alias("small"), F.col("text").alias("s")), "small").join(large.select("large", "id", F.col("text").alias("t")), "large")
    return texts.filter(F.contains("t", F.col("s"))).select("small", F.col("id").alias("large"))
