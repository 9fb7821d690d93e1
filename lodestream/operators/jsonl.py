"""JSON Lines: strings with their paths, and redaction that leaves all other bytes as they are."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.functions.rules import TEXT_RULES, Rule
from lodestream.functions.scan import DROPPED, NAMED, Scanner, is_sentinel, scanner, sentinel

_TOKEN = re.compile(r'[ \t\r\n]*+(?:("[^"\\]*+(?:\\.[^"\\]*+)*+")|([{}\[\],:])|(-?\d[\d.eE+-]*)|true|false|null)', re.S)
#: Depth beyond which a text is no JSON for us; characters of a value's source from which a dropped field is dropped.
DEPTH, DROP_FROM = 256, 160
#: What a path shows where it goes on inside a string that holds a document.
INSIDE = "#json"

Edit = tuple[int, int, str]


def _refuse(constant: str) -> None:
    raise ValueError(constant)


def _is_json(text: str) -> bool:
    try:
        json.loads(text, parse_constant=_refuse, parse_int=str, parse_float=str)  # numbers may have any number of digits
    except (ValueError, RecursionError):
        return False
    return True


def joined(parent: str, key: str) -> str:
    return f"{parent}.{key}" if parent else key


class Walk:
    """One walk over a JSON text: finds its strings in order, and collects what is to be written in their place.

    Repeated keys and the order of members are kept, as no object is built.
    """

    def __init__(self, scan: Scanner, drops: frozenset[str] = frozenset(), exempt: frozenset[str] = frozenset()):
        self.scan, self.drops, self.exempt = scan, drops, exempt
        self.hits: Counter = Counter()
        self.redacted = 0

    def count(self, hits: Counter, size: int) -> None:
        self.hits.update(hits)
        self.redacted += size

    def document(self, text: str, path: str = "", depth: int = 0) -> str | None:
        """The text with its dirty strings rewritten; None if it isn't JSON, or too deep. ``path`` isn't empty inside another document."""
        inside = bool(path)
        if not _is_json(text):
            return None
        hits, redacted = self.hits.copy(), self.redacted
        edits: list[Edit] = []
        open_: list[list] = []  # [bracket, path of what it holds, key at hand as written, as it will be]
        at, before = 0, ""
        while m := _TOKEN.match(text, at):
            at = m.end()
            top = open_[-1] if open_ else None
            key, where = "", path
            if top is not None:
                key, where = (top[2], joined(top[1], top[3])) if top[0] == "{" else ("", top[1])
            if m[1] and top is not None and top[0] == "{" and before != ":":
                name = json.loads(m[1])
                top[2], top[3] = name, self._key(name, top[1])
                if top[3] != name:
                    edits.append((m.start(1), m.end(1), top[3]))
            elif m[1]:
                new = self._string(json.loads(m[1]), len(m[1]), key, where, depth + len(open_), inside)
                if new is not None:
                    edits.append((m.start(1), m.end(1), new))
            elif m[3] and inside:
                new = self._value(m[3], key, where)
                if new is not None:
                    edits.append((m.start(3), m.end(3), new))
            elif m[2] in ("{", "["):
                if depth + len(open_) >= DEPTH:
                    self.hits, self.redacted = hits, redacted
                    return None
                open_.append([m[2], where if m[2] == "{" else where + "[]", "", ""])
            elif m[2] in ("}", "]"):
                open_.pop()
            before = m[2] or ""
        out, done = [], 0
        for s, e, new in edits:
            out += [text[done:s], json.dumps(new, ensure_ascii=False)]
            done = e
        return "".join([*out, text[done:]])

    def _key(self, name: str, parent: str) -> str:
        free = joined(parent, name) in self.exempt or f"{parent}.*" in self.exempt
        new, hits, size = self.scan.applied(name, self.scan.spans(name, heuristics=not free))
        self.count(hits, size)
        return new

    def _value(self, text: str, key: str, path: str) -> str | None:
        """A value by the ladder: a secret's name takes it whole, then rules, random runs and the user's name. None if it stays."""
        if key and text and self.scan.names_secret(key) and not is_sentinel(text):
            self.count(Counter({NAMED: 1}), len(text.encode()))
            return sentinel(NAMED)
        new, hits, size = self.scan.applied(text, self.scan.spans(text, heuristics=path not in self.exempt))
        self.count(hits, size)
        return new if hits else None

    def _string(self, text: str, source: int, key: str, path: str, depth: int, inside: bool) -> str | None:
        if not inside and source >= DROP_FROM + 2 and path in self.drops and path not in self.exempt:
            self.count(Counter({DROPPED: 1}), len(text.encode()))
            return sentinel(DROPPED)
        named = key and self.scan.names_secret(key) and text and not is_sentinel(text)
        if not named and _looks_like(text) and not self.scan.key_and_value(text):
            new = self.document(text, path + INSIDE, depth + 1)
            if new is not None:
                return new if new != text else None
        new = self._value(text, key, path)
        if new is not None and _looks_like(new):
            again = self.document(new, path + INSIDE, depth + 1)
            return new if again is None else again
        return new

    def raw(self, text: str) -> str:
        """A text that is no JSON: rules and the user's name alone, for there is no path that could be exempt."""
        new, hits, size = self.scan.applied(text, self.scan.spans(text))
        self.count(hits, size)
        return new


def _looks_like(text: str) -> bool:
    return text.lstrip(" \t\r\n")[:1] in ("{", "[") if text else False


def scrub_line(line: str | None, scan: Scanner, drops: frozenset[str] = frozenset(), exempt: frozenset[str] = frozenset()) -> tuple[str | None, str, Counter, int]:
    """A line as it is to be, its mode (blank, decoded or raw), hits by rule, and bytes redacted. Line ends are no part of a line."""
    if line is None or not line.strip():
        return line, "blank", Counter(), 0
    walk = Walk(scan, drops, exempt)
    try:
        new = walk.document(line)
    except UnicodeEncodeError:  # a lone surrogate, which is no text
        new, walk = None, Walk(scan, drops, exempt)
    mode = "raw" if new is None else "decoded"
    return (walk.raw(line) if new is None else new), mode, walk.hits, walk.redacted


def scrub(
    lines: DataFrame, key: str, line: str, rules: tuple[Rule, ...] = TEXT_RULES, drops: tuple[str, ...] = (), exempt: tuple[str, ...] = (), user: str = ""
) -> DataFrame:
    """(key, line, mode, hits, redacted, rule_hits): every line with its dirty strings replaced, in one pass and without a shuffle.

    In a JSON line object keys, strings, and numbers inside embedded documents are
    scanned. The value of a secret's name goes whole; random-looking runs go unless
    their path is exempt (``parent.*`` exempts the keys of an object); a value at a
    path to drop goes whole from ``DROP_FROM`` characters on. A string that holds a
    document is walked as one, its paths marked ``#json``. A line that isn't JSON is
    scanned as raw text. Null and blank lines stay. An empty table gives no rows.
    """
    kind = lines.schema[key].dataType.simpleString()
    dropped, free = frozenset(drops), frozenset(exempt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(rules, user)
        for b in batches:
            out = [scrub_line(t, scan, dropped, free) for t in b.column("line").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("k"),
                    pa.array([x[0] for x in out], pa.string()),
                    pa.array([x[1] for x in out], pa.string()),
                    pa.array([sum(x[2].values()) for x in out], pa.int64()),
                    pa.array([x[3] for x in out], pa.int64()),
                    pa.array([sorted(x[2].items()) for x in out], pa.map_(pa.string(), pa.int64())),
                ],
                names=["k", "line", "mode", "hits", "redacted", "rule_hits"],
            )

    found = lines.select(F.col(key).alias("k"), F.col(line).alias("line")).mapInArrow(run, f"k {kind}, line string, mode string, hits bigint, redacted bigint, rule_hits map<string,bigint>")
    return found.select(F.col("k").alias(key), F.col("line").alias(line), "mode", "hits", "redacted", "rule_hits")


def scrub_by_source(lines: DataFrame, key: str, line: str, source: str, catalog: DataFrame, **options) -> DataFrame:
    """As ``scrub``, but lines of a source that ``catalog`` (source, scrub) declares not to be scrubbed stay as they are, in mode ``bypassed``. A source that it doesn't have, or says nothing of, is scrubbed."""
    free = catalog.groupBy("source").agg(F.bool_and(~F.coalesce("scrub", F.lit(True))).alias("_free")).filter("_free").select(F.col("source").alias("_source"))
    match = F.col(source) == F.col("_source")
    done = scrub(lines.join(free, match, "left_anti"), key, line, **options)
    kept = lines.join(free, match, "left_semi").select(key, line, F.lit("bypassed").alias("mode"), *(F.lit(0).cast("bigint").alias(c) for c in ("hits", "redacted")), F.create_map().cast("map<string,bigint>").alias("rule_hits"))
    return done.unionByName(kept)


def split_lines(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line, ending): the lines of whole texts with their endings (``\\n``, ``\\r\\n`` or none), so that they can be put together again."""
    cut = F.split(F.col(text), "(?<=\n)")
    lines = files.select(F.col(key), F.posexplode(F.filter(cut, lambda x: x != "")).alias("line_no", "whole"))
    ending = F.when(F.endswith("whole", F.lit("\r\n")), "\r\n").when(F.endswith("whole", F.lit("\n")), "\n").otherwise("")
    return lines.select(key, "line_no", F.left("whole", F.length("whole") - F.length(ending)).alias("line"), ending.alias("ending"))


def scan_modes(lines: DataFrame, key: str) -> DataFrame:
    """(key, lines_parsed, lines_raw, scan_mode) of scrubbed lines by file: ``decoded``, ``raw``, or ``mixed``."""
    raw, parsed = F.count_if(F.col("mode") == "raw"), F.count_if(F.col("mode") == "decoded")
    mode = F.when((F.col("lines_raw") > 0) & (F.col("lines_parsed") > 0), "mixed").when(F.col("lines_raw") > 0, "raw").otherwise("decoded")
    return lines.groupBy(key).agg(parsed.alias("lines_parsed"), raw.alias("lines_raw")).withColumn("scan_mode", mode)
