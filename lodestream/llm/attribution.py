"""Token counts of fields and sections, from one encoding of the whole text.

A text is encoded once. Each token's span of characters meets the sections' spans
(an interval join of two sorted lists), and a token that crosses a boundary goes
whole to one section, by rule:

* ``most`` (the default): to the section that holds most of its characters, the
  earliest of several;
* ``first``: to the section that holds its first character.

So a text's counts add up to its number of tokens, which separate encodings of the
sections would not. Sections cover the text without gaps: ``bounds`` lists where
they begin (0 first). Without it they are the lines, each with its line break.

A character that several tokens share is in the span of each. Cases: a null text is
empty; an empty text has one empty section without tokens. Null or repeated ids are
rows of their own. An empty table gives no rows. Other columns, whatever their
names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.llm import tokenization as tk

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_WORD_END = "</w>"


class SpanMemo(dict):
    """Maps a word's UTF-8 bytes to the byte lengths of its tokens, one byte for each token."""

    def __init__(self, vocabulary: str):
        super().__init__()
        self.tokenizer = tk.load(vocabulary)

    def __missing__(self, word: bytes) -> bytes:
        found = self.tokenizer.encode(word.decode(), add_special_tokens=False)
        sizes = [len(t.removesuffix(_WORD_END)) for t in found.tokens]  # one letter of the vocabulary is one byte
        if sum(sizes) != len(word) or max(sizes, default=0) > 255:  # normalising changed the length: go by the tokenizer's offsets
            text = word.decode()
            starts = [len(text[:s].encode()) for s, _ in found.offsets] + [len(word)]
            sizes = [b - a for a, b in zip(starts, starts[1:], strict=False)]
            sizes[:1] = [sizes[0] + starts[0]] if sizes else []
            if max(sizes, default=0) > 255 or min(sizes, default=0) < 0:
                raise ValueError("a token of more than 255 bytes")
        self[word] = out = bytes(sizes)
        return out


class FastSpanMemo(SpanMemo):
    """As ``SpanMemo``, for simple words by the parts that ``tokenization.WordMemo`` encodes."""

    def __init__(self, vocabulary: str):
        super().__init__(vocabulary)
        self.model, self.letters, self.parts = self.tokenizer.model, tk._byte_letters(), {}
        self.held = self.parts_held = 0

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        simple = tk._SIMPLE.fullmatch(text) and "<|" not in text
        out = b"".join([self.parts.get(p) or self._part(p) for p in tk._PARTS.findall(text.lower())]) if simple else super().__missing__(word)
        self.held += len(word) + len(out) + tk.ENTRY_BYTES
        if self.held > tk.MEMO_BYTES:
            self.clear()
            self.held = 0
        self[word] = out
        return out

    def _part(self, part: str) -> bytes:
        spelled = part if part.isascii() else "".join([self.letters[b] for b in part.encode()])
        out = bytes([len(t.value.removesuffix(_WORD_END)) for t in self.model.tokenize(spelled)])
        self.parts_held += len(part) + len(out) + tk.ENTRY_BYTES
        if self.parts_held > tk.MEMO_BYTES:
            self.parts.clear()
            self.parts_held = 0
        self.parts[part] = out
        return out


_MEMOS: dict[str, FastSpanMemo] = {}


def token_spans(text: bytes, memo: SpanMemo) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last character of each token, and the place of each byte's character."""
    raw = np.frombuffer(text, dtype=np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    sizes = np.frombuffer(b"".join(map(memo.__getitem__, text.split())), dtype=np.uint8).astype(np.int64)
    place = np.flatnonzero(~_SPACE[raw])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    last = np.maximum(ends - 1, starts)  # a token of a shared character may have no byte of its own
    return char[place[np.minimum(starts, len(place) - 1)]], char[place[np.minimum(last, len(place) - 1)]], char


def line_bounds(text: bytes, char: np.ndarray) -> np.ndarray:
    """Where the lines begin."""
    breaks = char[np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 10)] + 1
    return np.concatenate([[0], breaks[breaks <= int(char[-1])]])


def allocate(first: np.ndarray, last: np.ndarray, bounds: np.ndarray, total: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and those of them that cross a boundary."""
    if rule not in ("most", "first"):
        raise ValueError(f"no rule {rule!r}")
    a = np.searchsorted(bounds, first, side="right") - 1
    b = np.searchsorted(bounds, last, side="right") - 1
    crossing = a != b
    if rule == "most":
        edges = np.append(bounds, total)
        for k in np.flatnonzero(crossing):
            held = [min(edges[s + 1], last[k] + 1) - max(edges[s], first[k]) for s in range(a[k], b[k] + 1)]
            a[k] += int(np.argmax(held))
    n = len(bounds)
    return np.bincount(a, minlength=n), np.bincount(a[crossing], minlength=n)


def _attribute(vocabulary: str, rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _MEMOS:
            _MEMOS[vocabulary] = FastSpanMemo(vocabulary)
        memo = _MEMOS[vocabulary]
        for b in batches:
            given = b.column("bounds").to_pylist()
            rows: list[int] = []
            parts: list[tuple[np.ndarray, ...]] = []
            texts = b.column("text").cast(pa.binary())
            for k, t in enumerate(texts):
                text = tk.as_utf8(t.as_py() or b"")
                if text:
                    first, last, char = token_spans(text, memo)
                    total = int(char[-1]) + 1
                else:
                    first = last = np.empty(0, dtype=np.int64)
                    char, total = first, 0
                bounds = np.array(given[k], dtype=np.int64) if given[k] is not None else line_bounds(text, char) if text else np.zeros(1, dtype=np.int64)
                n, crossing = allocate(first, last, bounds, total, rule)
                parts.append((np.arange(len(bounds)), bounds, np.append(bounds[1:], total), n, crossing))
                rows += [k] * len(bounds)
                if len(rows) > 100_000 or k + 1 == len(texts):
                    columns = [pa.array(np.concatenate(c), pa.int64()) for c in zip(*parts, strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows)), *columns], names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])
                    rows, parts = [], []

    return run


def section_tokens(docs: DataFrame, bounds: Column | None = None, *, rule: str = "most", vocabulary: str = tk.WORD_BPE) -> DataFrame:
    """``doc_id``, ``section``, ``start``, ``end``, ``n_tokens``, ``n_crossing`` for each section of each row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    given = F.lit(None).cast("array<int>") if bounds is None else bounds.cast("array<int>")
    return docs.select("doc_id", "text", given.alias("bounds")).mapInArrow(
        _attribute(vocabulary, rule), f"doc_id {kind}, section bigint, start bigint, end bigint, n_tokens bigint, n_crossing bigint"
    )


def field_tokens(docs: DataFrame, fields: list[str], *, separator: str = "\n", rule: str = "most", vocabulary: str = tk.WORD_BPE) -> DataFrame:
    """As ``section_tokens``, for records of several text fields: the fields, joined, are encoded as one text; ``section`` counts fields.

    A null field is empty. A separator belongs to the field before it.
    """
    parts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    whole = F.concat_ws(separator, *parts)
    starts, at = [F.lit(0)], F.lit(0)
    for p in parts[:-1]:
        at = at + F.length(p) + len(separator)
        starts.append(at)
    return section_tokens(docs.select("doc_id", whole.alias("text"), F.array(*starts).alias("starts")), F.col("starts"), rule=rule, vocabulary=vocabulary)
