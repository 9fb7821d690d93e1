"""Fill-in-middle by select on words of 64 bits: a text's units are counted and found in its UTF-8 as uint64.

A text is cut into units, ``[A-Za-z]+|[^A-Za-z]`` over code points. Eight bytes of its
UTF-8 are one word. Masks of a bit for each byte (letters, continuation bytes) come
from additions that can't carry into the next byte; from them follows which bytes end
a unit. ``bitwise_count`` gives a word's ends, their running sum is searched for the
word that holds the k-th one, and prefix sums inside that word, by one multiplication,
give its byte. A batch's texts lie in one buffer and are worked on together, some
``SLICE`` bytes at a time; a longer text is a slice of its own.

Where the cuts fall, and the form, come from the SHA-256 of the seed and ``doc_id``
alone, so that a task that runs again gives the same rows.

Cases: a null text is empty, and an empty text is plain. A null id counts as an empty
one. Repeated rows give equal rows. A text that holds one of the marks is plain, so
that every other output can be read back. Bytes that aren't UTF-8 are carried as they
are; a stray continuation byte belongs to the unit before it. An empty table gives no
rows. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.llm.worker import giving_back

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
#: Of a hundred documents, those that are left as they are, and of the others those whose suffix comes first.
PLAIN, SUFFIX_FIRST = 10, 20
#: Bytes of texts that are looked at together.
SLICE = 2 << 20

_U = np.uint64
_LOW, _HIGH = _U(0x0101010101010101), _U(0x8080808080808080)
_SEVEN = ~_HIGH
_CASE = _U(0x2020202020202020)


def letter_marks(words: np.ndarray) -> np.ndarray:
    """The high bit of each byte that is an ASCII letter."""
    small = (words & _SEVEN) | _CASE
    return (small + _LOW * _U(0x80 - ord("a"))) & ~(small + _LOW * _U(0x7F - ord("z"))) & ~words & _HIGH


def continued_marks(words: np.ndarray) -> np.ndarray:
    """The high bit of each byte of the form 10xxxxxx."""
    return words & ~(words << _U(1)) & _HIGH


def _following(marks: np.ndarray) -> np.ndarray:
    """At each byte the mark of the next one."""
    after = marks >> _U(8)
    after[:-1] |= marks[1:] << _U(56)
    return after


class Places:
    """Marked bytes of a buffer, to be counted and found."""

    def __init__(self, marks: np.ndarray) -> None:
        self.marks = marks
        self.until = np.cumsum(np.bitwise_count(marks), dtype=np.int64)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many marked bytes come before each place."""
        word, byte = at >> 3, (at & 7).astype(_U)
        before = np.where(word > 0, self.until[word - 1], 0)
        inside = self.marks[np.minimum(word, len(self.marks) - 1)] & ((_U(1) << byte * _U(8)) - _U(1))
        return before + np.where(byte > 0, np.bitwise_count(inside), 0)

    def after(self, k: np.ndarray) -> np.ndarray:
        """The place behind the k-th marked byte, for k from 1."""
        word = np.searchsorted(self.until, k)
        own = self.marks[word] >> _U(7)
        wanted = (k - np.where(word > 0, self.until[word - 1], 0)).astype(_U)
        # Marks up to and with each byte; the high bit shows where they are enough.
        enough = ((own * _LOW) | _HIGH) - wanted * _LOW
        return word * 8 + np.bitwise_count(~enough & _HIGH) + 1


def _cut(raw: np.ndarray, ends: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts that end at ``ends`` of ``raw``: units, the two places to cut at, and code points before the first and between both."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    padded = np.zeros(len(raw) + 8 - len(raw) % 8, dtype=np.uint8)
    padded[: len(raw)] = raw
    words = padded.view("<u8")
    letters, continued = letter_marks(words), continued_marks(words)
    unit = _HIGH & ~((letters & _following(letters)) | _following(continued))
    last = ends[ends > starts] - 1
    unit.view(np.uint8)[last] |= 0x80
    unit.view(np.uint8)[len(raw) :] = 0
    units = Places(unit)
    first = units.rank(starts)
    n = units.rank(ends) - first
    one, two = np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))
    total = units.until[-1]
    a = np.where(one > 0, units.after(np.clip(first + one, 1, max(total, 1))), starts) if total else starts
    b = np.where(two > 0, units.after(np.clip(first + two, 1, max(total, 1))), starts) if total else starts
    points = Places(_HIGH & ~continued)
    before = points.rank(a)
    return n, a, b, before - points.rank(starts), points.rank(b) - before


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of ``most`` bytes together, or of one text."""
    at, held = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if k > at and held + n > most:
            yield at, k
            at, held = k, 0
        held += n
    if at < len(sizes):
        yield at, len(sizes)


def _transform(plain: int, suffix_first: int):
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def part(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        h1, h2, h3, h4 = (b.column(f"h{k}").to_numpy(zero_copy_only=False) for k in (1, 2, 3, 4))
        n, first, second, before, between = _cut(np.frombuffer(b"".join(texts), dtype=np.uint8), ends, h1, h2)
        out, forms, lengths = [], [], []
        for k, t in enumerate(texts):
            if not t or p in t or s in t or m in t or h3[k] % 100 >= 100 - plain:
                out.append(t)
                forms.append("plain")
                lengths.append((None, None))
                continue
            start = ends[k] - len(t)
            x, y = int(first[k] - start), int(second[k] - start)
            spm = h4[k] % 100 < suffix_first
            forms.append("spm" if spm else "psm")
            out.append(b"".join((s, t[y:], p, t[:x], m, t[x:y]) if spm else (p, t[:x], s, t[y:], m, t[x:y])))
            lengths.append((int(before[k]), int(between[k])))
        columns = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array([a for a, _ in lengths], pa.int64()), pa.array([c for _, c in lengths], pa.int64())]
        # The bytes are the column's own, so they are viewed as text, not decoded.
        return pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.binary()).view(pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.array([len(t.as_buffer() or b"") if t.is_valid else 0 for t in b.column("text").cast(pa.binary())], dtype=np.int64)
            for at, end in _slices(sizes, SLICE):
                yield part(b.slice(at, end - at))

    return run


def fill_in_middle(docs: DataFrame, *, seed: int = SEED, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``doc_id``, ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars``, ``output`` for each row of ``docs`` (doc_id, text).

    Of a hundred documents about ``plain`` are left as they are; of the others ``suffix_first`` in a hundred have the form spm.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    drawn = [F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("bigint").alias(f"h{k + 1}") for k in range(4)]
    keyed = docs.select("doc_id", "text", digest.alias("digest")).select("doc_id", "text", *drawn)
    return keyed.mapInArrow(giving_back(_transform(plain, suffix_first)), f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of, from its form; each mark occurs in it once."""
    o = F.col(output)

    def between(begin: str, end: str) -> Column:
        return F.substring_index(F.substring_index(o, end, 1), begin, -1)

    middle = F.substring_index(o, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(o)


def digest(made: DataFrame) -> DataFrame:
    """The columns of ``fill_in_middle`` with digests of the output and of what is read back from it."""
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))
