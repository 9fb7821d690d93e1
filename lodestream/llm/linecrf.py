"""Line labelling by a linear-chain conditional random field, and the quality rule on it.

Each line with a word is content or boilerplate. Its features (length, symbols,
capitals, repeats, end of sentence, ...) weigh for both, and so does the label of
the line before; Viterbi decoding finds the best labelling of the whole text. A
document is kept if its base counts pass and content lines hold half of its words.

Training uses ``FIT_ROWS`` documents at most that ``labels.quality`` marks and that
aren't held out. A logistic model of single lines first tells which lines of bad
documents look like those of good ones; these count as content, the others of bad
documents as boilerplate. On such labelled sequences the field is fitted by
gradient ascent on its log likelihood (forward and backward sums, Adam).

Cases: a null text has no words. A text of fewer than 20 words fails the base rule,
so an empty one isn't kept. If no labelled document is bad or none is good, all
lines are content. Repeated rows each get the result of their text. An empty table
gives no rows. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.labelled import training_texts
from lodestream.llm.shingles import _ROW

FIT_ROWS = 6_000
#: Lines of a training sequence (longer texts are cut into several), and sequences at most.
SEQUENCE, SEQUENCES = 48, 12_000
WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
LEAST_CONTENT = 0.5
CONTENT, BOILERPLATE = 0, 1
FEATURES = 13

_SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOL = bytes(b for b in range(256) if b not in _SYMBOLS)
_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_NOT_LOWER = bytes(b for b in range(256) if not 97 <= b <= 122)
_NOT_DIGIT = bytes(b for b in range(256) if not 48 <= b <= 57)
_CONTINUES = bytes(range(0x80, 0xC0))


def base_counts(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    raw = text or b""
    words = raw.split()
    n = len(words)
    chars = len(b"".join(words).translate(None, _CONTINUES))
    symbols = len(raw.translate(None, _NOT_SYMBOL))
    lines = [x for x in raw.split(b"\n") if x.split()]
    repeated = 0
    if n > WINDOW:
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=n)
        s = h[: n - WINDOW + 1] * _ROW[0]
        for i in range(1, WINDOW):
            s += h[i : n - WINDOW + 1 + i] * _ROW[i]
        order = np.sort(s)
        twice = order[1:][order[1:] == order[:-1]]
        if len(twice):
            at = np.flatnonzero(np.isin(s, twice))
            edge = np.zeros(n + 1, dtype=np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + WINDOW, -1)
            repeated = int((np.cumsum(edge)[:n] > 0).sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def base_fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat_words > MOST_REPEATED * n_words


def line_features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Features of each line with a word, and its number of words."""
    rows, sizes, seen = [], [], set()
    for line in (text or b"").split(b"\n"):
        words = line.split()
        n = len(words)
        if not n:
            continue
        size = len(line)
        upper, lower = len(line.translate(None, _NOT_UPPER)), len(line.translate(None, _NOT_LOWER))
        symbols = len(line.translate(None, _NOT_SYMBOL))
        same = sum(a == b for a, b in zip(words, words[1:], strict=False))
        rows.append(
            (
                1.0,
                np.log1p(n) / 5,
                n < 4,
                (symbols / size) ** 0.5,
                symbols > 0.05 * size,
                min(1.0, line.count(b"!") / n),
                upper / (upper + lower + 1),
                words[-1][-1:] in b".!?:;",
                (same / n) ** 0.5,
                1 - len(set(words)) / n,
                line in seen,
                len(line.translate(None, _NOT_DIGIT)) / size,
                line[:1].isupper() or line[0] >= 0x80,
            )
        )
        sizes.append(n)
        seen.add(line)
    return np.array(rows, dtype=np.float64).reshape(-1, FEATURES), np.array(sizes, dtype=np.int64)


@dataclass(frozen=True)
class Field:
    """Weights of features for each label, of a label after a label, and of the first one."""

    emit: np.ndarray
    move: np.ndarray
    first: np.ndarray

    def labels(self, x: np.ndarray) -> np.ndarray:
        """The best labelling (Viterbi); ties go to content."""
        if not len(x):
            return np.empty(0, dtype=np.int64)
        e = (x @ self.emit.T).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = e[0][0] + self.first[0], e[0][1] + self.first[1]
        back = []
        for e0, e1 in e[1:]:
            stay, come, leave, remain = a + m00, b + m10, a + m01, b + m11
            back.append((0 if stay >= come else 1, 0 if leave >= remain else 1))
            a, b = max(stay, come) + e0, max(leave, remain) + e1
        out = [0 if a >= b else 1]
        for step in reversed(back):
            out.append(step[out[-1]])
        return np.array(out[::-1])

    def content_share(self, text: bytes | None) -> float:
        """The share of words that lie in content lines; of a text without words, 0."""
        x, sizes = line_features(text)
        return float(sizes[self.labels(x) == CONTENT].sum() / sizes.sum()) if len(x) else 0.0


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(x.shape[1]), x.T @ (y - p) - w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_sequences(sequences: list[tuple[np.ndarray, np.ndarray]], rounds: int = 100, rate: float = 0.1, ridge: float = 1e-3) -> Field:
    """Maximum likelihood (with a ridge) on (features, labels) of sequences of ``SEQUENCE`` lines at most."""
    width = max(len(y) for _, y in sequences)
    n = len(sequences)
    x, y, real = np.zeros((n, width, FEATURES)), np.zeros((n, width), dtype=np.int64), np.zeros((n, width), dtype=bool)
    for k, (f, lab) in enumerate(sequences):
        x[k, : len(lab)], y[k, : len(lab)], real[k, : len(lab)] = f, lab, True
    total = real.sum()
    one_hot = np.eye(2)[y] * real[..., None]
    pairs = np.einsum("nta,ntb->ab", one_hot[:, :-1], one_hot[:, 1:])
    seen = (np.einsum("nta,ntf->af", one_hot, x), pairs, one_hot[:, 0].sum(axis=0))
    params = [np.zeros((2, FEATURES)), np.zeros((2, 2)), np.zeros(2)]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    for t in range(1, rounds + 1):
        emit, move, first = params
        e = x @ emit.T
        forward, backward = np.zeros((n, width, 2)), np.zeros((n, width, 2))
        forward[:, 0] = e[:, 0] + first
        for k in range(1, width):
            step = np.logaddexp(forward[:, k - 1, :1] + move[0], forward[:, k - 1, 1:] + move[1]) + e[:, k]
            forward[:, k] = np.where(real[:, k, None], step, forward[:, k - 1])
        for k in range(width - 2, -1, -1):
            nxt = e[:, k + 1] + backward[:, k + 1]
            step = np.logaddexp(move[:, 0] + nxt[:, :1], move[:, 1] + nxt[:, 1:])
            backward[:, k] = np.where(real[:, k + 1, None], step, 0)
        logz = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        node = np.exp(forward + backward - logz[:, None, None]) * real[..., None]
        edge = np.exp(forward[:, :-1, :, None] + move + (e + backward)[:, 1:, None, :] - logz[:, None, None, None]) * real[:, 1:, None, None]
        expected = (np.einsum("nta,ntf->af", node, x), edge.sum(axis=(0, 1)), node[:, 0].sum(axis=0))
        for k in range(3):
            g = (seen[k] - expected[k]) / total - ridge * params[k]
            moments[k][0] = 0.9 * moments[k][0] + 0.1 * g
            moments[k][1] = 0.999 * moments[k][1] + 0.001 * g * g
            params[k] = params[k] + rate * (moments[k][0] / (1 - 0.9**t)) / (np.sqrt(moments[k][1] / (1 - 0.999**t)) + 1e-8)
    return Field(*params)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for y, t in zip(b.column("y").to_pylist(), b.column("text").cast(pa.binary()), strict=True):
            x = line_features(t.as_py())[0]
            cut = [x[i : i + SEQUENCE].ravel().tolist() for i in range(0, len(x), SEQUENCE)]
            yield pa.RecordBatch.from_arrays([pa.array([y] * len(cut), pa.int32()), pa.array(cut, pa.list_(pa.float64()))], names=["y", "x"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS) -> Field:
    """Fit on sequences of ``rows`` labelled documents at most, none held out: ``SEQUENCES`` at most, those of the least hashes."""
    cut = training_texts(docs, labels, label, rows).mapInArrow(_measure, "y int, x array<double>")
    got = cut.orderBy(F.xxhash64("x"), "y").limit(SEQUENCES).collect()
    docs_of = [(r["y"], np.array(r["x"]).reshape(-1, FEATURES)) for r in got]
    if len({y for y, _ in docs_of}) < 2:
        return Field(np.zeros((2, FEATURES)), np.zeros((2, 2)), np.zeros(2))
    x = np.concatenate([f for _, f in docs_of])
    bad = np.concatenate([np.full(len(f), 1.0 - y) for y, f in docs_of])
    single = _logistic(x, bad)
    return fit_sequences([(f, np.zeros(len(f), dtype=np.int64) if y else (f @ single > 0).astype(np.int64)) for y, f in docs_of])


def _judge(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, failed, kept, shares = [], [], [], []
            for t in b.column("text").cast(pa.binary()):
                raw = t.as_py()
                counts.append(base_counts(raw))
                failed.append(base_fails(counts[-1][0], counts[-1][4]))
                shares.append(field.content_share(raw))
                kept.append(not failed[-1] and shares[-1] >= LEAST_CONTENT)
            columns = list(zip(*counts, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns), pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_()), pa.array(shares, pa.float64())], names=_OUT)

    return run


_OUT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"]


def judge(docs: DataFrame, labels: DataFrame, *, rows: int = FIT_ROWS) -> DataFrame:
    """Base counts, verdict and content share of each row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    field = fit(docs, labels, rows=rows)
    schema = f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in _OUT[1:6]) + ", base_failed boolean, kept boolean, content_share double"
    return docs.select("doc_id", "text").mapInArrow(_judge(field), schema)
