"""Document quality by regularised quadratic discriminant analysis.

Statistics of the whole text are transformed (roots of shares, logs of counts) and
modelled for each class by a Gaussian. A class covariance is shrunk first towards
the pooled one, then towards the pooled variances, and factored once (Cholesky).
A score is the logistic function of the difference of log densities and priors.

Nothing but the text goes into a score. Class sums of the statistics and of their
products are added up by Spark over ``FIT_ROWS`` labelled rows at most; the driver
gets some three hundred numbers.

Cases: a null text counts as empty; an empty text has statistics (all zero) and so
a score. A label row without document, a null label and a label for an id that no
document has are not used; where an id is repeated, each of its rows counts. If a class has no labelled rows, the score is the smoothed share of class 1. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm import shingles
from lodestream.llm.labelled import FIT_ROWS, held_out, training_texts
from lodestream.llm.worker import giving_back

THRESHOLD = 0.3
#: Shrinkage of a class covariance towards the pooled one, and of that towards the pooled variances.
TO_POOLED, TO_DIAGONAL = 0.5, 0.3
#: A floor on the variance of each statistic.
FLOOR = 1e-4
WINDOW = 8

STATISTICS = ("symbols", "exclamations", "capitals", "digits", "punctuation", "adjacent_repeats", "repeated_windows", "duplicate_lines", "distinct_words", "word_bytes", "words_a_line", "words")

_CLASS = np.zeros(256, dtype=np.intp)
for _k, _of in enumerate((b"#*$%&|<>", b"!", bytes(range(65, 91)), bytes(range(48, 58)), b".,;:?-'\"()", bytes(range(97, 123)), b" \t\n\r\x0b\x0c"), 1):
    _CLASS[list(_of)] = _k


def statistics(text: bytes | None) -> np.ndarray:
    """The transformed statistics of a whole text, in the order of ``STATISTICS``."""
    raw = text or b""
    words = raw.lower().split()
    n = len(words)
    if not n:
        return np.zeros(len(STATISTICS))
    by_byte = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    symbols, shouts, upper, digits, marks, lower, _ = np.bincount(_CLASS, weights=by_byte, minlength=8)[1:]
    h = np.fromiter(map(shingles.xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=n)
    ordered = np.sort(h)
    distinct = 1 + int((ordered[1:] != ordered[:-1]).sum())
    adjacent = int((h[1:] == h[:-1]).sum())
    repeated = 0.0
    if n > WINDOW:
        s = h[: n - WINDOW + 1] * shingles._ROW[0]
        for i in range(1, WINDOW):
            s += h[i : n - WINDOW + 1 + i] * shingles._ROW[i]
        s.sort()
        same = s[1:] == s[:-1]
        repeated = float(same.sum()) / len(s)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return np.array(
        [
            np.sqrt(symbols / len(raw)),
            np.sqrt(shouts / n),
            upper / (upper + lower + 1),
            np.sqrt(digits / len(raw)),
            np.sqrt(marks / n),
            np.sqrt(adjacent / n),
            np.sqrt(repeated),
            np.sqrt(1 - len(set(lines)) / len(lines)),
            np.log1p(distinct) / np.log1p(n),
            np.log1p((len(raw) - n) / n),
            np.log1p(n / len(lines)),
            np.log1p(n),
        ]
    )


def _all_statistics(b: pa.RecordBatch) -> np.ndarray:
    texts = b.column(b.schema.get_field_index("text")).cast(pa.binary())
    return np.array([statistics(t.as_py()) for t in texts]).reshape(-1, len(STATISTICS))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition, for each class: the count, the sums and the sums of products, as one list."""
    width = len(STATISTICS)
    total = {0: np.zeros(1 + width + width * width), 1: np.zeros(1 + width + width * width)}
    for b in batches:
        y = b.column("y").to_numpy(zero_copy_only=False)
        x = _all_statistics(b)
        for c in (0, 1):
            own = x[y == c]
            total[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
    yield pa.RecordBatch.from_pydict({"y": pa.array([0, 1], pa.int32()), "s": pa.array([total[0].tolist(), total[1].tolist()], pa.list_(pa.float64()))})


@dataclass(frozen=True)
class Discriminant:
    """Means of both classes, the inverses of their Cholesky factors, and their counts. ``threshold`` is where decisions fall."""

    counts: tuple[float, float]
    means: tuple[np.ndarray, np.ndarray] | None
    factors: tuple[np.ndarray, np.ndarray] | None
    threshold: float = THRESHOLD

    def score(self, x: np.ndarray) -> np.ndarray:
        """From 0 to 1 for each row of ``x``: class 1 the likelier, the higher.

        The log odds are counted from those of the threshold and divided by the number of
        statistics, which are far from independent, so that scores don't pile up at 0 and
        1. Neither order nor decisions change by that.
        """
        n0, n1 = self.counts
        prior = (n1 + 1) / (n0 + n1 + 2)
        if self.factors is None:
            return np.full(len(x), prior)
        logs = []
        for mean, factor in zip(self.means, self.factors, strict=True):
            z = factor @ (x - mean).T
            logs.append(-0.5 * (z * z).sum(axis=0) + np.log(np.diag(factor)).sum())
        odds = logs[1] - logs[0] + np.log(prior / (1 - prior))
        border = np.log(self.threshold / (1 - self.threshold))
        return 1 / (1 + np.exp(-np.clip((odds - border) / len(STATISTICS) + border, -500, 500)))


def discriminant(sums: dict[int, np.ndarray], to_pooled: float = TO_POOLED, to_diagonal: float = TO_DIAGONAL) -> Discriminant:
    """The model of two classes' counts, sums and sums of products."""
    width = len(STATISTICS)
    counts = tuple(float(sums[c][0]) if c in sums else 0.0 for c in (0, 1))
    if min(counts) < 1:
        return Discriminant(counts, None, None)
    means = [sums[c][1 : 1 + width] / counts[c] for c in (0, 1)]
    scatter = [sums[c][1 + width :].reshape(width, width) - counts[c] * np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = sum(scatter) / sum(counts) + FLOOR * np.eye(width)
    factors = []
    for c in (0, 1):
        own = (1 - to_pooled) * scatter[c] / counts[c] + to_pooled * pooled
        own = (1 - to_diagonal) * own + to_diagonal * np.diag(np.diag(pooled))
        factors.append(np.linalg.inv(np.linalg.cholesky((own + own.T) / 2)))
    return Discriminant(counts, tuple(means), tuple(factors))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS) -> Discriminant:
    """Fit on ``rows`` labelled rows of ``docs`` at most, none of them held out."""
    parts = training_texts(docs, labels, label, rows).select("y", "text").mapInArrow(_sums, "y int, s array<double>")
    added = parts.select("y", F.posexplode("s").alias("k", "v")).groupBy("y", "k").agg(F.sum("v").alias("v")).collect()
    sums: dict[int, np.ndarray] = {}
    for r in added:  # two classes of 1 + d + d * d numbers
        sums.setdefault(r["y"], np.zeros(1 + len(STATISTICS) * (1 + len(STATISTICS))))[r["k"]] = r["v"]
    return discriminant(sums)


def _scorer(model: Discriminant):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(_all_statistics(b)))], names=["doc_id", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` for each row of ``docs``."""
    model = replace(fit(docs, labels, rows=rows), threshold=threshold)
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(_scorer(model), f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _keeper(model: Discriminant, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.score(_all_statistics(b)) >= threshold))

    return run


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, rows: int = FIT_ROWS) -> DataFrame:
    """Rows of ``docs`` that the classifier accepts, with all their columns; it is fitted on labelled rows among them."""
    model = replace(fit(docs, labels, rows=rows), threshold=threshold)
    return docs.mapInArrow(giving_back(_keeper(model, threshold)), docs.schema)
