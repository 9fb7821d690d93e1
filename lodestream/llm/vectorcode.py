"""Compression of vectors to codes of their parts, with nearest entries found in a GNAT.

A component x becomes the integer floor(256 x). A vector is cut into ``PARTS`` equal
parts; each part position has a codebook of ``ENTRIES`` entries, at first the parts of
the vectors of the least ids. In each round every part goes to its nearest entry
(squared distance, ties to the lower index) and each used entry becomes the floor of
its parts' mean, component by component. Then all parts are assigned once more.

The nearest entry is found in a geometric near-neighbour access tree over the entries:
a node's split points divide its entries by the nearest split point, and for each split
point and child it is known within which distances the child's entries lie. A query's
distances to the split points give, by the triangle inequality, a bound for each child;
a child goes with all that is below it if the bound is strictly larger than the best
distance so far. Ranges are rounded outwards, bounds downwards and the best distance
upwards, so that no equal or better entry is lost; what is compared in the end are
integers, with the index where they are equal. A batch's queries go down together.

Codebooks are kept on the driver and sent with the tasks (``ENTRIES`` vectors). A round
is one scan: a task sends sums and counts for each entry, never vectors.

Cases: rows whose vector is null or holds null or non-finite components are dropped, as
are those with a component of ``LARGEST`` or more. So are vectors with another length
than that of the least kept id, and lengths that aren't a multiple of ``PARTS``. Fewer
vectors than entries make smaller codebooks. Of repeated ids the lesser vectors come
first; null ids come last. Integers too large for 64-bit distances are worked on as
Python's; an error beyond a long is given as the largest long. No kept vector, no rows.
Other columns, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm import scratch
from lodestream.llm.worker import giving_back

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256
#: Split points of a node, and entries that are compared one by one.
DEGREE, LEAF = 8, 8
LARGEST = 2.0**80
#: Vectors that are assigned together.
TOGETHER = 4096

_MOST = 2**63 - 1
#: What a root of an integer may be wrong by, relatively, many times over.
_SLACK = 1e-9


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all of ``b``, exact."""
    out = None
    for k in range(a.shape[1]):
        gap = a[:, k, None] - b[None, :, k]
        out = gap * gap if out is None else out + gap * gap
    return out


def _root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


class Gnat:
    """A geometric near-neighbour access tree over integer entries."""

    def __init__(self, entries: np.ndarray, own: np.ndarray | None = None) -> None:
        self.own = np.arange(len(entries)) if own is None else own
        self.children: list[tuple[Gnat, np.ndarray, np.ndarray]] = []
        if len(self.own) <= LEAF:
            self.points = self.own
            return
        here = entries[self.own]
        # Split points far from each other: each next one is farthest from those before.
        chosen = [0]
        gap = squared(here, here[:1])[:, 0]
        while len(chosen) < DEGREE and gap.max() > 0:
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, squared(here, here[chosen[-1] :][:1])[:, 0])
        self.points = self.own[chosen]
        far = squared(here, here[chosen])
        side = far.argmin(axis=1)
        rest = ~np.isin(np.arange(len(here)), chosen)
        for j in range(len(chosen)):
            members = np.flatnonzero(rest & (side == j))
            if len(members):
                reach = _root(far[members])
                below = Gnat(entries, self.own[members]) if len(members) < len(here) - 1 else _leaf(self.own[members])
                self.children.append((below, reach.min(axis=0) * (1 - _SLACK), reach.max(axis=0) * (1 + _SLACK)))

    def search(self, queries: np.ndarray, rows: np.ndarray, entries: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        """Better ``best`` and ``index`` of those ``rows`` of ``queries`` by what is below this node."""
        d = squared(queries[rows], entries[self.points])
        for k, point in enumerate(self.points):
            better = (d[:, k] < best[rows]) | ((d[:, k] == best[rows]) & (point < index[rows]))
            best[rows[better]], index[rows[better]] = d[better, k], point
        if self.children:
            root = _root(d)
            low, high = root * (1 - _SLACK), root * (1 + _SLACK)
            for child, nearest, farthest in self.children:
                bound = np.maximum(nearest - high, low - farthest).max(axis=1)
                left = rows[bound <= _root(best[rows]) * (1 + _SLACK)]
                if len(left):
                    child.search(queries, left, entries, best, index)


def _leaf(own: np.ndarray) -> Gnat:
    node = Gnat.__new__(Gnat)
    node.own = node.points = own
    node.children = []
    return node


def nearest(tree: Gnat, entries: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query the index of its nearest entry, the lower one of equals, and the squared distance."""
    far = queries.dtype == object
    best = np.full(len(queries), 1 << 400 if far else _MOST, dtype=object if far else np.int64)
    index = np.full(len(queries), len(entries), dtype=np.int64)
    if len(queries):
        tree.search(queries, np.arange(len(queries)), entries, best, index)
    return index, best


def integers(rows: np.ndarray, parts: int) -> np.ndarray:
    """floor(256 x); as Python's integers where a squared distance may not fit in 64 bits."""
    if not rows.size or np.abs(rows).max() * SCALE < math.isqrt(_MOST // max(1, rows.shape[1] // parts)) // 2 - 1:
        return np.floor(rows * SCALE).astype(np.int64)
    return np.vectorize(lambda x: math.floor(x * SCALE), otypes=[object])(rows)


class Coder:
    """Codebooks (part, entry, position) and their trees."""

    def __init__(self, books: np.ndarray) -> None:
        self.books = books
        self.trees = [Gnat(b) for b in books]

    def __getstate__(self) -> np.ndarray:
        return self.books

    def __setstate__(self, books: np.ndarray) -> None:
        self.__init__(books)

    def assign(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of vectors: their integers (vector, part, position), the codes of their parts, and the parts' squared distances."""
        parts, _, width = self.books.shape
        x = integers(rows, parts)
        kind = object if object in (x.dtype, self.books.dtype) else np.int64
        x = x.astype(kind).reshape(len(rows), parts, width)
        books = self.books.astype(kind)
        found = [nearest(tree, books[k], x[:, k]) for k, tree in enumerate(self.trees)]
        return x, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _rows(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of a batch with their vectors as rows of numbers."""
    for at in range(0, b.num_rows, TOGETHER):
        part = b.slice(at, TOGETHER)
        yield part, part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)


def _summer(coder: Coder) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = coder.books.shape
        total, count = np.zeros((parts, entries, width), dtype=object), np.zeros((parts, entries), dtype=np.int64)
        for b in batches:
            for _, rows in _rows(b):
                x, codes, _ = coder.assign(rows)
                for k in range(parts):
                    own = np.zeros((entries, width), dtype=x.dtype)
                    np.add.at(own, codes[:, k], x[:, k])
                    total[k] += own
                    count[k] += np.bincount(codes[:, k], minlength=entries)
        used = np.argwhere(count > 0)
        at = [(k, e, p) for k, e in used.tolist() for p in range(width)]
        columns = [pa.array([a[i] for a in at], pa.int32()) for i in range(3)]
        sums, n = pa.array([Decimal(int(total[a])) for a in at], pa.decimal128(38, 0)), pa.array([int(count[k, e]) for k, e, _ in at], pa.int64())
        yield pa.RecordBatch.from_arrays([*columns, sums, n], names=["part", "entry", "place", "total", "n"])

    return run


def _encoder(coder: Coder) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, rows in _rows(b):
                _, codes, errors = coder.assign(rows)
                code = [r.tobytes().hex() for r in codes.astype(np.uint8)]
                error = [min(int(e), _MOST) for e in errors.astype(object).sum(axis=1)]
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def _kept(vectors: DataFrame, parts: int) -> DataFrame:
    """(vec_id, label, embedding) of vectors without null, non-finite or huge components, whose length is a multiple of ``parts``."""
    good = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < LARGEST))
    return vectors.select("vec_id", "label", "embedding").filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & (F.size("embedding") % parts == 0)).filter(F.coalesce(good, F.lit(False)))


def trained(kept: DataFrame, parts: int, entries: int, rounds: int) -> tuple[Coder, int] | None:
    """Codebooks of vectors without gaps, and the vectors' length; None if there are none."""
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding")
    head = first.limit(entries).collect()
    if not head:
        return None
    length = len(head[0]["embedding"])
    if any(len(r["embedding"]) != length for r in head):
        head = first.filter(F.size("embedding") == length).limit(entries).collect()
    start = np.array([list(r["embedding"]) for r in head], dtype=np.float64)
    coder = Coder(integers(start, parts).reshape(len(head), parts, -1).transpose(1, 0, 2).copy())
    for _ in range(rounds):
        sums = kept.filter(F.size("embedding") == length).select("embedding").mapInArrow(giving_back(_summer(coder)), "part int, entry int, place int, total decimal(38,0), n bigint")
        sums = sums.groupBy("part", "entry", "place").agg(F.sum("total").cast("decimal(38,0)").alias("total"), F.sum("n").alias("n"))
        books = coder.books.astype(object)
        for r in sums.collect():  # entries x length of a vector
            books[r["part"], r["entry"], r["place"]] = int(r["total"]) // r["n"]
        largest = max((abs(x) for x in books.ravel()), default=0)
        coder = Coder(books if largest >= math.isqrt(_MOST // books.shape[2]) // 2 - 1 else books.astype(np.int64))
    return coder, length


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id``, ``code``, ``error``, ``label_error``, ``codebooks_sha256`` for each kept row of ``vectors`` (vec_id, embedding, label).

    ``entries`` is 256 at most (two hex digits).
    """
    if entries > 256:
        raise ValueError("an entry's index must fit in two hex digits")
    kept = _kept(vectors, parts)
    vec, label = (vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    found = trained(kept, parts, entries, rounds)
    if found is None:
        none = kept.filter(F.lit(False))
        return none.select("vec_id", F.lit("").alias("code"), *(F.lit(0).cast("bigint").alias(c) for c in ("error", "label_error")), F.lit(books_digest(np.empty(0))).alias("codebooks_sha256"))
    coder, length = found
    coded = kept.filter(F.size("embedding") == length).mapInArrow(giving_back(_encoder(coder)), f"vec_id {vec}, label {label}, code string, error bigint")
    coded, _ = scratch.table(coded, "vector-codes")
    total = F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(_MOST)).cast("bigint")
    sums = coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error"))
    out = coded.join(sums, coded["label"].eqNullSafe(sums["of"]), "left")
    return out.select("vec_id", "code", "error", "label_error", F.lit(books_digest(coder.books)).alias("codebooks_sha256"))
