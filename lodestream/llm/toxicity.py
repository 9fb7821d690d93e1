"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear support vector machine.

Two strings are alike by the subsequences of three letters that they share, each
weighted by ``DECAY`` for every letter that it spans (the normalised string
subsequence kernel). Letters with a gap or an inserted mark between them so still
match, at a lower weight.

Learning takes labelled sentences: documents are cut into sentences, each a set of
units (words, and letters that are written apart). A sentence's feature for a
landmark is the largest kernel value that a unit of it has. All sentences of clean
documents are negative. Of a toxic document at least one sentence must be the reason
for its label: those that hold a landmark as it is written are positive at first, and
in each further round the one of the largest margin (learning from bags). Each
landmark's sentences are also given with it gapped, and with letters inserted and
doubled. The machine has a squared hinge loss and is solved by Newton's method; its
border is put where the labelled documents are told apart best.

Landmarks are units that clean documents (almost) never use and toxic ones use after
so many different words that neither chance nor copies of a few documents explain it.
Units of more than ``WINDOW`` letters count as overlapping windows, so that none is too
long; those of fewer than three are framed by marks of begin and end, which count as
letters. Letters are code points; bytes that aren't UTF-8 count as one unknown letter.

A document's margin is that of its most toxic sentence. A unit is asked about if it
has ``NEAR`` of a landmark's neighbouring letter pairs, with at most ``GAP`` letters
between the two (marks and digits don't count); inserted letters leave all
pairs there. Sentences without such a unit get the floor. Nothing but the text goes
into a score.

A unit's kernel is worked out with the landmarks that it is near to, and 0 with the rest.

Cases: a null text is empty; an empty text gets the floor, as does every text if no
labelled document is toxic or none is clean. Repeated rows each get the score of
their text; in learning, documents of one text are one. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.labelled import FIT_ROWS, held_out, training_texts
from lodestream.llm.worker import give_back, giving_back

THRESHOLD = 0.5
ORDER, DECAY = 3, 0.75
#: Landmarks at most (the rank of the approximation), sentences of each class that the machine is fitted on, and rounds of choosing them.
LANDMARKS, SENTENCES, ROUNDS = 128, 16_000, 3
#: Share of a landmark's neighbouring letter pairs that a unit must hold to be asked about, and letters that may stand between the two of a pair.
NEAR, GAP = 0.8, 2
#: Letters of a unit that the kernel sees at once; longer units are cut into overlapping windows.
WINDOW = 32
#: Rows of features that fitting works on at a time.
BLOCK = 2048
#: Words that a worker remembers; beyond it the memory starts anew (scores don't change).
MEMO_WORDS = 150_000
COST = 20.0
#: Weight of a misspelt sentence, and of all negative sentences against all positive ones.
VARIANT_WEIGHT, NEGATIVE_SHARE = 0.1, 4.0
#: Toxic documents missed that weigh as much as one clean document lost.
CLEAN_COST = 5
STEEPNESS = 4.0
FLOOR = -1.5

_EDGES = b".,;:!?\"'()[]{}<>*%$&#|-_/\\^~+=@`"
_APART = re.compile(rb"(?<!\S)\w(?:[ .\-_*]\w){2,}(?!\S)")


_SENTENCE = re.compile(rb"(?<=[.!?])\s+|\n")


def lowered(text: bytes | None) -> bytes:
    raw = text or b""
    return raw.lower() if raw.isascii() else raw.decode(errors="replace").lower().encode()


def _count_letters(word: bytes) -> int:
    return len(word) if word.isascii() else len(word.decode(errors="replace"))


def units(low: bytes) -> set[bytes]:
    """The distinct words of a lower-cased text, and letters written apart as one word each."""
    return set(low.split()) | {re.sub(rb"\W", b"", m) for m in _APART.findall(low)}


def _letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all words, one after the other, and how many each has."""
    joined = b"".join(words)
    if joined.isascii():
        return np.frombuffer(joined, dtype=np.uint8), np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    texts = [w.decode(errors="replace") for w in words]
    return np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4"), np.fromiter(map(len, texts), dtype=np.int64, count=len(words))


def _matrix(words: list[bytes], least: int = 1) -> np.ndarray:
    """Words as rows of ``least`` or more code points, with 0 at the end."""
    flat, sizes = _letters(words)
    out = np.zeros((len(words), max([least, *sizes.tolist()])), dtype=np.uint32)
    row = np.repeat(np.arange(len(words)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def paired_kernel(words: list[bytes], others: list[bytes]) -> np.ndarray:
    """The subsequence kernel of each word with the other one at its place (not normalised)."""
    s, t = _matrix(words), _matrix(others)
    n, width = t.shape
    t_real = t > 0
    # decay[i, j]: weight of reaching place j of t from place i
    step = np.subtract.outer(np.arange(width), np.arange(width)).T
    decay = np.where(step >= 0, DECAY ** np.maximum(step, 0), 0.0).astype(np.float32)
    # before[l][.., j]: weight of subsequences of length l in s so far and in t before place j
    before = [np.ones((n, width), np.float32)] + [np.zeros((n, width), np.float32) for _ in range(ORDER - 1)]
    total = np.zeros(n, np.float32)
    for k in range(s.shape[1]):
        real = s[:, k] > 0
        same = (s[:, k, None] == t) & t_real & real[:, None]
        total += DECAY**2 * (before[ORDER - 1] * same).sum(axis=1)
        for length in range(ORDER - 1, 0, -1):
            reached = (DECAY**2 * (before[length - 1] * same)) @ decay
            shifted = np.zeros_like(reached)
            shifted[:, 1:] = reached[:, :-1]
            before[length] = DECAY * before[length] + shifted
    return total


def kernel(words: list[bytes], others: list[bytes]) -> np.ndarray:
    """The subsequence kernel of each word with each other one (not normalised)."""
    return paired_kernel([w for w in words for _ in others], others * len(words)).reshape(len(words), len(others))


def bare(word: bytes) -> bytes:
    """A unit without punctuation, digits or marks at its ends or between its letters."""
    return word if word.isalpha() else word.translate(None, _EDGES + b"0123456789")


def windows(word: bytes) -> list[bytes]:
    """A unit of more than ``WINDOW`` letters in overlapping pieces, one of fewer than ``ORDER`` framed; none of an empty one."""
    if len(word) <= WINDOW:
        return [word] if len(word) >= ORDER and (word.isascii() or _count_letters(word) >= ORDER) else [b"^" + word + b"$"] if word else []
    if word.isascii():
        return [word[i : i + WINDOW] for i in range(0, len(word) - WINDOW // 2, WINDOW // 2)]
    text = word.decode(errors="replace")
    return [text[i : i + WINDOW].encode() for i in range(0, max(1, len(text) - WINDOW // 2), WINDOW // 2)]


def _inner(landmark: bytes) -> bytes:
    """A landmark without its frame."""
    return landmark[1:-1] if landmark[:1] == b"^" and landmark[-1:] == b"$" and _count_letters(landmark) < ORDER + 2 else landmark


def _pairs(word: bytes) -> set[tuple[int, int]]:
    letters = _letters([word])[0].tolist()
    return set(zip(letters, letters[1:], strict=False))


def _letters_needed(pairs: set[tuple[int, int]], least: int) -> int:
    """How many distinct letters a word has at least that has ``least`` of these pairs (0: not worked out)."""
    letters = sorted({x for p in pairs for x in p})
    if len(letters) > 12:
        return 0
    for n in range(1, len(letters) + 1):
        if any(sum(a in some and b in some for a, b in pairs) >= least for some in map(set, combinations(letters, n))):
            return n
    return len(letters)


@dataclass
class Machine:
    """Landmarks, the weight of a sentence's feature for each, and a bias."""

    landmarks: list[bytes]
    weights: np.ndarray
    bias: float
    seen: set[bytes] = field(default_factory=set)
    features_of: dict[bytes, np.ndarray] = field(default_factory=dict)
    hot: set[bytes] = field(default_factory=set)

    def __post_init__(self) -> None:
        known = sorted({p for w in self.landmarks for p in _pairs(w)})
        self.alphabet = np.array(sorted({c for p in known for c in p}), dtype=np.uint32)
        kinds = len(self.alphabet)
        self.pair_at = np.full((kinds + 1, kinds + 1), len(known), dtype=np.int32)
        for k, p in enumerate(known):
            self.pair_at[tuple(np.searchsorted(self.alphabet, p))] = k
        self.has = np.zeros((len(known) + 1, len(self.landmarks)), dtype=np.float32)
        for j, w in enumerate(self.landmarks):
            for p in _pairs(w):
                self.has[known.index(p), j] = 1
        pairs = self.has.sum(axis=0)
        self.least = np.minimum(np.maximum(2, np.ceil(NEAR * pairs - 1e-6)), pairs)
        self.norms = paired_kernel(self.landmarks, self.landmarks) if self.landmarks else np.empty(0, np.float32)
        # One bit for each letter of the landmarks (letters beyond 64 kinds share the last), for a first look at many words at once.
        self.bit_of = np.append(np.left_shift(np.uint64(1), np.minimum(np.arange(kinds), 63).astype(np.uint64)), np.uint64(0))
        looks = set()
        for w, n in zip(self.landmarks, self.least, strict=True):
            inner = _inner(w)
            # A framed landmark needs all its letters; the frame isn't in the words that are looked at.
            need = 0 if kinds > 63 else _letters_needed(_pairs(w), int(n)) if inner is w else len(set(_letters([inner])[0].tolist()))
            looks.add((int(np.bitwise_or.reduce(self.bit_of[self.places(_letters([inner])[0])], initial=np.uint64(0))), need))
        self.looks = sorted(looks)

    def places(self, letters: np.ndarray) -> np.ndarray:
        """Each letter's place in the alphabet; those that aren't in it share the last one."""
        at = np.searchsorted(self.alphabet, letters)
        known = np.append(self.alphabet, np.uint32(0))[at] == letters
        return np.where(known & (letters > 0), at, len(self.alphabet))

    def __getstate__(self) -> tuple:
        return self.landmarks, self.weights, self.bias

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def lettered(self, words: list[bytes]) -> list[bytes]:
        """Those words that hold enough of some landmark's letters to be near it; none that is near is lost."""
        if not words:
            return []
        flat, sizes = _letters([w + b"\0" for w in words])
        held = np.bitwise_or.reduceat(self.bit_of[self.places(flat)], np.cumsum(sizes) - sizes)
        good = np.zeros(len(words), dtype=bool)
        for mask, need in self.looks:
            good |= np.bitwise_count(held & np.uint64(mask)) >= need
        return [words[k] for k in np.flatnonzero(good)]

    def near(self, words: list[bytes]) -> np.ndarray:
        """For each word and landmark, whether the word holds ``NEAR`` of the landmark's neighbouring pairs, with at most ``GAP`` letters between."""
        s = self.places(_matrix(words, GAP + 2))
        found = np.zeros((len(words), len(self.has)), dtype=np.float32)
        rows = np.arange(len(words))[:, None]
        for step in range(1, GAP + 2):
            found[rows, self.pair_at[s[:, :-step], s[:, step:]]] = 1
        found[:, -1] = 0
        return found @ self.has >= self.least

    def features(self, words: list[bytes]) -> np.ndarray:
        """The normalised kernel of each word with each landmark that it is near, 0 with the others."""
        out = np.zeros((len(words), len(self.landmarks)), dtype=np.float32)
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            i, j = np.nonzero(self.near(some))
            if len(i):
                rows, place = np.unique(i, return_inverse=True)
                asked = [some[k] for k in rows]
                own = paired_kernel(asked, asked)[place]
                both = paired_kernel([some[k] for k in i], [self.landmarks[k] for k in j])
                out[at + i, j] = both / np.sqrt(np.maximum(own * self.norms[j], 1e-12))
        return out

    def learn_of(self, new: Iterable[bytes]) -> None:
        """Compute and remember the features of new units that are near a landmark."""
        new = list(new)
        self.seen.update(new)
        if not self.landmarks:
            return
        parts = [(w, p) for w in self.lettered(new) for p in windows(bare(w))]
        found = self.features([p for _, p in parts])
        for k in np.flatnonzero(found.any(axis=1)):
            w = parts[k][0]
            self.features_of[w] = np.maximum(found[k], self.features_of[w]) if w in self.features_of else found[k]
        self.hot = set(self.features_of)

    def sentences(self, low: bytes, whole: set[bytes]) -> list[tuple[set[bytes], np.ndarray]]:
        """The sentences of a text that hold a near unit: those units, and the sentence's features. ``whole`` has the text's units."""
        here = whole & self.hot
        if len(here) < 2:
            return [({w}, self.features_of[w]) for w in here]
        out = []
        for s in _SENTENCE.split(low):
            if u := here & units(s):
                out.append((u, np.maximum.reduce([self.features_of[w] for w in u]) if len(u) > 1 else self.features_of[min(u)]))
        cut = here.difference(*(u for u, _ in out))  # letters apart across a boundary
        return [*out, *(({w}, self.features_of[w]) for w in sorted(cut))]

    def look(self, texts: Iterable[bytes | None]) -> list[list[tuple[set[bytes], np.ndarray]]]:
        """The sentences with near units of each text."""
        if len(self.seen) > MEMO_WORDS:  # before it is known which units are new
            self.seen, self.features_of, self.hot = set(), {}, set()
        lows = [lowered(t) for t in texts]
        held = [units(t) for t in lows]
        new: set[bytes] = set()
        for u in held:
            new |= u - self.seen
        self.learn_of(new)
        return [self.sentences(low, u) for low, u in zip(lows, held, strict=True)]

    def margins(self, texts: Iterable[bytes | None]) -> np.ndarray:
        return np.array([max([float(f @ self.weights) + self.bias for _, f in found], default=FLOOR) for found in self.look(texts)], dtype=np.float64)

    def scores(self, texts: Iterable[bytes | None]) -> np.ndarray:
        """Scores from 0 to 1; 0.5 is the machine's border."""
        return 1 / (1 + np.exp(-STEEPNESS * np.clip(self.margins(texts), -3, 3)))


def _variants(word: bytes) -> list[bytes]:
    """A witness with marks between all its letters, with one letter inserted, and with one doubled."""
    text = _inner(word).decode(errors="replace")
    if text.encode() != word:
        return [word]
    out = ["".join(f"{c}{mark}" for c in text)[:-1] for mark in ".-*"]
    for k in range(1, len(text)):
        out += [text[:k] + c + text[k:] for c in ".-x"] + [text[:k] + text[k - 1] + text[k:]]
    return [v.encode() for v in out]


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = COST) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine with squared hinge loss; y is -1 or 1. Rows are taken ``BLOCK`` at a time, so that no copy of all is made."""
    n = x.shape[1] + 1
    ridge = np.eye(n) / cost
    ridge[-1, -1] = 1e-6
    w = np.zeros(n)
    for _ in range(50):
        square, side = ridge.copy(), np.zeros(n)
        for at in range(0, len(x), BLOCK):
            part = slice(at, at + BLOCK)
            x1 = np.hstack([x[part], np.ones((len(x[part]), 1))])
            active = y[part] * (x1 @ w) < 1
            xs = x1[active] * weight[part][active, None]
            square += xs.T @ x1[active]
            side += xs.T @ y[part][active]
        after = np.linalg.solve(square, side)
        if np.allclose(after, w, atol=1e-9):
            break
        w = after
    return w[:-1], float(w[-1])


def _pieces(low: bytes) -> set[bytes]:
    """The bare units of a text, long ones as windows."""
    return {p for w in units(low) for p in windows(w.strip(_EDGES))}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition: each unit's number of clean and of toxic documents."""
    by = (Counter(), Counter())
    for b in batches:
        for y, t in zip(b.column("y").to_pylist(), b.column("text").cast(pa.binary()), strict=True):
            by[y].update(_pieces(lowered(t.as_py())))
            if sum(map(len, by)) > MEMO_WORDS:
                yield _counts(by)
                by = (Counter(), Counter())
    yield _counts(by)


def _counts(by: tuple[Counter, Counter]) -> pa.RecordBatch:
    words = list(by[0].keys() | by[1].keys())
    return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([by[0][w] for w in words], pa.int64()), pa.array([by[1][w] for w in words], pa.int64())], names=["word", "clean", "toxic"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of toxic documents: which unit comes after which word."""
    for b in batches:
        found = set()
        for y, t in zip(b.column("y").to_pylist(), b.column("text").cast(pa.binary()), strict=True):
            if y:
                row = [w.strip(_EDGES) for w in lowered(t.as_py()).split()]
                found |= {(p, before) for before, w in zip([b"", *row], row, strict=False) for p in windows(w)}
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.binary()), pa.array([c for _, c in found], pa.binary())], names=["word", "before"])


def _sentence_rows(machine: Machine):
    """Of labelled documents: the sentences with units near a landmark, whether they hold one as it is written, and their features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = set(machine.landmarks)
        for b in batches:
            rows = []
            texts = [t.as_py() for t in b.column("text").cast(pa.binary())]
            for bag, y, found in zip(b.column("bag").to_pylist(), b.column("y").to_pylist(), machine.look(texts), strict=True):
                rows += [(bag, y, not marks.isdisjoint(p for w in u for p in windows(w.strip(_EDGES))), f.tolist()) for u, f in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.float32())))], names=["bag", "y", "exact", "f"]
            )

    return run


def landmarks(texts: DataFrame, most: int = LANDMARKS) -> list[bytes]:
    """The landmarks of labelled ``texts`` (text, y), the ones of most contexts first."""
    counts = texts.mapInArrow(_count, "word binary, clean bigint, toxic bigint").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).cache()
    try:
        n = {r["y"]: r["count"] for r in texts.groupBy("y").count().collect()}
        if not n.get(0) or not n.get(1):
            return []
        # So many contexts that chance alone gives less than one unit all of whose documents are toxic.
        often = counts.filter("clean + toxic >= 3").count()
        least = max(3, math.ceil(math.log(max(often, 1)) / math.log((n[0] + n[1]) / n[1])))
        odd = counts.filter((F.col("toxic") >= least) & (F.col("clean") * n[1] * 100 <= F.col("toxic") * n[0])).select("word")
        seen = texts.mapInArrow(_contexts, "word binary, before binary").join(odd, "word", "left_semi").groupBy("word").agg(F.countDistinct("before").alias("n"))
        return [bytes(r["word"]) for r in seen.filter(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(most).collect()]
    finally:
        counts.unpersist()


def _times(f: np.ndarray, by: np.ndarray) -> np.ndarray:
    """``f @ by`` in double precision, ``BLOCK`` rows at a time."""
    out = np.empty((len(f), *by.shape[1:]))
    for at in range(0, len(f), BLOCK):
        out[at : at + BLOCK] = f[at : at + BLOCK].astype(np.float64) @ by
    return out


def _columns(rows: list[tuple[int, int, bool, list[float]]], n_marks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """bag, y, exact and the features (a row for each sentence, single precision) of rows as ``trained`` takes them."""
    f = np.array([r[3] for r in rows], dtype=np.float32).reshape(len(rows), n_marks)
    bag, y, exact = (np.array([r[k] for r in rows], dtype=np.int64) for k in range(3))
    return bag, y, exact, f


def _fetched(rows: DataFrame, n_marks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``_columns``, of a table (bag, y, exact, f); it comes as Arrow columns, so the driver makes no object for each number."""
    got = rows.toArrow()
    f = pc.list_flatten(got.column("f")).to_numpy().reshape(got.num_rows, n_marks)
    bag, y, exact = (got.column(c).cast(pa.int64()).to_numpy() for c in ("bag", "y", "exact"))
    return bag, y, exact, f


def trained(marks: list[bytes], rows: list[tuple[int, int, bool, list[float]]]) -> Machine:
    """The machine of sentences (bag, y, whether a landmark is in it, features)."""
    return _trained(marks, *_columns(rows, len(marks)))


def _trained(marks: list[bytes], bag: np.ndarray, y: np.ndarray, exact: np.ndarray, f: np.ndarray) -> Machine:
    machine = Machine(marks, np.zeros(len(marks)), FLOOR)
    k = machine.features(marks)
    misspelt = np.vstack([machine.features([v for w in marks for v in _variants(w)]), k])
    k = k.astype(np.float64)
    # Nyström: a linear machine on K(., landmarks) K(landmarks, landmarks)^(-1/2)
    values, vectors = np.linalg.eigh((k + k.T) / 2)
    root = vectors / np.sqrt(np.maximum(values, 1e-3)) @ vectors.T
    chosen = (y == 1) & (exact == 1)
    w, bias = np.zeros(len(marks)), FLOOR
    for _ in range(ROUNDS):
        good, bad = int(chosen.sum()), int((y == 0).sum())
        # All sentences without a near unit are one point, the origin.
        x = _times(np.vstack([f[chosen], misspelt, f[y == 0], np.zeros((1, len(marks)), np.float32)]), root)
        side = np.array([1.0] * (good + len(misspelt)) + [-1.0] * (bad + 1))
        heavy = max(1.0, NEGATIVE_SHARE * max(good, 1) / (bad + 1))
        weight = np.array([1.0] * good + [VARIANT_WEIGHT * max(1.0, good / len(misspelt))] * len(misspelt) + [heavy] * (bad + 1))
        w, bias = svm(x, side, weight / max(1.0, good / 1000))
        margin = _times(f, root @ w) + bias
        best: dict[int, int] = {}
        for i in np.flatnonzero(y == 1):
            if bag[i] not in best or margin[i] > margin[best[bag[i]]]:
                best[bag[i]] = i
        after = chosen.copy()
        after[[i for i in best.values() if margin[i] > 0]] = True
        if (after == chosen).all():
            break
        chosen = after
    return Machine(marks, root @ w, bias - _border(bag, y, _times(f, root @ w) + bias))


def _border(bag: np.ndarray, y: np.ndarray, margin: np.ndarray) -> float:
    """Where the documents' largest margins are told apart at the least cost; of equal borders the middle of the widest gap."""
    most: dict[int, tuple[float, int]] = {}
    for b, c, m in zip(bag.tolist(), y.tolist(), margin.tolist(), strict=True):
        most[b] = max(most.get(b, (-math.inf, c)), (m, c))
    if not most:
        return FLOOR
    points = sorted(most.values())
    lost = sum(1 - c for _, c in points)  # clean documents above the border
    missed, edges = 0, [(FLOOR, CLEAN_COST * lost, 0.0)]
    for (m, c), above in zip(points, [*(p[0] for p in points[1:]), 3.0], strict=True):
        missed, lost = missed + c, lost - (1 - c)
        if above > m:
            edges.append(((m + above) / 2, missed + CLEAN_COST * lost, above - m))
    return min(edges, key=lambda e: (e[1], -e[2]))[0]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = FIT_ROWS) -> Machine:
    """Fit on ``rows`` labelled rows of ``docs`` at most, none of them held out."""
    texts = training_texts(docs, labels, label, rows).select("text", "y").dropDuplicates(["text", "y"]).cache()
    try:
        marks = landmarks(texts)
        if not marks:
            return Machine([], np.empty(0), FLOOR)
        bags = texts.select(F.xxhash64("text").alias("bag"), "text", "y")
        found = bags.mapInArrow(_sentence_rows(Machine(marks, np.zeros(len(marks)), FLOOR)), "bag bigint, y int, exact boolean, f array<float>").cache()
        own = [_fetched(found.filter(F.col("y") == c).orderBy(F.xxhash64("bag"), "bag", "f").limit(SENTENCES), len(marks)) for c in (0, 1)]
        found.unpersist()
    finally:
        texts.unpersist()
    machine = _trained(marks, *(np.concatenate(c) for c in zip(*own, strict=True)))
    del own
    give_back()
    return machine


def _texts(b: pa.RecordBatch) -> Iterator[bytes | None]:
    return (t.as_py() for t in b.column(b.schema.get_field_index("text")).cast(pa.binary()))


def _scorer(machine: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Machine(machine.landmarks, machine.weights, machine.bias)  # with a memory of its own, which goes with the task
        for b in batches:
            for at in range(0, b.num_rows, 250):
                part = b.slice(at, 250)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(own.scores(_texts(part)), pa.float64())], names=["doc_id", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` for each row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(giving_back(_scorer(fit(docs, labels, rows=rows))), f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _keeper(machine: Machine, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Machine(machine.landmarks, machine.weights, machine.bias)
        for b in batches:
            for at in range(0, b.num_rows, 250):
                part = b.slice(at, 250)
                yield part.filter(pa.array(own.scores(_texts(part)) < threshold, pa.bool_()))

    return run


def keep_clean(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, rows: int = FIT_ROWS) -> DataFrame:
    """Rows of ``docs`` that aren't toxic, with all their columns; the machine is fitted on labelled rows among them."""
    return docs.mapInArrow(giving_back(_keeper(fit(docs, labels, rows=rows), threshold)), docs.schema)
