"""Language-model scores by prediction by partial matching over bytes.

The model is a trie of byte contexts, four bytes deep, counted over all training
documents. A byte is predicted in its longest context that occurs in training. A
context gives a byte that followed it count / (n + d), of n occurrences and d
different followers, and keeps d / (n + d) for escape (method C) to the context
that is one byte shorter; there, bytes that the longer context could have given are
excluded from n and d. Below the empty context, the bytes not yet seen are alike.

A text is its lower-cased words (A-Z), one space between, and a line break as end;
before it stand four line breaks, so that every byte has a full context, and
followers of a context also follow every shorter one.

Nothing is broadcast but two numbers, and no task holds the trie. Texts are dealt
in blocks. A block lists its distinct five-byte strings and word hashes; Spark
sums their training counts, derives each string's probability level by level with
joins and aggregations, and sends back to each block what it listed. A block's part
of the model is thus never larger than its text.

Also given are the scores of a unigram model of words with one added to each count.
Words are counted by 64-bit hashes.

Cases: a null text is empty, and an empty text is the end alone. A row with a null
id belongs to training. Repeated rows are counted and scored each. An empty table
gives no rows; if no row is in training, every byte has 1/256. Other columns,
whatever their names, are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm import scratch

DEPTH = 4
END = b"\n"
#: Bytes of text in a block, unless one document has more; bytes of text that numpy sees at once.
BLOCK_BYTES, STEP_BYTES = 32 << 20, 2 << 20
TEXT, GRAM, WORD = 0, 1, 2
_END_HASH = np.int64(xxhash.xxh3_64_intdigest(END) - (1 << 64) if xxhash.xxh3_64_intdigest(END) >> 63 else xxhash.xxh3_64_intdigest(END))


def held_out(doc_id: str = "doc_id"):
    """Whether a row isn't learnt from: crc32 of the id as text leaves 2 when divided by 7."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def canonical(text: bytes | None) -> bytes:
    return b" ".join((text or b"").lower().split()) + END


def grams(texts: list[bytes]) -> np.ndarray:
    """The code of each byte of the texts with the four bytes before it."""
    if not texts:
        return np.empty(0, dtype=np.int64)
    raw = np.frombuffer(b"".join(END * DEPTH + t for t in texts), dtype=np.uint8).astype(np.int64)
    code = raw[DEPTH:].copy()
    for back in range(1, DEPTH + 1):
        code |= raw[DEPTH - back : len(raw) - back] << (8 * back)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + DEPTH
    real = np.ones(len(code), dtype=bool)
    for back in range(1, DEPTH + 1):  # the padding before each text but the first
        real[np.cumsum(sizes)[:-1] - back] = False
    return code[real]


def word_hashes(texts: list[bytes]) -> np.ndarray:
    """Hashes of the words of each text in order, each followed by the end's."""
    words = [w for t in texts for w in (*t.split(), END)]
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words)).view(np.int64)


class _Block:
    """Distinct strings and words of a block with their training counts."""

    def __init__(self) -> None:
        self.bytes = 0
        self.found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {GRAM: [], WORD: []}

    def add(self, kind: int, codes: np.ndarray, train: bool) -> None:
        keys, n = np.unique(codes, return_counts=True)
        self.found[kind].append((keys, n if train else np.zeros(len(n), dtype=np.int64)))
        if len(self.found[kind]) >= 16:
            self.found[kind] = [self.total(kind)]

    def total(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        parts = self.found[kind]
        if not parts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64)


def _gather(id_type: pa.DataType | None = None):
    def rows(kind: int, block: int, ids: pa.Array, out: list[bool], texts: list[bytes]) -> pa.RecordBatch:
        n = len(texts)
        none = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), none, none, ids, pa.array(out, pa.bool_()), pa.array(texts, pa.binary()), pa.array([kind] * n, pa.int32())], names=_NAMES)

    def counted(kind: int, block: int, keys: np.ndarray, n: np.ndarray, ids: pa.DataType) -> pa.RecordBatch:
        m = len(keys)
        return pa.RecordBatch.from_arrays([pa.array(np.full(m, block)), pa.array(keys), pa.array(n), pa.nulls(m, ids), pa.nulls(m, pa.bool_()), pa.nulls(m, pa.binary()), pa.array(np.full(m, kind, np.int32))], names=_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, kept, ids_type = TaskContext.get().partitionId() << 24, _Block(), None
        for b in batches:
            ids_type = b.schema.field(0).type
            flags = b.column(2).to_pylist()
            texts = [canonical(t.as_py()) for t in b.column(1).cast(pa.binary())]
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= STEP_BYTES):
                    size += len(texts[to])
                    to += 1
                if kept.bytes and kept.bytes + size > BLOCK_BYTES:
                    for kind in (GRAM, WORD):
                        yield counted(kind, block, *kept.total(kind), ids_type)
                    block, kept = block + 1, _Block()
                kept.bytes += size
                for train in (True, False):
                    own = [t for t, out in zip(texts[at:to], flags[at:to], strict=True) if out != train]
                    if own:
                        kept.add(GRAM, grams(own), train)
                        kept.add(WORD, word_hashes(own), train)
                yield rows(TEXT, block, b.column(0).slice(at, to - at), flags[at:to], texts[at:to])
                at = to
        if ids_type is not None:
            for kind in (GRAM, WORD):
                yield counted(kind, block, *kept.total(kind), ids_type)

    return run


_NAMES = ["block", "code", "n", "doc_id", "held_out", "bytes", "kind"]


def log_probabilities(counts: DataFrame) -> DataFrame:
    """(code, value): log10 of the probability of the last byte of each five-byte string after the first four.

    ``counts`` has (code, n) for all strings of interest, n being the training count, perhaps 0.
    One table is written for each depth of the trie.
    """
    spark = counts.sparkSession
    whole, whole_path = scratch.table(counts, "ppm-counts")
    paths = [whole_path]
    below = contexts = None
    for k in range(DEPTH + 1):
        cut = lambda column, size: F.col(column).bitwiseAND(F.lit((1 << 8 * size) - 1))
        level = whole.groupBy(cut("code", k + 1).alias("code")).agg(F.sum("n").alias("n"))
        level = level.select("code", "n", F.shiftright("code", 8).alias("context"), cut("code", k).alias("shorter") if k else F.lit(0).cast("bigint").alias("shorter"))
        if k:
            level = level.join(below.select(F.col("code").alias("shorter"), F.col("n").alias("n1"), F.col("e").alias("e1"), F.col("p").alias("p1")), "shorter")
        else:
            level = level.withColumns({"n1": F.lit(0).cast("bigint"), "e1": F.lit(0.0), "p1": F.lit(1 / 256)})
        level, path = scratch.table(level, f"ppm-level{k}")
        paths.append(path)
        own = level.filter("n > 0").groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum("n1").alias("taken"))
        if k:  # what the shorter context has left when this one's followers are excluded
            up = contexts.select(F.col("context").alias("suffix"), F.col("total").alias("total1"), F.col("kinds").alias("kinds1"))
            own = own.withColumn("suffix", F.col("context").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)) if k > 1 else F.lit(0).cast("bigint")).join(up, "suffix")
            own = own.select("context", "total", "kinds", (F.col("kinds1") - F.col("kinds")).alias("new"), (F.col("total1") - F.col("taken") + F.col("kinds1") - F.col("kinds")).alias("left"))
        else:
            own = own.select("context", "total", "kinds", (256 - F.col("kinds")).alias("new"), (256 - F.col("kinds")).alias("left"))
        contexts, path = scratch.table(own, f"ppm-contexts{k}")
        paths.append(path)
        both = level.join(contexts, "context", "left")
        if k:
            e = F.when(F.col("n1") > 0, F.col("n1") / F.greatest("left", F.lit(1))).otherwise(F.when(F.col("left") > 0, F.col("new") / F.greatest("left", F.lit(1))).otherwise(1.0) * F.col("e1"))
        else:
            e = 1 / F.greatest("left", F.lit(1))
        p = F.when(F.col("n") > 0, F.col("n") / (F.col("total") + F.col("kinds"))).when(F.col("total").isNotNull(), F.col("kinds") / (F.col("total") + F.col("kinds")) * e).otherwise(F.col("p1"))
        below, path = scratch.table(both.select("code", "n", F.when(F.col("n") == 0, e).otherwise(0.0).alias("e"), p.alias("p")), f"ppm-below{k}")
        paths.append(path)
    scratch.drop(spark, *paths[:-1])
    return below.select("code", F.log10("p").alias("value"))


def _score(total: int, kinds: int):
    """For a cogrouped block: its texts, and the values of its strings and counts of its words."""
    floor = math.log10(total + kinds + 1)

    def values(keys: np.ndarray, of: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        return of[np.searchsorted(keys, wanted)]

    def run(texts: pa.Table, slice_: pa.Table) -> pa.Table:
        kind, code, value = (slice_.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("kind", "code", "value"))
        own = {}
        for k in (GRAM, WORD):
            keys, of = code[kind == k], value[kind == k]
            order = np.argsort(keys)
            own[k] = keys[order], of[order]
        raw = [t.as_py() for t in texts.column("bytes")]
        n_tokens, n_known, base, score = [], [], [], []
        at = 0
        while at < len(raw):
            to, size = at, 0
            while to < len(raw) and (to == at or size + len(raw[to]) <= STEP_BYTES):
                size += len(raw[to])
                to += 1
            some = raw[at:to]
            starts = np.cumsum([0, *map(len, some)])[:-1]
            score.append(np.add.reduceat(values(*own[GRAM], grams(some)), starts))
            hashes = word_hashes(some)
            c = values(*own[WORD], hashes)
            ends = np.flatnonzero(hashes == _END_HASH)
            first = np.concatenate([[0], ends[:-1] + 1])
            base.append(np.add.reduceat(np.log10(c + 1) - floor, first))
            n_known.append(np.add.reduceat((c > 0).astype(np.int64), first))
            n_tokens.append(ends + 1 - first)
            at = to
        columns = [texts.column("doc_id"), texts.column("held_out"), *(pa.array(np.concatenate(x)) if x else pa.array([], t) for x, t in ((n_tokens, pa.int64()), (n_known, pa.int64()), (base, pa.float64()), (score, pa.float64())))]
        return pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` for each row of ``docs``."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"block bigint, code bigint, n bigint, doc_id {kind}, held_out boolean, bytes binary, kind int"
    gathered = docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(_gather(), schema)
    path = scratch.new_path(spark, "ppm-gathered")
    gathered.write.partitionBy("kind").option("compression", "zstd").parquet(path)
    gathered = spark.read.schema(schema).parquet(path)
    strings = gathered.filter(F.col("kind") == GRAM).select("block", "code", "n")
    words = gathered.filter(F.col("kind") == WORD).select("block", "code", "n")
    counts = words.groupBy("code").agg(F.sum("n").alias("n"))
    counts, _ = scratch.table(counts, "ppm-words")
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count_if(F.col("n") > 0).alias("kinds")).first()
    model = log_probabilities(strings.groupBy("code").agg(F.sum("n").alias("n")))
    of_strings = strings.select("block", "code").join(model, "code").select(F.col("block").alias("for_block"), F.lit(GRAM).alias("kind"), "code", "value")
    of_words = words.select("block", "code").join(counts, "code").select(F.col("block").alias("for_block"), F.lit(WORD).alias("kind"), "code", F.col("n").cast("double").alias("value"))
    texts = gathered.filter(F.col("kind") == TEXT).select("block", "doc_id", "held_out", "bytes")
    scored = texts.groupBy("block").cogroup(of_strings.unionByName(of_words).groupBy("for_block")).applyInArrow(
        _score(int(sums["total"]), int(sums["kinds"])), f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    )
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(sums["total"])).cast("bigint").alias("train_tokens"), "base_score", "score")
