"""SimHash, vector codes and fill-in-middle against brute force, and on odd rows."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestream.llm import fim, simhash, vectorcode

ODD = ["", " ", "a", "a b", "A B c", "é", "日本 語 x", "\n", "x\ty\r\nz", "<P>", "a<S>b", "<<P", "S>", "abc1é2def", "🙂🙂a", None]


def drawn(rng, n):
    return "".join(rng.choice(["a", "Zb", "é", "日", "🙂", " ", "\n", "<", ">", "P", "1", "qwertz" * 3]) for _ in range(n))


# Fill-in-middle


def spelled(text, doc_id, seed=1):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fim_equals_regular_expressions(spark):
    rng = random.Random(3)
    texts = ODD + [drawn(rng, n) for n in (1, 2, 3, 7, 8, 9, 15, 16, 17, 63, 64, 65, 200) for _ in range(12)] + ["word " * 100_000, "x" * 300_000, "é" * 100_001]
    rows = [(k, t) for k, t in enumerate(texts)] + [(5, "same"), (5, "same"), (None, "no id é")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("output", F.lit(1)).withColumn("n", F.lit("clash"))
    made = fim.fill_in_middle(docs.repartition(3))
    got = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fim.restored().alias("back")).collect()
    want = [(i, *spelled(t, i), t or "") for i, t in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_fim_keeps_bytes_that_are_no_text(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.expr("cast(X'61ff62' as string)"), F.lit("c\n"), F.expr("cast(X'80' as string)")).alias("text"))
    made = fim.fill_in_middle(docs)
    want = hashlib.sha256(b"\x61\xff\x62c\n\x80").hexdigest()
    assert {r[0] for r in made.select(F.sha2(fim.restored(), 256)).collect()} == {want}


def test_fim_slices_and_places(spark, monkeypatch):
    rng = random.Random(5)
    raw = "".join(drawn(rng, 50) for _ in range(20)).encode()
    padded = np.frombuffer(raw + b"\0" * (8 - len(raw) % 8), dtype="<u8")
    letters = [chr(c).isascii() and chr(c).isalpha() for c in raw]
    assert (fim.letter_marks(padded).view(np.uint8)[: len(raw)] > 0).tolist() == letters
    places = fim.Places(fim.letter_marks(padded))
    at = np.arange(len(raw) + 1)
    assert places.rank(at).tolist() == [sum(letters[:k]) for k in at]
    assert places.after(np.arange(1, sum(letters) + 1)).tolist() == [k + 1 for k, x in enumerate(letters) if x]
    sizes = np.array([5, 1, 0, 9, 30, 2])
    assert list(fim._slices(sizes, 10)) == [(0, 3), (3, 4), (4, 5), (5, 6)]


def test_fim_of_an_empty_table(spark):
    assert fim.digest(fim.fill_in_middle(spark.createDataFrame([], "doc_id bigint, text string"))).count() == 0


# SimHash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_equal_counting(spark):
    rng = random.Random(2)
    texts = [*ODD, *(" ".join(rng.choice(["red", "Blue", "É", "x1", "日本"]) for _ in range(n)) for n in range(1, 40)), "tick tock " * 40_000]
    for t in texts:
        assert simhash.fingerprint(None if t is None else t.encode()) == plain_fingerprint(t)
    one = spark.createDataFrame([("red blue é",)], "t string").select(F.xxhash64("t")).first()[0]
    assert one % 2**64 == xxhash.xxh64_intdigest("red blue é".encode(), seed=42)  # of one shingle, its bits are the fingerprint
    assert simhash.fingerprint("RED blue\té".encode()) == one % 2**64


def clustered(rng, n):
    """Fingerprints of which many share a half, a quarter or nearly all bits."""
    base = [rng.getrandbits(64) for _ in range(6)]
    out = {0, 2**64 - 1}
    while len(out) < n:
        x = rng.choice(base)
        for _ in range(rng.randrange(9)):
            x ^= 1 << (rng.randrange(64) if rng.random() < 0.3 else rng.randrange(20))
        out.add(x)
    return [x - 2**64 if x >= 2**63 else x for x in out]


@pytest.mark.parametrize("crowded", [512, 40, 2])
def test_links_are_all_pairs_within_three_bits(spark, crowded):
    nodes = clustered(random.Random(crowded), 700)
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(x,) for x in nodes], "fp bigint"), crowded=crowded).collect()}
    want = {(a, b) for a in nodes for b in nodes if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert got == want and len(want) > 500


def test_simhash_components_equal_brute_force(spark):
    rng = random.Random(9)
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(200)) for _ in range(5)]
    texts = list(ODD)
    for b in base:
        for _ in range(12):
            w = b.split()
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(99)}"
            texts.append(" ".join(w))
    ids = [3 * k for k in range(len(texts))]
    rng.shuffle(ids)
    rows = [*zip(ids, texts), (ids[0], texts[0]), (ids[20], texts[20]), (None, "alone here with words")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("fp", F.lit("clash")).withColumn("label", F.lit(0))
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    root = {i: i for i, _ in prints if i is not None}
    changed = True
    while changed:
        changed = False
        for i, a in prints:
            for j, b in prints:
                if i is not None and j is not None and (a ^ b).bit_count() <= 3 and root[j] > root[i]:
                    root[j], changed = root[i], True
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect() if r["doc_id"] is not None)
    assert got == sorted((i, f"{f:016x}", root[i]) for i, f in prints if i is not None)
    assert len(set(root.values())) < len(root) - 10
    (alone,) = [r for r in simhash.near_duplicates(docs).collect() if r["doc_id"] is None]
    assert alone["component_id"] is None


def test_simhash_of_an_empty_table_and_of_more_bits(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp bigint"), bits=4)


# Vector codes


def test_nearest_equals_looking_at_all_entries():
    rng = np.random.default_rng(4)
    for width, spread, entries in ((4, 9, 64), (1, 3, 64), (8, 2**20, 200), (4, 2**29 - 2, 64), (3, 1, 5)):
        book = rng.integers(-spread, spread, (entries, width), endpoint=True)
        queries = np.vstack([rng.integers(-spread, spread, (500, width), endpoint=True), book, (book[:1] + book[1:2]) // 2])
        index, best = vectorcode.nearest(vectorcode.Gnat(book), book, queries)
        exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(q, e)) for e in book] for q in queries]
        assert best.tolist() == [min(d) for d in exact]
        assert index.tolist() == [d.index(min(d)) for d in exact]


def test_most_subtrees_are_left_out():
    rng = np.random.default_rng(1)
    book = np.repeat(rng.integers(-4000, 4000, (8, 4)), 16, axis=0) + rng.integers(-60, 60, (128, 4))
    seen = []
    tree = vectorcode.Gnat(book)
    plain = vectorcode.squared
    try:
        vectorcode.squared = lambda a, b: seen.append(len(a) * len(b)) or plain(a, b)
        vectorcode.nearest(tree, book, book[rng.integers(0, 128, 2000)] + rng.integers(-20, 20, (2000, 4)))
    finally:
        vectorcode.squared = plain
    assert sum(seen) < 0.4 * 2000 * 128


def coded(rows, parts, entries, rounds):
    """The codes by Python's integers and plain loops."""
    good = [(i, v, c) for i, v, c in rows if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) and abs(x) < 2**80 for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    good = [r for r in good if len(r[1]) == len(good[0][1])]
    ints = [[math.floor(x * 256) for x in v] for _, v, _ in good]
    width = len(ints[0]) // parts
    cut = lambda v, k: v[k * width : (k + 1) * width]
    books = [[cut(v, k) for v in ints[:entries]] for k in range(parts)]

    def best(k, v):
        d = [sum((a - b) ** 2 for a, b in zip(v, e)) for e in books[k]]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        after = []
        for k in range(parts):
            held = [[] for _ in books[k]]
            for v in ints:
                held[best(k, cut(v, k))[0]].append(cut(v, k))
            after.append([[sum(c) // len(h) for c in zip(*h)] if h else e for h, e in zip(held, books[k])])
        books = after
    found = [[best(k, cut(v, k)) for k in range(parts)] for v in ints]
    errors = [sum(d for _, d in f) for f in found]
    total = {}
    for (_, _, c), e in zip(good, errors):
        total[c] = total.get(c, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    most = 2**63 - 1
    return sorted(repr((i, "".join(f"{j:02x}" for j, _ in f), min(e, most), min(total[c], most), sha)) for (i, _, c), f, e in zip(good, found, errors))


@pytest.mark.parametrize("huge", [False, True])
def test_codes_equal_plain_loops(spark, huge):
    rng = random.Random(8)
    rows = [(k * 7 % 211, [rng.choice([0.0, 0.25, -0.001, 1.5, -2.0, rng.gauss(0, 1)]) for _ in range(12)], rng.choice([None, 1, 2])) for k in range(211)]
    rows += [(3, None, 1), (4, [1.0, None] + [0.0] * 10, 1), (5, [float("nan")] * 12, 1), (6, [float("inf")] + [0.0] * 11, 1), (7, [], 1), (8, [1.0] * 8, 1), (9, [1.0] * 11, 1), (None, [0.5] * 12, 2), rows[0], rows[1]]
    if huge:
        rows += [(500, [1e12, -1e12] * 6, 1), (501, [1e20] * 12, None), (502, [1e30] * 12, 1)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("code", F.lit("clash")).repartition(4)
    got = vectorcode.compress(vectors, parts=4, entries=9, rounds=2)
    assert sorted(repr(tuple(r)) for r in got.collect()) == coded(rows, 4, 9, 2)


def test_no_vectors_and_fewer_than_entries(spark):
    kind = "vec_id bigint, embedding array<float>, label int"
    assert vectorcode.compress(spark.createDataFrame([], kind)).count() == 0
    assert vectorcode.compress(spark.createDataFrame([(1, None, 1)], kind)).count() == 0
    rows = [(1, [0.5] * 16, 1), (2, [0.5] * 16, None)]
    assert sorted(repr(tuple(r)) for r in vectorcode.compress(spark.createDataFrame(rows, kind)).collect()) == coded(rows, 16, 64, 2)
