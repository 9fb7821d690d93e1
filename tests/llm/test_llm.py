"""The training-data operators against brute force, and on nulls, empty texts, ties, repeats and empty tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow.orc as orc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestream.llm import attribution, chat, decontaminate, linecrf, minhash, packing, ppm, quality, scratch, shingles, token_orc, toxicity
from lodestream.llm import tokenization as tk

WORDS = "the of tion ing alpha beta gamma delta eps zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau ups phi chi psi omega ärger öde façon niño".split()
#: Extra columns whose names the operators use themselves.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, kept boolean, row string, ids string, x int, word string, bands int, kept_id int, leaky_id int"


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ".", ","]) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, *[None] * 12) for i, t in rows], SCHEMA)


ODD = [(1, None), (2, ""), (3, " \t\n "), (None, "null id has some words here"), (None, None), (4, "x" * 5000), (5, "a b ß İ é \U0001f600 <|endoftext|>"), (5, "a b ß İ é \U0001f600 <|endoftext|>"), (5, "other text of that id")]


@pytest.fixture(scope="module")
def tokenizer():
    return tk.load(tk.WORD_BPE)


def ids_of(tokenizer, text, end):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("abß Éé'sdt12<|>. \n\t")), max_size=40))
def test_memo_gives_the_tokenizers_ids(text):
    memo = tk.memo(tk.WORD_BPE)
    assert np.frombuffer(memo.encode(text.encode()), dtype="<u4").tolist() == memo.tokenizer.encode(text, add_special_tokens=False).ids


def test_simple_texts_are_encoded_by_parts_and_other_ones_by_words(monkeypatch):
    """A text of simple words asks the model for each new part alone; words with other punctuation or capitals cost nothing more."""
    memo, asked = tk.WordMemo(), []
    one = memo.parts.tokenize
    memo.parts.tokenize = lambda part: asked.append(part) or one(part)
    for text in ["Thonely thonely, THONELY! don't", "thonely.\u0020\x0bdon't thonely,\tétée"]:
        assert np.frombuffer(memo.encode(text.encode()), dtype="<u4").tolist() == memo.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(asked) == len(set(asked)) == 7 and not memo
    odd = "thonely 中文 <|x|> thonely"
    assert np.frombuffer(memo.encode(odd.encode()), dtype="<u4").tolist() == memo.tokenizer.encode(odd, add_special_tokens=False).ids
    assert sorted(memo) == sorted(set(odd.encode().split()))
    monkeypatch.setattr(tk, "PIECE", 7)  # a long text is cut at white space
    long = " ".join(f"Thonely{k}, don't 中" for k in range(40))
    assert np.frombuffer(memo.encode(long.encode()), dtype="<u4").tolist() == memo.tokenizer.encode(long, add_special_tokens=False).ids


def test_token_orc(spark, tokenizer, tmp_path):
    rows = ODD + [(k, prose(k % 50, k)) for k in range(10, 300)]
    path = str(tmp_path / "t")
    token_orc.write_tokens(docs(spark, rows), path, shards=3)
    got = token_orc.token_digest(token_orc.read_tokens(spark, path)).collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((i or -1, len(x), crc(x)) for i, t in rows for x in [ids_of(tokenizer, t, 1)])
    at, last = 0, -1
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and (r["doc_id"] or -1) >= last
        at, last = at + r["n_tokens"], r["doc_id"] or -1
    one = token_orc.read_tokens(spark, path).filter("doc_id = 77").collect()
    assert [list(r["ids"]) for r in one] == [ids_of(tokenizer, dict(rows)[77], 1)]
    files = list((tmp_path / "t" / "data").glob("*.orc"))
    assert sum(orc.ORCFile(f).nrows for f in files) == len(rows) and all(orc.ORCFile(f).row_index_stride == 1000 for f in files)


def test_packing(spark, tokenizer, tmp_path):
    for n in (1, 2, 3, 4095, 4096, 4097, 12345):
        cut = packing.pieces(n)
        assert [a for a, _ in cut] == list(np.cumsum([0] + [x for _, x in cut])[:-1]) and sum(x for _, x in cut) == n
        assert all(x & (x - 1) == 0 and x <= 4096 for _, x in cut)
    rows = ODD + [(9, prose(6000, 9))]
    packing.write_sequences(docs(spark, rows), str(tmp_path / "p"))
    got = packing.piece_digest(packing.read_sequences(spark, str(tmp_path / "p"))).collect()
    want = sorted((i or -1, a, n, crc(x[a : a + n]), len(x)) for i, t in rows for x in [ids_of(tokenizer, t, 2)] for a, n in packing.pieces(len(x)))
    assert sorted((r["doc_id"] or -1, r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    assert len({r["sequence_id"] for r in got}) == len(got) and {r["offset"] for r in got} == {0}
    with pytest.raises(ValueError):
        packing.write_sequences(docs(spark, rows), str(tmp_path / "q"), longest=100)


def brute_components(rows):
    def sets(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    s = [sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if s[a] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(s[k]), least[find(k)], i == least[find(k)]) for k, (i, _) in enumerate(rows))


def test_minhash_is_brute_force(spark, monkeypatch):
    r = random.Random(5)
    rows = [(k, prose(r.randint(0, 60), k)) for k in range(60)]
    for k in range(60, 200):  # near copies at many distances, chains of them, and exact ones
        words = rows[r.randrange(len(rows))][1].split()
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            if words:
                words[r.randrange(len(words))] = "changed" + str(k)
        rows.append((k, (" " if k % 2 else "\n").join(words).upper() if k % 3 == 0 else " ".join(words)))
    rows += [(900, None), (901, ""), (902, " \n"), (7, rows[7][1])]
    want = brute_components(rows)
    assert sorted(map(tuple, minhash.near_duplicates(docs(spark, rows)).collect())) == want
    # The exact way, and keys so small that stars are salted and bands cut into blocks.
    monkeypatch.setattr(minhash, "SHARE", 2)
    monkeypatch.setattr(minhash, "BLOCK", 3)
    assert sorted(map(tuple, minhash.near_duplicates(docs(spark, rows), may_differ=None).collect())) == want


def test_blocks_let_each_pair_of_a_band_meet_once(spark):
    rows = spark.range(200).selectExpr("id as node", "id % 3 as band", "bigint(1 + id % 3 * 4) as blocks")
    a, b = minhash._in_blocks(rows, True), minhash._in_blocks(rows, False)
    met = a.alias("a").join(b.alias("b"), ["band", "one", "two"]).filter("a.node <> b.node and (one <> two or a.node < b.node)").selectExpr("least(a.node, b.node) as u", "greatest(a.node, b.node) as v")
    assert sorted(map(tuple, met.collect())) == [(u, v) for u, v in combinations(range(200), 2) if u % 3 == v % 3]


def test_minhash_null_ids_and_empty_table(spark):
    got = minhash.near_duplicates(docs(spark, [(None, prose(20, 1)), (3, prose(20, 1)), (4, "")])).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got if r["doc_id"]) == [(3, None, False), (4, 4, True)]
    assert minhash.near_duplicates(docs(spark, [])).count() == 0
    assert minhash.keep_one(docs(spark, [(1, prose(20, 1)), (2, prose(20, 1)), (None, "z")])).count() == 2


def test_circulant_signatures_estimate_the_similarity():
    r = np.random.default_rng(1)
    a = np.unique(r.integers(0, 1 << 63, 1500).astype(np.uint64))
    b = np.unique(np.concatenate([a[:1200], r.integers(0, 1 << 63, 200).astype(np.uint64)]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    both = [shingles.circulant_signature(x, 512, 3) for x in (a, b)]
    assert abs((both[0] == both[1]).mean() - true) < 0.08


def labelled(n, seed):
    """Documents, and labels of most: bad ones shout or repeat words, toxic ones hold an insult."""
    rows, labels = [], []
    for k in range(n):
        text = prose(60, seed + k)
        bad, toxic = k % 7 == 3, k % 5 == 1
        if bad:
            text = " ".join(w.upper() + "!!" for w in text.split()) if k % 2 else " ".join([w for w in text.split() for _ in range(8)])
        if toxic:
            words = text.split()
            words.insert((k * 7) % len(words), ["blorgnak", "fenwizzle"][k % 2])
            text = " ".join(words)
        rows.append((k, text))
        labels.append((k, int(not bad), int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def marked(spark):
    rows, labels = labelled(400, 100)
    own = spark.createDataFrame([*labels, (None, 1, 0), (5000, 0, 1), (7, None, None)], "doc_id bigint, quality int, toxic int")
    return docs(spark, rows + ODD), own, labels


def test_quality(spark, marked):
    d, labels, known = marked
    got = {r["doc_id"]: r for r in quality.classify(d, labels).collect() if r["doc_id"] is not None and r["doc_id"] > 5}
    assert all(got[i]["predicted"] == q and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, q, _ in known if i > 5)
    assert d.count() == quality.classify(d, labels).count()
    assert set(quality.keep_good(d, labels).columns) == set(d.columns)
    none = quality.classify(d, labels.filter("quality = 1")).collect()
    assert all(0 <= r["score"] <= 1 for r in none)
    assert quality.classify(docs(spark, []), labels).count() == 0


@pytest.mark.parametrize(("pooled", "diagonal"), [(0.0, 0.0), (0.5, 0.3), (1.0, 1.0)])
def test_discriminant_is_the_gaussian_formula(pooled, diagonal):
    r = np.random.default_rng(2)
    width = len(quality.STATISTICS)
    x = {c: r.normal(c, 1 + c, (500 + 100 * c, width)) for c in (0, 1)}
    sums = {c: np.concatenate([[len(v)], v.sum(0), (v.T @ v).ravel()]) for c, v in x.items()}
    model = quality.discriminant(sums, pooled, diagonal)
    own = {c: np.cov(x[c].T, bias=True) for c in (0, 1)}
    both = (500 * own[0] + 600 * own[1]) / 1100 + quality.FLOOR * np.eye(width)
    z = r.normal(0.5, 1, (20, width))
    logs = []
    for c in (0, 1):
        cov = (1 - diagonal) * ((1 - pooled) * own[c] + pooled * both) + diagonal * np.diag(np.diag(both))
        far = z - x[c].mean(0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", far, np.linalg.inv(cov), far) - 0.5 * np.linalg.slogdet(cov)[1])
    odds = logs[1] - logs[0] + math.log(601 / 501)
    border = math.log(0.3 / 0.7)
    got = model.score(z)
    assert got == pytest.approx(1 / (1 + np.exp(-((odds - border) / width + border))), abs=1e-6)
    assert ((got >= 0.3) == (odds >= border)).all()


def test_statistics_are_brute_force():
    text = "AB ab ab! x#1 é.\n\nAB ab\nAB ab\n"
    words = text.lower().split()
    raw = text.encode()
    want = [
        math.sqrt(1 / len(raw)), math.sqrt(1 / len(words)), 6 / (6 + 9 + 1), math.sqrt(1 / len(raw)), math.sqrt(1 / len(words)), math.sqrt(4 / len(words)), 0.0,
        math.sqrt(1 - 2 / 3), math.log1p(len(set(words))) / math.log1p(len(words)), math.log1p((len(raw) - len(words)) / len(words)), math.log1p(len(words) / 3), math.log1p(len(words)),
    ]
    # Words are told apart as bytes, of which only A-Z are lowered; blanks count as bytes of words.
    assert quality.statistics(raw) == pytest.approx(want)
    assert quality.statistics(None).tolist() == quality.statistics(b" ").tolist() == [0.0] * len(want)
    eight = " ".join("abcdefgh")
    assert quality.statistics(f"{eight} {eight}".encode())[6] == pytest.approx(math.sqrt(1 / 9))


def brute_kernel(s, t, p, decay):
    from itertools import combinations

    def weights(w):
        out = defaultdict(float)
        for at in combinations(range(len(w)), p):
            out[tuple(w[k] for k in at)] += decay ** (at[-1] - at[0] + 1)
        return out

    a, b = weights(s), weights(t)
    return sum(v * b[k] for k, v in a.items() if k in b)


def test_kernel_is_brute_force():
    words = [b"idiot", b"i.d.i.o.t", b"toidi", b"abcabcab", b"xyz", b"xy"]
    got = toxicity.kernel(words, words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert got[i, j] == pytest.approx(brute_kernel(a, b, toxicity.ORDER, toxicity.DECAY), rel=1e-4, abs=1e-6)
    assert toxicity.paired_kernel(words, words) == pytest.approx(np.diag(got), rel=1e-4, abs=1e-6)


def test_toxicity(spark, marked):
    d, labels, known = marked
    got = {r["doc_id"]: r["predicted"] for r in toxicity.classify(d, labels).collect()}
    assert all(got[i] == t for i, _, t in known if i > 5)
    machine = toxicity.fit(d, labels)
    scores = machine.scores([b"the b.l.o.r.g.n.a.k tion", b"b l o r g n a k", b"blorxgnak", b"fenwizzle!", b"the of tion", b"", None])
    assert (scores[:4] >= 0.5).all() and (scores[4:] < 0.5).all()
    clean = toxicity.keep_clean(d, labels)
    assert clean.count() == toxicity.classify(d, labels).filter("predicted = 0").count()
    assert {r["predicted"] for r in toxicity.classify(d, labels.filter("toxic = 0")).collect()} == {0}
    assert toxicity.classify(docs(spark, []), labels).count() == 0


def test_features_are_brute_force():
    marks = [b"idiot", b"b\xc3\xb6seling", b"abc"]
    machine = toxicity.Machine(marks, np.ones(3), 0.0)
    words = [b"idiot", b"i.d.i.o.t", b"idxiot", b"ixxdxxixxoxxt", b"toidi", b"abcabc", b"axbxc", b"bo\xc3\xb6selingx", b"", b"zz"]
    got = machine.features(words)
    for i, w in enumerate(x.decode() for x in words):
        for j, m in enumerate(x.decode() for x in marks):
            pairs = set(zip(m, m[1:]))
            held = sum(any(0 < y - x <= toxicity.GAP + 1 for x in range(len(w)) for y in range(len(w)) if (w[x], w[y]) == p) for p in pairs)
            norm = math.sqrt(brute_kernel(w, w, 3, toxicity.DECAY) * brute_kernel(m, m, 3, toxicity.DECAY))
            near = held >= max(2, math.ceil(toxicity.NEAR * len(pairs) - 1e-6))
            assert got[i, j] == pytest.approx(brute_kernel(w, m, 3, toxicity.DECAY) / norm if near and norm else 0, rel=1e-3, abs=1e-6), (w, m)
    asked = {words[k] for k in np.flatnonzero(got.any(axis=1))}
    assert asked <= set(machine.lettered(words))
    # Marks between letters and up to two inserted letters leave every pair there: none of 6,000 such spellings is passed over.
    r = random.Random(3)
    spelt = []
    for m in (b"idiot", b"disgusting", b"worthless", b"scum", b"loser"):
        for _ in range(1200):
            spelt.append(b"".join(bytes([c]) + bytes(r.choice(b"xyzqaeio.-*") for _ in range(r.randint(0, 2))) for c in m))
    big = toxicity.Machine([b"idiot", b"disgusting", b"worthless", b"scum", b"loser"], np.ones(5), 0.0)
    assert len(big.lettered(spelt)) == len(spelt) and big.near(spelt).any(axis=1).all()


def test_units_are_cut_at_letters():
    assert toxicity.windows(b"") == [] and toxicity.windows(b"ab") == [b"^ab$"] and toxicity.windows(b"abc") == [b"abc"]
    assert toxicity.windows("坏蛋".encode()) == ["^坏蛋$".encode()] and toxicity.windows("大坏蛋".encode()) == ["大坏蛋".encode()]
    for word in ("坏蛋东西" * 30, "a" + "б" * 80, "é" * 33, "x" * 70):
        parts = [p.decode() for p in toxicity.windows(word.encode())]
        assert all(len(p) <= toxicity.WINDOW for p in parts) and all(any(word[i : i + 3] in p for p in parts) for i in range(len(word) - 2))
    assert toxicity.windows("é".encode() * 32) == ["é".encode() * 32]
    machine = toxicity.Machine([b"^ab$", "^坏蛋$".encode()], np.array([2.0, 2.0]), -1.0)
    assert (machine.scores([b"the ab.", "you 坏蛋!".encode(), b"cab", b"abc", "坏东蛋".encode(), b"\xff ab"]) >= 0.5).tolist() == [True, True, False, False, False, True]
    toxicity._variants("坏蛋".encode()), toxicity._variants(b"\xff\xfe")


@pytest.mark.parametrize("insult", ["坏蛋东西笨猪傻瓜蠢货烂人", "坏蛋", "a" + "бвгд" * 5, "ö" * 40])
def test_toxic_words_of_other_letters_are_learnt(spark, insult):
    """Long and short words whose letters are of two and three bytes, end to end."""
    rows, labels = [], []
    for k in range(300):
        toxic = k % 4 == 1
        rows.append((k, f"{prose(9, k)} {prose(1, 3 * k)} {insult} {prose(5, k + 1)}." if toxic else f"{prose(15, k)} 东西 ö {prose(3, k + 7)}."))
        labels.append((k, 1, int(toxic)))
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    d = d.unionByName(spark.sql("select 900L as doc_id, concat(cast(X'e5ff' as string), ' bad bytes') as text"))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.classify(d, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()}
    assert got == {k: int(k % 4 == 1) for k in range(300)} | {900: 0}


def test_sentences_pool_their_units():
    machine = toxicity.Machine([b"idiot", b"loser"], np.array([1.0, 0.5]), -1.0)
    text = "You idiot and l.o.s.e.r here. An idxiot there!\nnothing here? i d i o t".encode()
    (found,) = machine.look([text])
    f = {u: machine.features([toxicity.bare(u)])[0] for u in (b"idiot", b"l.o.s.e.r", b"idxiot")}
    want = sorted([np.maximum(f[b"idiot"], f[b"l.o.s.e.r"]).tolist(), f[b"idxiot"].tolist(), f[b"idiot"].tolist()])  # the last: letters apart
    got = sorted({tuple(x.tolist()) for _, x in found})
    assert np.allclose(got, want)
    assert machine.margins([text])[0] == pytest.approx(max(x @ machine.weights for x in map(np.array, want)) - 1.0, rel=1e-5)
    assert machine.margins([b"clean words", b"", None]).tolist() == [toxicity.FLOOR] * 3


def test_the_machine_is_the_least_of_its_loss():
    r = np.random.default_rng(7)
    x, y, weight = r.normal(0, 1, (60, 4)), np.where(r.random(60) < 0.5, 1.0, -1.0), r.random(60) + 0.1
    w, bias = toxicity.svm(x, y, weight, 3.0)

    def loss(v):
        return v[:-1] @ v[:-1] / 3.0 + 1e-6 * v[-1] ** 2 + (weight * np.maximum(0, 1 - y * (x @ v[:-1] + v[-1])) ** 2).sum()

    best = np.append(w, bias)
    assert all(loss(best) <= loss(best + d) + 1e-9 for d in r.normal(0, 0.05, (500, 5)))


def test_bags_find_the_sentence_that_is_the_reason():
    """Of toxic documents without a landmark as written the sentence nearest to one becomes positive; the border loses no clean document for a missed one."""
    marks = [b"blorgnak"]
    near, far = [0.8], [0.3]
    rows = [(k, 1, True, [1.0]) for k in range(20)] + [(100 + k, 1, False, near) for k in range(20)] + [(100 + k, 1, False, far) for k in range(20)]
    rows += [(200 + k, 0, False, far) for k in range(40)]
    machine = toxicity.trained(marks, rows)
    margin = lambda f: float(np.array(f) @ machine.weights + machine.bias)
    assert margin([1.0]) > 0 and margin(near) > 0 > margin(far)
    bag, y, m = np.arange(6), np.array([0, 0, 1, 0, 1, 1]), np.array([-1.0, 0.1, 0.2, 0.5, 0.6, 0.9])
    assert toxicity._border(bag, y, m) == pytest.approx(0.55)


def test_fitting_makes_no_object_for_each_number():
    """Of 32,000 sentences and 128 landmarks, as many as the driver may get: as lists of numbers, with copies of all in double precision, they took 347 MB."""
    import tracemalloc

    r = np.random.default_rng(3)
    marks = [b"".join(bytes([x]) for x in r.integers(97, 123, 6)) for _ in range(128)]
    y = np.repeat([0, 1], 16_000)
    f = (r.random((32_000, 128), dtype=np.float32) ** 8) * (r.random((32_000, 128)) < 0.05)
    tracemalloc.start()
    try:
        machine = toxicity._trained(marks, np.arange(32_000), y, y * (np.arange(32_000) % 3 == 0), f.astype(np.float32))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(machine.weights) == 128 and np.isfinite(machine.weights).all() and peak < 120e6


def test_features_are_fetched_as_columns(spark):
    rows = [(k, k % 2, k % 3 == 0, [float(k), k / 2]) for k in range(50)]
    table = spark.createDataFrame(rows, "bag bigint, y int, exact boolean, f array<float>")
    for got, want in zip(toxicity._fetched(table.orderBy("bag"), 2), toxicity._columns(rows, 2), strict=True):
        assert got.dtype == want.dtype and (got == want).all()
    assert [len(c) for c in toxicity._fetched(table.filter("y = 7").orderBy("bag").limit(3), 2)] == [0, 0, 0, 0]


def test_a_worker_that_forgets_gives_the_same_scores(monkeypatch):
    marks = [b"blorgnak", b"fenwizzle"]
    machine = toxicity.Machine(marks, np.array([2.0, 2.0]), -1.0)
    texts = [f"{prose(20, k)} {'blorgnak' if k % 3 == 0 else ''}".encode() for k in range(60)]
    want = [machine.scores([t])[0] for t in texts]
    monkeypatch.setattr(toxicity, "MEMO_WORDS", 5)
    again = toxicity.Machine(marks, np.array([2.0, 2.0]), -1.0)
    got = np.concatenate([again.scores(texts[k : k + 7]) for k in range(0, 60, 7)])
    assert got.tolist() == want and (got >= 0.5).sum() == 20


def brute_base(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    covered = {k for i, w in enumerate(windows) if n[w] > 1 for k in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def test_base_counts():
    texts = [None, "", " \n", prose(200, 1), "é ü|a <b>  x " * 30, "a\nb\na\n \n \nb", " ".join(prose(9, 3) for _ in range(4)), prose(8, 2), prose(30, 4) + " " + prose(30, 4)]
    for t in texts:
        assert linecrf.base_counts(None if t is None else t.encode()) == brute_base(t)


def test_viterbi_and_likelihood_are_brute_force():
    from itertools import product

    r = np.random.default_rng(4)
    field = linecrf.Field(r.normal(0, 1, (2, linecrf.FEATURES)), r.normal(0, 1, (2, 2)), r.normal(0, 1, 2))
    for n in (1, 2, 6):
        x = r.normal(0, 1, (n, linecrf.FEATURES))
        e = x @ field.emit.T

        def total(y):
            return field.first[y[0]] + sum(e[k, c] for k, c in enumerate(y)) + sum(field.move[a, b] for a, b in zip(y, y[1:], strict=False))

        assert tuple(field.labels(x)) == max(product((0, 1), repeat=n), key=total)


def test_line_crf(spark, marked):
    d, labels, known = marked
    out = linecrf.judge(d, labels)
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == d.count()
    assert np.mean([got[i]["kept"] == bool(q) for i, q, _ in known if i > 5]) > 0.97
    assert not got[2]["kept"] and got[2]["base_failed"]
    assert linecrf.judge(docs(spark, []), labels).count() == 0
    assert all(r["kept"] != r["base_failed"] for r in linecrf.judge(d, labels.filter("quality = 1")).collect())


def test_decontamination(spark):
    item = " ".join(f"word{k}" for k in range(40))
    swapped = " ".join("other" if k % 9 == 4 else w for k, w in enumerate(item.split()))
    far = " ".join("other" if k % 3 == 1 else w for k, w in enumerate(item.split()))
    rows = [(1, prose(30, 1) + " " + item + " " + prose(5, 2)), (2, swapped.upper() + "."), (3, far), (4, prose(100, 3)), (5, None), (6, " ".join(item.split()[:11])), (None, item), (None, item)]
    bench = spark.createDataFrame([(7, item), (8, "too short"), (9, None), (10, ""), (7, "another text of the same id " * 4)], "item_id bigint, text string")
    for blocks in (1 << 20, 30):  # one block, and several
        got = decontaminate.leaks(docs(spark, rows), bench, block_hashes=blocks).collect()
        assert sorted((r["doc_id"], r["item_id"], r["matched"]) for r in got if r["doc_id"]) == [(1, 7, 20), (2, 7, 18)]
        assert sum(r["doc_id"] is None for r in got) == 1
    assert sorted(r["doc_id"] for r in decontaminate.keep_clean(docs(spark, rows), bench).collect()) == [3, 4, 5, 6]
    assert decontaminate.leaks(docs(spark, []), bench).count() == 0
    assert decontaminate.leaks(docs(spark, rows), bench.limit(0)).count() == 0


def test_short_items_are_matched_whole(spark):
    item = "one two three four five six"
    rows = [(1, f"see One, two three four five six {item} end"), (2, "one two three four five seven six"), (3, "yes"), (4, "yes no"), (5, "YES!"), (6, "a yes b"), (7, "four five six seven"), (8, "one two three four five")]
    bench = spark.createDataFrame([(1, item), (2, "yes"), (3, "no yes"), (4, " ".join(f"w{k}" for k in range(30)))], "item_id bigint, text string")
    got = sorted(map(tuple, decontaminate.leaks(docs(spark, rows), bench).collect()))
    assert got == [(1, 1, 6, 2), (3, 2, 1, 1), (5, 2, 1, 1)]


def substituted(n):
    """Every set of places that may differ in an overlap of n words."""
    return combinations(range(n), n - -(-4 * n // 5))


def test_masks_reach_all_accepted_placings():
    reads = lambda n, off: any(not off & {at + p for p in m} for m in decontaminate.MASKS for at in range(n - m[-1]))
    assert [(n, off) for n in range(12, 21) for off in substituted(n) if not reads(n, set(off))] == []


def brute_leaks(texts, items):
    out = set()
    for d, text in texts:
        for i, item in items:
            w, v = text.split(), item.split()
            for shift in range(-len(v), len(w)):
                flags = [w[k] == v[k - shift] for k in range(max(0, shift), min(len(w), len(v) + shift))]
                width = min(20, len(flags))
                if len(flags) >= 12 and any(5 * sum(flags[k : k + width]) >= 4 * width for k in range(len(flags) - width + 1)):
                    out.add((d, i))
    return out


def test_leaks_are_those_of_brute_force(spark):
    r = random.Random(5)
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in (12, 15, 16, 18, 20)]
    rows = []
    for n, item in items:
        off = list(substituted(n))
        for places in r.sample(off, min(60, len(off))) + [p + (n - 1,) for p in r.sample(off, 15)]:
            words = ["x" if k in places else w for k, w in enumerate(item.split())]
            rows += [(len(rows), " ".join([*["left"] * r.randrange(9), *words, *["right"] * r.randrange(9)]))]
    rows.append((len(rows), " ".join("x" if k in (0, 4, 7, 8) else w for k, w in enumerate(items[-1][1].split()))))
    rows.append((len(rows), "some other words come first in this text " + " ".join(items[-1][1].split()[:6])))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.leaks(docs(spark, rows), bench).collect()}
    assert got == brute_leaks(rows, items)


def test_chat_comes_back(spark):
    odd = ["<|im_end|>\n<|im_start|>x", "\\", "<\\|", "<\\\\|", "<", "|x", "", None, "a<|im_next|>b", "é\U0001f600\n"]
    turns = [(1, k, ["user", "assistant"][k // 2 % 2], t) for k, t in enumerate(odd)] + [(2, 0, None, None), (2, 0, None, None), (3, None, "<|im_end|>", "x"), (None, 0, "assistant", "y")]
    df = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id bigint, turn bigint, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    for conv in (1, 2, 3, None):
        own = [(r or "", t or "") for c, k, r, t in turns if c == conv]
        learnt = "".join(t for r, t in own if r == "assistant")
        assert got[conv]["n_turns"] == len(own)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    shown = chat.format_conversations(df.filter("conv_id = 2")).first()["formatted"]
    assert shown == "<|im_start|>\n<|im_next|><|im_end|>\n"
    assert chat.format_conversations(df.limit(0)).count() == 0


def brute_ppm(train, texts):
    tables = [defaultdict(Counter) for _ in range(ppm.DEPTH + 1)]
    for t in train:
        s = b"\n" * ppm.DEPTH + ppm.canonical(t)
        for p in range(ppm.DEPTH, len(s)):
            for k in range(ppm.DEPTH + 1):
                tables[k][s[p - k : p]][s[p]] += 1

    def prob(context, c):
        out, seen = 1.0, set()
        for k in range(ppm.DEPTH, -1, -1):
            after = tables[k].get(context[ppm.DEPTH - k :])
            if not after:
                continue
            left = {x: n for x, n in after.items() if x not in seen}
            if c in left:
                return out * left[c] / (sum(left.values()) + len(left))
            if left:
                out *= len(left) / (sum(left.values()) + len(left))
            seen |= set(after)
        return out / (256 - len(seen))

    for t in texts:
        s = b"\n" * ppm.DEPTH + ppm.canonical(t)
        yield sum(math.log10(prob(s[p - ppm.DEPTH : p], s[p])) for p in range(ppm.DEPTH, len(s)))


def test_ppm_is_brute_force(spark, monkeypatch):
    rows = [(k, prose(k % 40, k)) for k in range(60)] + [(100, None), (101, ""), (102, " \t"), (103, "Zürich \U0001f600"), (None, "null id")]
    raw = [(t or "").encode() for _, t in rows]
    out = [zlib.crc32(str(i).encode()) % 7 == 2 if i is not None else False for i, _ in rows]
    train = [t for t, o in zip(raw, out, strict=True) if not o]
    counts = Counter(w for t in train for w in (*t.lower().split(), b"\n"))
    n, v = sum(counts.values()), len(counts)
    got = {r["doc_id"]: r for r in ppm.score(docs(spark, rows)).collect()}
    for (i, _), t, o, want in zip(rows, raw, out, brute_ppm(train, raw), strict=True):
        words = [*t.lower().split(), b"\n"]
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (o, len(words), sum(counts[w] > 0 for w in words), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), rel=1e-9)
        assert r["score"] == pytest.approx(want, rel=1e-9)
    assert ppm.score(docs(spark, [])).count() == 0


def test_ppm_blocks_split_anywhere(monkeypatch):
    monkeypatch.setattr(ppm, "STEP_BYTES", 7)
    texts = [ppm.canonical(prose(9, k).encode()) for k in range(4)] + [b"\n"]
    want = []
    for t in texts:
        s = b"\n" * ppm.DEPTH + t
        want += [int.from_bytes(s[p : p + ppm.DEPTH + 1], "big") for p in range(len(t))]
    assert ppm.grams(texts).tolist() == want


@pytest.mark.parametrize(("rule", "every"), [("most", None), ("first", None), ("most", 7), ("first", 7)])
def test_attribution_is_brute_force(spark, tokenizer, rule, every):
    """Sections are lines, or begin at given places (here after every seven characters)."""
    rows = [(k, t) for k, t in enumerate([None, "", "a", prose(300, 1), "one line\ntwo lines\n\nx!!! ???...", "é" * 50 + "ü\n" * 3, " \n lead", "abcdefghij" * 5])]
    given = every and F.sequence(F.lit(0), F.greatest(F.length(F.coalesce("text", F.lit(""))) - 1, F.lit(0)), F.lit(every))
    got = defaultdict(list)
    for r in attribution.section_tokens(docs(spark, rows), given, rule=rule).orderBy("doc_id", "section").collect():
        got[r["doc_id"]].append((r["start"], r["end"], r["n_tokens"]))
    for i, t in rows:
        t = t or ""
        bounds = list(range(0, max(1, len(t)), every)) if every else [0, *(k + 1 for k, c in enumerate(t[:-1]) if c == "\n")]
        edges = [*bounds, len(t)]
        n = [0] * len(bounds)
        for a, b in tokenizer.encode(t, add_special_tokens=False).offsets:
            held = [max(0, min(b, edges[k + 1]) - max(a, edges[k])) for k in range(len(bounds))]
            n[held.index(max(held)) if rule == "most" else max(k for k in range(len(bounds)) if bounds[k] <= a)] += 1
        assert got[i] == [(edges[k], edges[k + 1], n[k]) for k in range(len(bounds))]


def test_field_attribution(spark, tokenizer):
    df = spark.createDataFrame([(1, "A title", None, "body text here")], "doc_id bigint, a string, b string, c string")
    got = attribution.field_tokens(df, ["a", "b", "c"]).orderBy("section").collect()
    assert [r["n_tokens"] for r in got] == [2, 0, 3]
    with pytest.raises(ValueError):
        attribution.allocate(np.array([0]), np.array([0]), np.array([0]), 1, "none")


def test_scratch_tables_lie_in_the_shared_folder(spark):
    assert scratch.new_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_common_phrases_are_no_seeds(spark):
    """An opening that many items share pairs no document with all of them; a document that goes on like an item is still found."""
    for mask in decontaminate.MASKS:
        assert all(sum(a <= p < a + 6 for p in mask) <= 4 for a in range(12))
    items = [(k, "what is the value of " + " ".join(f"i{k}w{j}" for j in range(15))) for k in range(2000)]
    rows = [(k, " ".join(f"{prose(20, 3 * k + j)} what is the value of" for j in range(3)) + " " + prose(9, k)) for k in range(400)] + [(400, prose(9, 1) + " " + items[77][1])]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    seeds = decontaminate._seeds(bench.select("item_id", decontaminate.words(F.col("text")).alias("item_w")).withColumn("item_key", F.xxhash64("item_w")), decontaminate.MASKS)
    assert seeds.groupBy("seed_mask", "seed").count().agg(F.max("count")).first()[0] == 1
    assert [r["doc_id"] for r in decontaminate.leaks(docs(spark, rows), bench).collect()] == [400]


def test_long_texts_have_the_sets_of_their_words(monkeypatch):
    texts = [b"", b" ", b"a", b"x" * 50, prose(300, 4).encode() + b"\n" + b"y" * 40 + b" end", b"  " + prose(7, 1).encode() + b"\x0b\x0c "]
    want = [shingles.shingle_set(t).tolist() for t in texts]
    for piece in (1, 7, 64):
        monkeypatch.setattr(shingles, "PIECE", piece)
        assert [shingles.shingle_set(t).tolist() for t in texts] == want


def test_hits_of_a_long_text_carry_no_text(spark):
    """A text of 20,000 words that holds an item 200 times, 800 runs of seeds: copies of the text for each masked hit would be gigabytes."""
    item = " ".join(f"word{k}" for k in range(40))
    rows = [(1, " ".join(f"{item} {prose(60, k)}" for k in range(200))), (2, prose(50, 1))]
    bench = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    assert [tuple(r) for r in decontaminate.leaks(docs(spark, rows), bench).collect()] == [(1, 7, 20, 800)]


def test_pieces_find_what_whole_texts_hold(spark):
    item = " ".join(f"word{k}" for k in range(40))
    items = [(1, item), (2, "one two three four five six"), (3, "yes"), (4, prose(12, 8))]
    rows = [(k, f"{prose(k, k)} {' '.join(item.split()[k % 9 : 20 + k])} {prose(k % 7, 3)} {items[k % 4][1]} {prose(15, k)}") for k in range(30)] + [(30, "yes"), (31, "yes yes"), (32, None), (33, "")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted(map(tuple, decontaminate.leaks(docs(spark, rows), bench, piece=1 << 20).collect()))
    assert len({x[0] for x in want}) > 20 and len({x[1] for x in want}) == 4
    for piece in (1, 13):
        assert sorted(map(tuple, decontaminate.leaks(docs(spark, rows), bench, piece=piece).collect())) == want
