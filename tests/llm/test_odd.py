"""Very long texts and conversations, empty tables, pruning, training against enumeration, and the pipeline on planted rows."""

import random
import time
from itertools import product

import numpy as np
import pytest
from test_llm import docs, labelled, prose

import corpus_pipeline
from pyspark.sql import functions as F

from lodestream.llm import attribution, chat, decontaminate, linecrf, minhash, packing, ppm, quality, scratch, token_orc, toxicity


@pytest.fixture(scope="module")
def long_docs(spark):
    """Texts of some two megabytes: many words in one line, and one word."""
    many = prose(300_000, 1)
    return docs(spark, [(1, many), (2, many + " end"), (3, "x" * 2_000_000), (4, "short text of six words here")]), many


def test_long_texts(spark, long_docs, tmp_path):
    d, many = long_docs
    began = time.time()
    token_orc.write_tokens(d, str(tmp_path / "t"), shards=2)
    ids = {r["doc_id"]: r["n_tokens"] for r in token_orc.token_digest(token_orc.read_tokens(spark, str(tmp_path / "t"))).collect()}
    packing.write_sequences(d, str(tmp_path / "p"))
    pieces = packing.piece_digest(packing.read_sequences(spark, str(tmp_path / "p"))).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in pieces} == ids
    sections = attribution.section_tokens(d).groupBy("doc_id").sum("n_tokens").collect()
    assert {r[0]: r[1] + 1 for r in sections} == ids
    groups = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(d).collect()}
    assert groups == {1: 1, 2: 1, 3: 3, 4: 4}
    item = " ".join(many.split()[200_000:200_030])
    bench = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    assert {1, 2} == {r["doc_id"] for r in decontaminate.leaks(d, bench).collect()}
    scored = {r["doc_id"]: r for r in ppm.score(d).collect()}
    assert scored[1]["n_tokens"] == len(many.split()) + 1 and all(np.isfinite(r["score"]) for r in scored.values())
    raw = many.encode()
    assert linecrf.base_counts(raw)[0] == 300_000 and np.isfinite(quality.statistics(raw)).all()
    machine = toxicity.Machine([b"blorgnak"], np.array([2.0]), -1.0)
    assert (machine.scores([raw + b" blor.gnak!", raw, b"x" * 2_000_000]) >= 0.5).tolist() == [True, False, False]
    assert time.time() - began < 400


def test_long_conversation(spark):
    n = 30_000
    turns = spark.range(n).selectExpr("1 as conv_id", "id as turn", "if(id % 3 = 0, 'user', 'assistant') as role", "concat('text é ', id) as text")
    got = chat.read_back(chat.format_conversations(turns)).collect()
    learnt = "".join(f"text é {k}" for k in range(n) if k % 3)
    assert [(r["n_turns"], r["loss_chars"]) for r in got] == [(n, len(learnt))]


def test_empty_tables(spark, tmp_path):
    none = docs(spark, [])
    token_orc.write_tokens(none, str(tmp_path / "t"))
    assert token_orc.token_digest(token_orc.read_tokens(spark, str(tmp_path / "t"))).count() == 0
    packing.write_sequences(none, str(tmp_path / "p"))
    assert packing.piece_digest(packing.read_sequences(spark, str(tmp_path / "p"))).count() == 0
    assert attribution.section_tokens(none).count() == 0
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))).count() == 0


def rows_read(df):
    """Rows that the scans of an executed query gave out."""
    df.collect()
    todo, n = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if "Scan" in node.getClass().getSimpleName():
            n += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return n


def test_row_groups_and_bloom_filters_prune(spark, tmp_path):
    token_orc.write_tokens(docs(spark, [(2 * k, f"text {k}") for k in range(6000)]), str(tmp_path / "t"), shards=1)
    data = spark.read.orc(str(tmp_path / "t" / "data")).select("doc_id", "n_tokens")
    assert rows_read(data) == 6000
    assert 1 <= rows_read(data.filter("doc_id = 7000")) <= 1000  # one row group of six
    assert rows_read(data.filter("doc_id = 7001")) == 0  # within a group's range; the Bloom filter knows better


def test_a_cluster_without_a_shared_folder_is_refused():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="checkpoint"):
        scratch.shared_dir(Session())


def test_a_cluster_of_one_machine_is_a_cluster():
    class Context:
        master = "local-cluster[3,2,3000]"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="checkpoint"):
        scratch.shared_dir(Session())


def test_bytes_that_are_no_text(spark, tmp_path):
    """They count as U+FFFD; no task fails."""
    bad = b"good words \xff\xfe b\xc3 \xe6\x97 end\nline \x80two"
    clean = bad.decode(errors="replace")
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.expr(f"cast(X'{bad.hex()}' as string)").alias("text"))
    want = spark.createDataFrame([(0, clean)], "doc_id bigint, text string")
    for k, d in enumerate((docs, want)):
        token_orc.write_tokens(d, str(tmp_path / f"orc{k}"))
        packing.write_sequences(d, str(tmp_path / f"seq{k}"))
    read = lambda k: (token_orc.token_digest(token_orc.read_tokens(spark, str(tmp_path / f"orc{k}"))).collect(), sorted(map(tuple, packing.piece_digest(packing.read_sequences(spark, str(tmp_path / f"seq{k}"))).collect())))
    assert read(0) == read(1)
    assert attribution.section_tokens(docs).collect() == attribution.section_tokens(want).collect()


def test_roles_with_line_breaks_come_back(spark):
    roles = ["sys\nassistant", "a\n", "\n", "<|nl|>", "\\n", "x\\\ny", "<|nl|>\n<|im_end|>\n"]
    turns = spark.createDataFrame([(k, 0, r, "hi\nyou") for k, r in enumerate(roles)], "conv_id bigint, turn bigint, role string, text string")
    got = chat.format_conversations(turns).select("conv_id", chat.parsed(F.col("formatted")).alias("t")).collect()
    assert {r["conv_id"]: [(t["role"], t["text"]) for t in r["t"]] for r in got} == {k: [(r, "hi\nyou")] for k, r in enumerate(roles)}


def test_the_field_is_the_most_likely_one():
    """The likelihood by enumeration of all labellings; no other weights near give more."""
    r = np.random.default_rng(3)
    ridge = 1e-2
    sequences = [(r.normal(0, 1, (n, linecrf.FEATURES)), r.integers(0, 2, n)) for n in (1, 2, 3, 4, 4, 3, 2, 4)]
    total = sum(len(y) for _, y in sequences)

    def gain(emit, move, first):
        out = 0.0
        for x, y in sequences:
            e = x @ emit.T
            weigh = lambda lab: first[lab[0]] + sum(e[k, c] for k, c in enumerate(lab)) + sum(move[a, b] for a, b in zip(lab, lab[1:]))  # noqa: B023, E731
            out += weigh(y) - np.log(sum(np.exp(weigh(lab)) for lab in product((0, 1), repeat=len(y))))
        return out / total - ridge / 2 * sum((p**2).sum() for p in (emit, move, first))

    field = linecrf.fit_sequences(sequences, rounds=1500, rate=0.02, ridge=ridge)
    best = gain(field.emit, field.move, field.first)
    for _ in range(60):
        other = [p + r.normal(0, 0.05, p.shape) for p in (field.emit, field.move, field.first)]
        assert gain(*other) <= best + 1e-4


def test_pipeline_keeps_what_brute_force_keeps(spark, tmp_path):
    rows, labels = labelled(400, 900)
    known = {i: (q, t) for i, q, t in labels}
    good = [i for i, (q, t) in known.items() if q and not t]
    text = dict(rows)
    r = random.Random(9)
    copied, leaked = good[10], good[20]
    words = text[copied].split()
    words[30] = "changed"
    item = " ".join(f"bench{k}" for k in range(24))
    more = [(1000, text[copied]), (1001, " ".join(words)), (1002, prose(40, 5001) + " " + item + " " + prose(10, 5002)), (1003, prose(60, 5003))]
    text[leaked] += " " + item
    rows = [(i, text[i]) for i, _ in rows] + more
    r.shuffle(rows)
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = {x["doc_id"] for x in out.select("doc_id").distinct().collect()}
    want = (set(good) - {leaked}) | {1003}
    # The classifiers are trained, not told: one or two documents may be judged otherwise.
    assert len(got ^ want) <= 2 and {1000, 1001, 1002, leaked}.isdisjoint(got) and copied in got


def test_pairs_within_a_bands_largest_component_dont_meet(spark):
    """One stray node beside a component of 900 meets each of them once, in blocks; before, the 900 met each other too."""
    from lodestream.llm import minhash

    rows = spark.range(901).selectExpr("7L as band", "id as node", "case when id = 900 then 900L else 0L end as root", "0L as main", "2L as ahead", "3L as blocks")
    a, b = (minhash._in_blocks(rows, first, True) for first in (True, False))
    met = a.alias("a").join(b.alias("b"), ["band", "one", "two"]).selectExpr("a.node as u", "b.node as v").collect()
    assert sorted((r["u"], r["v"]) for r in met) == [(k, 900) for k in [*range(900), 900]]


def near_copies(n, changes, seed):
    """One text of 150 words, and copies that differ from it by so many words each, drawn from ``changes``; some copies of those."""
    import random

    r = random.Random(seed)
    base = [f"w{seed}x{k}" for k in range(150)]
    rows = [" ".join(base)]
    for k in range(n):
        words = base[:] if k % 7 else r.choice(rows).split()
        for at in r.sample(range(len(words)), r.choice(changes)):
            words[at] = r.choice([f"own{k}x{at}", "shared", f"group{k % 3}"])
        rows.append(" ".join(words[: len(words) - k % 5]))
    return rows


def test_strays_beside_a_large_component_meet_it_by_what_sets_them_apart(spark, monkeypatch):
    """Copies too far from their text for a link: none of them is paired with the whole component, and no link is lost."""
    from itertools import combinations

    from lodestream.llm import minhash, shingles

    texts = near_copies(160, [1, 2, 3, 4, 5, 6], 1) + near_copies(60, [3, 4, 5], 2)
    sets = [shingles.shingle_set(t.encode()) for t in texts]
    root = list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        if root[a] != root[b] and shingles.jaccard_at_least(sets[a], sets[b], 75):
            root = [min(root[a], root[b]) if x in (root[a], root[b]) else x for x in root]
    monkeypatch.setattr(minhash, "FEW", 0)
    found, kept = [], minhash._apart
    monkeypatch.setattr(minhash, "_apart", lambda *args: found.append(args[0]) or kept(*args))
    monkeypatch.setattr(minhash.scratch, "drop", lambda *_: None)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got == dict(enumerate(root)) and 20 < len(set(root)) < 150
    # Before, all pairs of different components in a band met.
    pairs, of, under = kept(found[0], 75).count(), {}, {}
    for r in found[0].select("leader", "node", "root").collect():
        of[r["node"]] = r["root"]
        under.setdefault(r["leader"], []).append(r["node"])
    crossing = {(min(a, b), max(a, b)) for nodes in under.values() for a, b in combinations(nodes, 2) if of[a] != of[b]}
    assert len(crossing) > 500 and pairs < len(crossing) / 4


def test_a_crowd_has_one_guide_and_each_node_is_described_once(spark, monkeypatch):
    """Before, a node was compared with the leader of each crowded band and its differences were exploded for each of them."""
    from itertools import combinations

    from lodestream.llm import minhash, shingles

    texts = near_copies(90, [2, 4, 5, 6, 7], 3) + near_copies(50, [4, 6], 4)
    sets = [shingles.shingle_set(t.encode()) for t in texts]
    root = list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        if root[a] != root[b] and shingles.jaccard_at_least(sets[a], sets[b], 75):
            root = [min(root[a], root[b]) if x in (root[a], root[b]) else x for x in root]
    monkeypatch.setattr(minhash, "FEW", 4)
    found, kept = [], minhash._apart
    monkeypatch.setattr(minhash, "_apart", lambda *args: found.append(args[0]) or kept(*args))
    monkeypatch.setattr(minhash.scratch, "drop", lambda *_: None)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got == dict(enumerate(root)) and 20 < len(set(root)) < 130
    assert found[0].count() <= 1.1 * found[0].select("node").distinct().count() > 50
