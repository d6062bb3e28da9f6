import random
import re

import numpy as np
import pytest

from tidewright.llm import components, partenum
from tidewright.llm.partenum import Bands, signatures
from tidewright.llm.shingles import WordHashes, shingles


def brute(texts, words, num, den):
    """component by doc_id and sizes, from all pairs."""
    sets = {}
    for d, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(seed, n=400):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["É", "été", "Word,"]
    line = " ".join(r.choice(vocab) for _ in range(12))
    out = []
    for d in range(n):
        k = r.random()
        if k < 0.1 and out:
            t = r.choice(out)[1]
        elif k < 0.6 and out:
            w = (r.choice(out)[1] or "a b").split()
            for _ in range(r.randint(1, max(1, len(w) // 12))):
                w[r.randrange(len(w))] = r.choice(vocab)
            t = " ".join(w)
        elif k < 0.8:
            t = line + " " + " ".join(r.choice(vocab) for _ in range(r.randint(0, 6)))
        elif k < 0.84:
            t = r.choice([None, "", "  \n", "one", "one two", "One  two\tthree"])
        else:
            t = " ".join(r.choice(vocab) for _ in range(r.choice([3, 5, 9, 20, 60, 150, 400])))
        out.append((d, t))
    return out


@pytest.mark.parametrize("words,num", [(4, 85), (5, 80)])
def test_components_equal_brute_force(spark, words, num):
    data = corpus(words)
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in partenum.join(df, words, num, 100).collect()}
    want = brute(data, words, num, 100)
    assert got == want
    assert len({c for _, c in want.values()}) < len(want) - 50


@pytest.mark.parametrize("num", [80, 85])
def test_similar_sets_share_a_signature(num):
    r = np.random.default_rng(3)
    bands = Bands(num, 100)
    for size in [1, 2, 7, 8, 13, 40, 75, 80, 120, 300, 1000]:
        for _ in range(30):
            a = np.unique(r.integers(0, 2**63, size).astype(np.uint64))
            drop = int(len(a) * r.choice([0.02, (100 - num) / 100, (100 - num) / 100]))
            b = a[drop:] if r.random() < 0.3 else np.sort(r.permutation(a)[drop:]) if r.random() < 0.5 else np.unique(np.concatenate([a, r.integers(0, 2**63, drop).astype(np.uint64)]))
            i = len(np.intersect1d(a, b))
            if 100 * i >= num * (len(a) + len(b) - i) and not np.array_equal(a, b):
                sig, who = signatures(np.concatenate([a, b]), np.array([len(a), len(b)]), bands)
                assert set(sig[who == 0]) & set(sig[who == 1]), (size, drop)


def test_shingles_of_few_words():
    h = WordHashes()
    assert len(shingles(h.of(b""), 4)) == 0
    assert len(shingles(h.of(b"a b"), 4)) == 1
    assert len(shingles(h.of(b"a b a b a b"), 4)) == 2
    assert shingles(h.of(b"A b"), 4) == shingles(h.of(b"a\n b"), 4)


def test_empty_table(spark):
    assert partenum.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_stay_in_proportion(spark, monkeypatch):
    """A passage that 1,500 documents share, half of them copies with a changed word: rows follow members, not their pairs."""
    r = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(60))
    page = [f"q{i}" for i in range(60)]
    texts = []
    for d in range(1500):
        own = [f"d{d}x{i}" for i in range(14 + d % 3)] if d % 2 else [w if r.random() > 0.01 else f"c{r.randrange(9)}" for w in page]
        texts.append((d, f"{passage} {' '.join(own)}"))
    made = {}
    original = partenum.written

    def spy(df, name):
        out = original(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(partenum, "written", spy)
    monkeypatch.setattr(partenum, "TILE", 64)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in partenum.join(spark.createDataFrame(texts, "doc_id long, text string"), 5, 80, 100).collect()}
    assert got == brute(texts, 5, 80, 100)
    members = made["near-members"]
    for name in ("near-stars", "near-likely", "near-more", "near-undecided", "near-joining"):
        assert made.get(name, 0) <= 30 * members, (name, made)


def test_large_buckets_are_passed_on(spark, monkeypatch):
    data = corpus(4, 250)
    df = spark.createDataFrame(data, "doc_id long, text string")
    rows = partenum._emit(df, 4, 85, 100).repartition(1, "key").sortWithinPartitions("key", "node").cache()
    want = {tuple(r) for r in partenum._gather(rows).filter("kind = 1").select("a", "b").collect()}
    whole = {}
    for r in rows.filter("extra IS NULL").collect():
        whole.setdefault(r["key"], set()).add(r["node"])
    passed = partenum.HELD
    try:
        import tidewright.llm.partenum as module

        def gathered(sorted_rows):
            return module._gather(sorted_rows)

        monkeypatch.setattr(module, "HELD", 3)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
        small = gathered(rows)
        got = small.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert passed > 3 and {(r["a"], r["b"]) for r in got if r["kind"] == 1} == want
    by = {}
    for r in got:
        if r["kind"] == 2:
            by.setdefault(r["a"], set()).add(r["b"])
    assert {frozenset(v) for v in whole.values() if len(v) > 2} <= {frozenset(v) for v in by.values()}


def test_a_bucket_is_looked_at_again_without_its_least_member(spark):
    rows = spark.createDataFrame([(1, 10, None), (1, 20, None), (1, 30, None), (2, 10, None), (2, 20, None)], "key long, node long, extra binary")
    got = partenum._gather(rows.coalesce(1).sortWithinPartitions("key", "node")).collect()
    assert sorted({(r["b"], r["a"]) for r in got if r["kind"] == 1}) == [(10, 20), (10, 30)]
    assert sorted(r["b"] for r in got if r["kind"] == 2 and r["extra"] is None) == [20, 30]  # 10 has met both


def test_a_short_sketch_loses_no_similar_pair():
    r = np.random.default_rng(5)
    for n in (100, 700, 3000):
        x = r.integers(0, 2**63, n, dtype=np.uint64)
        y = np.concatenate([x[: n * 93 // 100], r.integers(0, 2**63, n * 5 // 100, dtype=np.uint64)])
        z = r.integers(0, 2**63, n, dtype=np.uint64)
        raw = [partenum.sketch(s) for s in (x, y, z)]
        short = [partenum.narrow(s) for s in raw]
        assert [len(s) for s in short] == [len(s) if len(s) <= 128 else max(128, len(s) // 4) for s in raw]
        ok, bound = partenum.Sketches(short, np.array([len(x), len(y), len(z)]), 85, 100).may(0, np.array([1, 2]))
        assert ok.tolist() == [True, False] and bound[0] >= n * 93 // 100


def test_few_edges_make_components_at_once(spark, monkeypatch):
    r = random.Random(2)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(x, x - 1) for x in range(-50, 0)] + [(2**62, -(2**63)), (7, 7)]
    df, made = spark.createDataFrame(edges, "a long, b long"), []
    original = components.written
    monkeypatch.setattr(components, "written", lambda frame, name: made.append(name) or original(frame, name))
    few = {tuple(x) for x in components.components(df).collect()}
    assert made == ["cc", "cc-roots"]
    monkeypatch.setattr(components, "FEW", 3)
    assert few == {tuple(x) for x in components.components(df).collect()} and len(made) > 4
    assert {(2**62, -(2**63)), (-1, -51)} <= few and components.components(df.filter("a = b")).count() == 0


def test_sketches_meet_their_nodes_without_a_shuffle(spark):
    texts = [(d, f"{'a b c d e f g h ' * 9}{d // 3}") for d in range(60)] + [(60, None), (None, "x y z"), (None, "x y z")]
    rows = partenum._emit(spark.createDataFrame(texts, "doc_id long, text string").repartition(5), 4, 85, 100)
    got = partenum._gather(rows.repartition(6, "key").sortWithinPartitions("key", "node")).cache()
    facts = partenum._facts(got, 6)
    assert got.filter("kind = 0").count() == len(texts) and facts.count() == facts.select("node").distinct().count() == 21
    joined = facts.join(facts.select("node").distinct().hint("merge"), "node")
    joined.collect()
    assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
