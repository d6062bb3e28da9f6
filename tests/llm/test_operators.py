import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewright.llm import exact, html, media, mixing, ngram, packing, partenum, toxicity, urls, warc

ODD = [(1, None, None, "x"), (2, "", "b", "x"), (3, " \n", None, "y"), (4, "word " * 30000, "a", "y"), (5, "A b\tC", "a", "z"), (5, "A b\tC", "a", "z"), (None, "A b C", None, None), (6, "İ. KK \U0001f600 naïve", "b", "z")]
SCHEMA = "doc_id long, text string, source string, size string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@given(st.lists(st.integers(1, 512), max_size=80))
@settings(max_examples=60, deadline=None)
def test_balance_fills_no_window_too_far(sizes):
    owner, k = packing.balance(np.array(sizes, np.int64))
    assert len(owner) == len(sizes) and (not sizes or 0 <= owner.min() and owner.max() < k)
    assert (np.bincount(owner, sizes, k) <= packing.WINDOW).all()


def test_packing_is_an_exact_cover(odd, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    want = Counter((d, len(t.encode(x or "", add_special_tokens=False).ids) + 1) for d, x, _, _ in ODD)
    rows = packing.pack(odd).collect()
    assert sum(r["length"] for r in rows) == sum(n * c for (_, n), c in want.items())
    windows = {}
    for r in rows:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert (r["doc_id"], r["doc_tokens"]) in want
    for w in windows.values():
        at = 0
        for o, n in sorted(w):
            assert o == at
            at += n
        assert at <= packing.WINDOW
    one = next(r for r in rows if r["doc_id"] == 6)
    ids = np.array([*t.encode(ODD[-1][1], add_special_tokens=False).ids, 1], "<u4").tobytes()
    assert one["ids_crc32"] == zlib.crc32(ids)
    assert packing.pack(empty).count() == 0


def test_mixing_odd_rows(odd, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD) and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert abs(sum({r["source"]: r["target"] for r in rows}.values()) - 1.5 * sum(r["size"] for r in rows)) < 1e-6
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed(odd).columns == odd.columns


def test_exact_odd_rows(odd, empty):
    rows = exact.exact_groups(odd).collect()
    assert len(rows) == len(ODD) and sum(r["kept"] for r in rows) == 5
    abc = [r for r in rows if r["group_size"] == 3]
    assert {r["keep_id"] for r in abc} == {5} and sum(r["kept"] for r in abc) == 1
    assert exact.deduplicated(odd).count() == 5 and exact.deduplicated(odd).columns == odd.columns
    assert exact.exact_groups(empty).count() == 0


@given(st.lists(st.integers(0, 2**64 - 1), max_size=200), st.lists(st.integers(0, 50), max_size=60))
@settings(max_examples=60, deadline=None)
def test_quotient_filters_merge_without_loss(a, b):
    x, y = (exact.QuotientFilter.of(np.array(v, np.uint64), q) for v, q in ((a, 5), (b, 9)))
    m = exact.merged([exact.QuotientFilter.decode(f.encode()) for f in (x, y)])
    assert dict(zip(m.prints.tolist(), m.counts.tolist(), strict=True)) == Counter(a + b)


def test_near_odd_rows(odd):
    rows = partenum.join(odd).collect()
    assert len(rows) == len(ODD)
    assert {r["component_id"] for r in rows if r["n_shingles"] and (r["doc_id"] in (5, None))} == {5}
    kept = partenum.representatives(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id IS NULL").count() == 0


def test_media_round_trip(odd, empty):
    rows = {(r["doc_id"], r["n_bytes"]): r for r in media.media(odd).collect()}
    for d, x, _, _ in ODD:
        data = (x or "").encode()
        r = rows[(d, len(data))]
        back = media.from_wav(r["media"])
        assert back == media.padded(data) and back.startswith(data) and r["payload_bytes"] % 64 == 0
        assert r["payload_sha256"] == hashlib.sha256(back).hexdigest() and r["media_bytes"] == len(r["media"])
    assert media.media(empty).count() == 0
    tone = (128 + 100 * np.sin(np.arange(2560) * 2 * math.pi * 20 / 256)).astype(np.uint8)
    assert (media.peaks(tone)[:, 2] == 20).all()


def test_media_every_sample_has_weight():
    flat = np.full(1024, 128, np.uint8)
    for at in [0, 1, 127, 128, 254, 255, 256, 511, 512, 767, 1022]:
        x = flat.copy()
        x[at : at + 2] = 255, 0  # strongest in the highest bins, silence in the lowest
        assert (media.fingerprint(x) != media.fingerprint(flat)).any(), at


def test_warc_round_trip_and_salvage(spark):
    pages = [(1, "http://a", "same"), (2, "http://b", "same"), (3, None, None), (4, "http://c", ""), (9, "u", "x" * 300000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows = {r["page_id"]: r for r in warc.round_trip(df).collect()}
    assert (rows[2]["record_type"], rows[2]["refers_to"], rows[2]["payload_bytes"]) == ("revisit", 1, 4)
    assert rows[4]["record_type"] == "revisit" and rows[1]["payload_digest"] == warc.digest(b"same") == rows[2]["payload_digest"]
    assert warc.round_trip(df, least=5).filter("record_type = 'revisit'").count() == 0

    parts = [warc.member(warc.record(i, "u", random.Random(i).randbytes(500))) for i in range(8)]
    parts[2] = parts[2][:40] + b"\0\0\0\0" + parts[2][44:]
    parts[5] = parts[5][:-20]
    plain = warc.record(99, "u", b"plain")
    data = b"".join(parts[:4]) + b"junk" + plain + b"".join(parts[4:])
    r = warc.SalvageReader(data)
    assert [x.headers["warc-record-id"] for x in r] == [warc.page_urn(i) for i in (0, 1, 3, 99, 4, 6, 7)]
    assert [g[:2] for g in r.gaps] == [(len(parts[0]) + len(parts[1]), len(parts[2])), (len(b"".join(parts[:4])), 4), (len(b"".join(parts[:4])) + 4 + len(plain) + len(parts[4]), len(parts[5]))]


@given(st.lists(st.text("ab./:?#cometnr78d", max_size=30), max_size=20))
@settings(max_examples=80, deadline=None)
def test_automaton_equals_regex(texts):
    rules = [("block", "com", "/a"), ("allow", "b.com", "/a7"), ("block", "net", "/")]
    got = urls.RuleSet(rules).judge(texts)[0]
    for t, g in zip(texts, got, strict=True):
        fit = [h + p for _, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])) if re.match(rf"(?s)([^/]*\.)?{re.escape(h + p)}", t)]
        assert g == (fit[0] if fit else None)


def test_html_article_only():
    crf = html.model()
    page = '<html><head><title>t</title><script>"<p>no</p>"</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="ad">Buy now.</div><article><h1>The &amp; title</h1><p>First  para<br>graph of <b>text</b>, long enough.<p>Second one, also long enough to read.</article><aside>Other things.</aside><div class="comments"><p>I disagree with all of it.</p></div><footer>&copy; 2024 x</footer>'
    assert crf.text(page) == "The & title First para graph of text , long enough. Second one, also long enough to read.".replace(" ,", ",")
    assert crf.text("") == "" and crf.text("<") in ("", "<")
    test = html.labelled_pages(120, seed=5)
    right = sum(a == b for bs, lab in test for a, b in zip(crf.labels(bs), lab, strict=True))
    assert right / sum(len(lab) for _, lab in test) > 0.97


def test_html_long_attributes_and_unclosed_elements():
    texts = lambda page: [b.text for b in html.blocks(page)]
    for q, other in ("\"'", "'\""):
        value = f"data:image/svg+xml,<svg><path d={other}{'M0 1 ' * 4000}{other}/></svg><p>no"
        assert texts(f"<p>one</p><div data-x={q}{value}{q} id=x>two</div><p><img src={q}{value}{q}>three") == ["one", "two", "three"]
    assert texts("<p title=it's>one</p><p class=\"a\"\">two</p><p>it's three") == ["one", "two", "it's three"]
    for tag in ("audio", "select", "svg", "object", "template"):
        assert texts(f"<p>one</p><{tag} x=1><p>two</p><{tag}><p>three</p>") == ["one", "two", "three"]
    for tag in html.RAW:
        assert texts(f"<p>one</p><{tag}><p>two</p>") == ["one"]
    assert texts("<p>one</p><svg><text>no</text></svg><p>two") == ["one", "two"]


def test_html_features_of_the_whole_text():
    shape = lambda text: html.shape(html.Block(text, frozenset(), "p", 0))
    assert {"copy", "bar"} <= set(shape("some words " * 30 + "© a | b")) and "num" in shape("word " * 41 + "12345 " * 90)
    assert "num" not in shape("12345 " * 34 + "word " * 300)


def test_viterbi_is_the_best_path():
    crf = html.model()
    for bs, _ in html.labelled_pages(10, seed=8):
        bs = bs[:9]
        best = max(range(2 ** len(bs)), key=lambda m: sum((m >> i & 1) * sum(crf.weights.get(f, 0) for f in html.features(b)) for i, b in enumerate(bs)) + (m & 1) * crf.start + sum(crf.move[m >> i & 1][m >> i + 1 & 1] for i in range(len(bs) - 1)))
        assert crf.labels(bs) == [bool(best >> i & 1) for i in range(len(bs))]


@given(st.lists(st.integers(0, 2**64 - 1), max_size=200), st.sampled_from([1, 2**20, 2**50, 2**64]), st.lists(st.integers(0, 2**64 - 1), max_size=20))
@settings(max_examples=80, deadline=None)
def test_elias_fano_is_queried_in_place(values, top, more):
    v = np.sort(np.array([x % top for x in values], np.uint64))
    data = ngram.EliasFano.encode(v)
    x = ngram.EliasFano(ngram.mapped(data))
    assert x.end == len(data) and (x.get(np.arange(len(v))) == v).all()
    ask = np.concatenate([v, v + np.uint64(1), np.array([y % top for y in more] + [0, 2**64 - 1], np.uint64)])
    below, there = x.successor(ask)
    assert (below == np.searchsorted(v, ask)).all() and (there == np.isin(ask, v)).all()


def test_levels_of_the_trie():
    r = np.random.default_rng(4)
    hashes, counts = np.unique(r.integers(0, 2**64, 3000, dtype=np.uint64)), r.integers(1, 2**40, 3000)
    words = ngram.Words(ngram.mapped(ngram.Words.build(hashes, counts, int(counts.sum()))))
    place, count, codes = words.find(np.append(hashes[::-1], np.uint64(7)))
    assert place.tolist() == [*range(2999, -1, -1), -1] and count.tolist() == [*counts[::-1], 0] and codes[-1] == ngram.NONE
    assert 10 ** ngram.value(codes[:-1]) == pytest.approx((counts[::-1] + 0.5) / counts.sum(), rel=0.001)
    pairs = np.unique(r.integers(0, 300, (2000, 2)), axis=0)
    codes = r.integers(0, 60000, len(pairs))
    trie = ngram.Trie(ngram.mapped(ngram.Trie.build(pairs[:, 0], pairs[:, 1], pairs[:, 0], codes)))
    every = np.stack(np.meshgrid(np.arange(310), np.arange(310)), -1).reshape(-1, 2)
    want = {tuple(p): c for p, c in zip(pairs.tolist(), codes.tolist(), strict=True)}
    assert trie.find(every[:, 0], every[:, 1]).tolist() == [want.get(tuple(p), ngram.NONE) for p in every.tolist()]
    none = ngram.Trie(ngram.mapped(ngram.Trie.build(*[np.zeros(0, np.int64)] * 4)))
    assert none.find(np.array([0, 5]), np.array([3, 3])).tolist() == [ngram.NONE] * 2


def brute_scores(texts, fold=5, held=1):
    split = {d: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for d, t in texts}
    train = [d for d in split if zlib.crc32(("" if d is None else str(d)).encode()) % fold != held]
    c = Counter(w for d in train for w in split[d])
    pair = Counter(p for d in train for p in zip(["^", *split[d]], split[d]))
    n, v = sum(c.values()), len(c)
    out = {}
    for d, ws in split.items():
        one = [(c[w] + 0.5) / (n + 0.5 * (v + 1)) for w in ws]
        both = [(pair[p] + ngram.MU * o) / ((len(train) if p[0] == "^" else c[p[0]]) + ngram.MU) for p, o in zip(zip(["^", *ws], ws), one)]
        out[d] = len(ws), sum(c[w] > 0 for w in ws), n, sum(map(math.log10, one)), sum(map(math.log10, both))
    return out


@pytest.mark.parametrize("block,shard", [(ngram.BLOCK, ngram.SHARD), (50, 100)])
def test_lm_scores_equal_brute_force(spark, monkeypatch, block, shard):
    monkeypatch.setattr(ngram, "BLOCK", block)
    monkeypatch.setattr(ngram, "SHARD", shard)
    r = random.Random(1)
    texts = [(d, " ".join(r.choice("Aa b c dd é \u00a0".split(" ")) for _ in range(r.randint(0, 40)))) for d in range(80)] + [(80, None), (None, "a b"), (82, "unseen b b")]
    got = {x["doc_id"]: x for x in ngram.scores(spark.createDataFrame(texts, "doc_id long, text string").repartition(3, "doc_id")).collect()}
    want = brute_scores(texts)
    assert got.keys() == want.keys()
    for d, (n_tokens, n_known, total, base, score) in want.items():
        x = got[d]
        assert (x["n_tokens"], x["n_known"], x["train_tokens"]) == (n_tokens, n_known, total)
        assert x["base_score"] == pytest.approx(base) and x["score"] == pytest.approx(score, abs=n_tokens * 1.5 / ngram.STEPS)
        assert x["held_out"] == (zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1)


def test_lm_scores_of_odd_tables(spark, odd, empty):
    rows = ngram.scores(odd.withColumn("block", odd.doc_id).withColumn("_row", odd.doc_id)).collect()
    assert len(rows) == len(ODD) and {r["n_tokens"] for r in rows if r["doc_id"] == 4} == {30001}
    assert ngram.scores(empty).count() == 0
    held = spark.createDataFrame([(d, "a b") for d in range(30) if zlib.crc32(str(d).encode()) % 5 == 1], "doc_id long, text string")
    assert {(r["train_tokens"], r["n_known"], r["base_score"], r["score"]) for r in ngram.scores(held).collect()} == {(0, 0, 0.0, 0.0)}


def test_lm_scores_of_a_frequent_bigram(spark):
    n = 2_000_000
    rows = [(d, "a " * n if d == 0 else "a") for d in range(10)]
    train = [d for d, _ in rows if zlib.crc32(str(d).encode()) % 5 != 1]
    assert 0 in train
    x = ngram.scores(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id = 0").first()
    a, e = n + len(train) - 1, len(train)
    p1 = lambda c: (c + 0.5) / (a + e + 0.5 * 3)
    given_a = lambda c, w: math.log10((c + ngram.MU * p1(w)) / (a + ngram.MU))
    start = math.log10((len(train) + ngram.MU * p1(a)) / (len(train) + ngram.MU))
    want = start + (n - 1) * given_a(n - 1, a) + given_a(len(train), e)
    assert x["score"] == pytest.approx(want, abs=0.5 / ngram.STEPS * n)  # half a step of the codes


def test_lm_scores_shuffle_no_tokens(spark):
    r = np.random.default_rng(3)
    texts = [(d, " ".join(f"w{x}" for x in r.zipf(1.2, 4000) % 50_000)) for d in range(100)]
    store = spark.sparkContext._jsc.sc().statusStore()

    def stages():
        all_ = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return {all_.apply(i).stageId(): all_.apply(i).shuffleWriteBytes() for i in range(all_.size())}

    before = stages()
    assert len(ngram.scores(spark.createDataFrame(texts, "doc_id long, text string").repartition(2)).collect()) == 100
    sent = sum(v for k, v in stages().items() if k not in before)
    assert sent < 11 * 400_000  # the texts' own shuffle included; 12.7 a token when blocks sent their tokens and each n-gram's P1


def test_nearest_is_exact():
    r = np.random.default_rng(0)
    weights = r.random(40) * 5

    def counts():
        return {int(t): int(n) for t, n in zip(r.choice(40, 4, replace=False), r.integers(1, 6, 4))}

    def unit(c):
        v = {t: (1 + math.log(n)) * weights[t] for t, n in c.items()}
        s = math.sqrt(sum(w * w for w in v.values()))
        return {t: w / s for t, w in v.items()}

    examples = [counts() for _ in range(400)]
    vectors = [unit(c) for c in examples]
    index = toxicity.BlockMaxIndex.of(examples, weights)
    for i in range(40):
        q = unit(counts())
        own = i if i % 2 else -1
        sims = sorted(((-round(sum(w * v.get(t, 0) for t, w in q.items()), 9), i) for i, v in enumerate(vectors) if i != own))[:15]
        got = index.nearest(q, 15, own)
        assert [s for s, _ in got] == pytest.approx([-s for s, _ in sims if s < 0], abs=1e-8) and own not in {i for _, i in got}
    assert toxicity.BlockMaxIndex.of([], weights).nearest({1: 1.0}, 15) == []


def test_toxicity_learns_and_ignores_the_rest(spark):
    r = random.Random(2)
    words = [f"w{i}x" for i in range(200)]
    rows, labels = [], []
    for d in range(600):
        y = int(d % 4 == 0)
        rows.append((d, " ".join([r.choice(words) for _ in range(30)] + ["grobian" + r.choice("abcd")] * y)))
        labels.append((d, y))
    rows += [(600, None), (601, "")]
    out = toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [x for x in out if x["held_out"] and x["doc_id"] < 600]
    assert len(held) > 100 and all(x["predicted"] == int(x["doc_id"] % 4 == 0) for x in held)
    assert {x["predicted"] for x in out if x["doc_id"] >= 600} == {0} and all(0 <= x["score"] <= 1 for x in out)
    none = toxicity.toxicity(spark.createDataFrame(rows[:3], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.count() == 3


def test_toxicity_searches_all_terms_for_every_document(spark):
    r = random.Random(3)
    words = [f"w{i}x" for i in range(300)]
    rows = [(d, " ".join(r.choice(words) for _ in range(20))) for d in range(200)]
    train = [d for d in range(200) if zlib.crc32(str(d).encode()) % 3 != 1]
    rare = train[:3]  # an insult in fewer than five examples
    rows = [(d, x + " grobiana" * (d in rare)) for d, x in rows] + [(900, "grobiana " + " ".join(words[:9])), (901, None), (902, "unseen")]
    labels = [(d, int(d in rare)) for d in range(200)]
    frames = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = {x["doc_id"]: x for x in toxicity.toxicity(*frames).collect()}
    assert all(len(out[d]["evidence"]) == toxicity.NEIGHBOURS for d in [*range(200), 900] if d not in rare)
    assert set(out[900]["evidence"][:3]) == set(rare) and out[900]["score"] > max(out[d]["score"] for d in out if d not in (*rare, 900))
    assert out[901]["evidence"] == out[902]["evidence"] == []

    # all cosines by brute force
    terms = {d: Counter(t for w in (x or "").split() for t in toxicity.terms_of(w)) for d, x in rows}
    df = Counter(t for c in terms.values() for t in c)
    pos, neg = (Counter(t for d in train for t in terms[d] if (d in rare) == v) for v in (True, False))
    weight = lambda t: (math.log((len(rows) + 1) / (df[t] + 1)) + 1) * math.log2(2 + pos[t] / max(1, neg[t])) ** toxicity.RELEVANCE
    known = {t for d in train for t in terms[d]}
    vector = {d: {t: (1 + math.log(n)) * weight(t) for t, n in c.items() if t in known} for d, c in terms.items()}
    norm = lambda v: math.sqrt(sum(w * w for w in v.values()))
    for d in [5, 60, 120, 900]:
        cosine = lambda e: sum(w * vector[e].get(t, 0) for t, w in vector[d].items()) / norm(vector[d]) / norm(vector[e])
        assert out[d]["evidence"] == sorted(train, key=lambda e: (-round(cosine(e), 10), e))[:15]


def test_toxicity_index_is_one_mapped_file(spark, tmp_path, monkeypatch):
    """Workers map the index that one task made, instead of making and holding one each."""
    rows = [(i, f"common w{i % 7} w{i % 11} {'insult' if i % 5 == 0 else 'praise'} x{i}") for i in range(300)]
    frames = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int")
    _, path, ends, values = toxicity.fit(*frames)
    model = toxicity.Neighbours.stored(path)
    for a in (model.weights, *model.held, model.index.docs, model.index.counts, *model.index.exact[1:], *model.index.matrices):
        assert not len(a) or not a.flags.owndata and not a.flags.writeable
    fresh = toxicity.BlockMaxIndex(*model.held, np.diff(model.cuts), model.weights)
    queries = [model.example(i) for i in range(len(model.ids))]
    assert model.index.nearest_of(queries, 15, [-1] * len(queries)) == fresh.nearest_of(queries, 15, [-1] * len(queries))
    empty = toxicity.Neighbours(np.zeros(0), [], [], np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32))
    folder = f"file://{tmp_path}/index"
    again = toxicity.Neighbours.stored(empty.store(folder))
    assert again.index.nearest({}, 15) == [] and again.blank == empty.blank
    whole, near = toxicity.Neighbours.stored(model.store(folder)), model.votes(queries[:9], [-1] * 9)
    assert whole.votes(queries[:9], [-1] * 9) == near
    monkeypatch.setattr(toxicity.fs, "LocalFileSystem", type("NoStore", (), {}))  # as a store that cannot be mapped
    assert toxicity.Neighbours.stored(path).votes(queries[:9], [-1] * 9) == near
