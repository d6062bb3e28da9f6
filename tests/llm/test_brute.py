"""Every query that SQL cannot express, and every stage of the pipeline, against a plain version of its own on whole tables."""

import base64
import hashlib
import html as entities
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from test_near import brute as brute_near
from test_operators import brute_scores

from tidewright.llm import media, ngram, toxicity, warc
from tidewright.llm.mixing import oracle
from tidewright.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def table(name, columns):
    return duckdb.sql(f"SELECT {columns} FROM read_parquet('{SF}/{name}.parquet')").fetchall()


@pytest.fixture(scope="module")
def documents():
    return dict(table("documents", "doc_id, text"))


@pytest.fixture(scope="module")
def pages():
    return table("pages", "page_id, url, html")


@pytest.fixture(scope="module")
def encode():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def packed_right(rows, copies, ids_of):
    """Pieces cover the ids of each document as often as it occurs; sequences are gapless."""
    seen, sequences = Counter(), defaultdict(list)
    for r in rows:
        ids = ids_of[r["doc_id"]]
        assert r["doc_tokens"] == len(ids) and r["length"] > 0
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        for at in range(r["start"], r["start"] + r["length"]):
            seen[r["doc_id"], at] += 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert seen == Counter({(d, at): n for d, n in copies.items() for at in range(len(ids_of[d]))})
    padding = total = 0
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding < 0.1 * total


def test_op1_packing(spark, documents, encode):
    packed_right(QUERIES["op1_packing"](spark, SF).collect(), {d: 1 for d in documents}, {d: encode(t) for d, t in documents.items()})


def test_op3_lm_scores(spark, documents):
    want = brute_scores([*documents.items()])
    rows = QUERIES["op3_lm_scores"](spark, SF).collect()
    assert {r["doc_id"] for r in rows} == want.keys() and len(rows) == len(want)
    for r in rows:
        n_tokens, n_known, total, base, score = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n_tokens, n_known, total)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score, abs=n_tokens * 1.5 / ngram.STEPS)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_op4_html(spark, pages):
    want = {}
    for page_id, url, page in pages:
        article = re.search(r"(?s)<article>(.*?)</article>", page)[1]
        article = re.sub(r"(?s)<!--.*?-->|<(script|style)\b.*?</\1>", " ", article)
        article = re.sub(r"</?(?:a|b|i|em|strong|span)\b[^>]*>", "", article)
        want[page_id] = url, " ".join(entities.unescape(re.sub(r"<[^>]*>", " ", article)).split())
    rows = QUERIES["op4_html"](spark, SF).collect()
    assert len(rows) == len(pages)
    assert {r["page_id"]: (r["url"], r["text"]) for r in rows} == want and all(r["n_chars"] == len(r["text"]) for r in rows)


def test_op6_ngram_jaccard(spark, documents):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op6_ngram_jaccard"](spark, SF).collect()}
    assert got == brute_near([*documents.items()], 4, 85, 100)


def test_op8_media(spark, documents):
    rows = QUERIES["op8_media"](spark, SF).collect()
    assert len(rows) == len(documents)
    window = [0.5 - 0.5 * math.cos(2 * math.pi * i / (media.FRAME - 1)) for i in range(media.FRAME)]
    bins = np.exp(-2j * np.pi * np.outer(np.arange(media.FRAME // 2 + 1), np.arange(media.FRAME)) / media.FRAME)
    for r in rows:
        data = (documents[r["doc_id"]] or "").encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert bytes(r["media"])[-len(payload) :] == payload and r["media"][:4] == b"RIFF" and r["media"][8:12] == b"WAVE"
        assert (r["media_bytes"], r["media_sha256"]) == (len(r["media"]), hashlib.sha256(r["media"]).hexdigest())
        assert r["feature"] == f"{len(r['pairs'])}:{hashlib.sha256(np.array(r['pairs'], '<i8').tobytes()).hexdigest()}"
    for r in rows[:12]:  # a plain transform, frame by frame
        payload = np.frombuffer(bytes(r["media"])[44:], np.uint8).astype(float) - 128
        n = -(-len(payload) // media.HOP) + 1
        x = np.zeros((n + 1) * media.HOP)
        x[media.HOP : media.HOP + len(payload)] = payload
        power = [np.abs(bins @ (x[i * media.HOP : i * media.HOP + media.FRAME] * window)) ** 2 for i in range(n)]
        best = [[power[t][lo:hi].max() for lo, hi in zip(media.BANDS, media.BANDS[1:])] for t in range(n)]
        band = lambda b: next(i for i, hi in enumerate(media.BANDS[1:]) if b < hi)
        pairs = Counter()
        for x in r["pairs"]:
            t, a, b, d = x >> 32, x >> 20 & 0xFFF, x >> 8 & 0xFFF, x & 0xFF
            assert power[t][a] == pytest.approx(best[t][band(a)], rel=1e-3, abs=1e-3) and power[t + d][b] == pytest.approx(best[t + d][band(b)], rel=1e-3, abs=1e-3)
            pairs[t, band(a), band(b), d] += 1
        k = len(media.BANDS) - 1
        assert pairs == Counter({(t, i, j, d): 1 for d in range(1, media.AHEAD + 1) for t in range(n - d) for i in range(k) for j in range(k)})


def test_op9_warc(spark, pages):
    by = defaultdict(list)
    for page_id, _, page in pages:
        by[(page or "").encode()].append(page_id)
    want = {}
    for payload, ids in by.items():
        for i in ids:
            first = i == min(ids)
            want[i] = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if first else "revisit", None if first else min(ids)
    rows = QUERIES["op9_warc"](spark, SF).collect()
    assert len(rows) == len(pages)
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows} == want


def test_op9_warc_damaged_archive(spark, pages, tmp_path):
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    archives = warc.write_archives(df, f"file://{tmp_path}/w", segment=20_000).collect()
    assert sum(r["records"] for r in archives) == len(pages) and len(archives) > 2
    path = archives[1]["path"]
    data = bytearray(open(path, "rb").read())
    assert len(data) == archives[1]["bytes"] and data[:3] == warc.MAGIC
    data[200:260] = bytes(60)
    open(path, "wb").write(data)
    rows = warc.salvaged(spark.createDataFrame(archives), f"file://{tmp_path}/w").collect()
    gaps = [r for r in rows if r["kind"] == "gap"]
    assert {r["path"] for r in gaps} == {path} and sum(r["kind"] == "record" for r in rows) == len(pages) - len(gaps) == len(pages) - 1
    (tmp_path / "empty").write_bytes(b"")
    assert warc.read_archives(spark.createDataFrame([(f"{tmp_path}/empty",)], "path string"), f"file://{tmp_path}").count() == 0


def brute_toxicity(documents, labels):
    """Scores of all documents by all cosines."""
    train = {d: int(t > 0) for d, t in labels.items() if d in documents and zlib.crc32(str(d).encode()) % 3 != 1}
    terms = {d: Counter(t for w in (x or "").lower().split() for t in toxicity.terms_of(w)) for d, x in documents.items()}
    df = Counter(t for c in terms.values() for t in c)
    pos, neg = (Counter(t for d, y in train.items() if y == v for t in terms[d]) for v in (1, 0))
    weight = {t: (math.log((len(documents) + 1) / (df[t] + 1)) + 1) * math.log2(2 + pos[t] / max(1, neg[t])) ** toxicity.RELEVANCE for t in {*pos, *neg}}
    vector = {}
    for d, c in terms.items():
        v = {t: (1 + math.log(n)) * weight[t] for t, n in c.items() if t in weight}
        norm = math.sqrt(sum(w * w for w in v.values()))
        vector[d] = {t: w / norm for t, w in v.items()}
    full = sorted(d for d in train if vector[d])
    rate = (sum(train.values()) + 1) / (len(train) + 2)
    blank = [train[d] for d in train if not vector[d]]

    def votes(v, without=None):
        near = [(-round(sum(w * vector[e].get(t, 0) for t, w in v.items()), 10), e) for e in full if e != without]
        near = sorted(x for x in near if x[0] < 0)[: toxicity.NEIGHBOURS]
        weights = [1 / (1.05 + s) for s, _ in near]
        return (sum(w * train[e] for w, (_, e) in zip(weights, near)) + rate) / (sum(weights) + 1), [e for _, e in near]

    raw = np.array([votes(vector[d], d)[0] for d in full])
    ends, values = toxicity.isotonic(raw, np.array([train[d] for d in full], float))
    out = {}
    for d, v in vector.items():
        if not v:
            out[d] = min((sum(blank) + rate) / (len(blank) + 1), rate), []
            continue
        x, near = votes(v)
        out[d] = min(1, max(0, 0.98 * values[min(np.searchsorted(ends, x - 1e-9), len(values) - 1)] + 0.02 * x)), near
    return out


@pytest.fixture(scope="module")
def toxic(documents):
    labels = defaultdict(int)
    for d, t in table("labels", "doc_id, toxic"):
        if t is not None:
            labels[d] = max(labels[d], t)
    return brute_toxicity(documents, labels)


def test_op10_toxicity(spark, documents, toxic):
    rows = QUERIES["op10_toxicity"](spark, SF).collect()
    assert len(rows) == len(documents)
    for r in rows:
        score, near = toxic[r["doc_id"]]
        assert r["evidence"] == near and r["score"] == pytest.approx(score, abs=1e-6)
        assert r["predicted"] == (score >= 0.7) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_isotonic_is_the_best_ascending_fit():
    r = np.random.default_rng(1)
    for _ in range(30):
        x, y = r.integers(0, 12, 40) / 12, r.integers(0, 2, 40).astype(float)
        ends, values = toxicity.isotonic(x, y)
        assert (np.diff(ends) > 0).all() and (np.diff(values) >= 0).all()
        # min-max form of the isotonic fit, then drawn to the mean
        u = np.unique(x)
        fit = [max(min(y[(x >= a) & (x <= b)].mean() for b in u if b >= v) for a in u if a <= v) for v in u]
        pool = {f: [v for v, g in zip(u, fit) if g == f] for f in fit}
        low, want = 0.0, []
        for f in sorted(pool):
            n = np.isin(x, pool[f]).sum()
            low = max(low, (f * n + y.mean()) / (n + 1))
            want += [low] * len(pool[f])
        assert values[np.searchsorted(ends, u)] == pytest.approx(want)


def test_pipeline_stage_by_stage(spark, documents, toxic, encode, monkeypatch):
    import corpus_pipeline

    stages, results = [], {}
    for name, f in corpus_pipeline.STAGES:
        def run(s, docs, sf, f=f, name=name):
            before = docs.collect()
            out = f(s, docs, sf)
            results[name] = before, docs.columns, out.collect(), out.columns
            return out
        stages.append((name, run))
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    last = corpus_pipeline.run(spark, SF).collect()
    assert [*results] == ["toxicity", "exact_dedup", "ngram_jaccard", "mixing", "packing"]
    for name, (_, before, _, after) in results.items():
        assert name == "packing" or before == after
    ids = lambda rows: sorted(r["doc_id"] for r in rows)

    before, _, kept, _ = results["toxicity"]
    assert ids(before) == sorted(documents) and ids(kept) == sorted(d for d in documents if toxic[d][0] < 0.7)
    assert {r["doc_id"]: r["text"] for r in kept} == {r["doc_id"]: documents[r["doc_id"]] for r in kept}

    before, _, kept, _ = results["exact_dedup"]
    first = {}
    for r in sorted(before, key=lambda r: r["doc_id"]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or ""), r["doc_id"])
    assert ids(kept) == sorted(first.values())

    before, _, kept, _ = results["ngram_jaccard"]
    near = brute_near([(r["doc_id"], r["text"]) for r in before], 5, 80, 100)
    assert ids(kept) == sorted(d for d, (n, c) in near.items() if n == 0 or c == d)

    before, columns, kept, _ = results["mixing"]
    con = duckdb.connect()
    con.execute("CREATE TABLE d (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO d VALUES (?, ?, ?)", [(r["doc_id"], r["text"], r["source"]) for r in before])
    words = {d: (size, taken) for d, size, taken in con.execute(f"SELECT doc_id, size, taken FROM ({oracle('d')})").fetchall()}
    copies = Counter(ids(kept))
    assert {d: n * words[d][0] for d, n in copies.items() if words[d][0]} == {d: t for d, (s, t) in words.items() if t}

    before, _, rows, _ = results["packing"]
    assert sorted(map(tuple, rows)) == sorted(map(tuple, last))
    packed_right(rows, Counter(ids(before)), {d: encode(t) for d, t in documents.items()})


def test_pipeline_stages_begin_with_small_heaps(spark):
    """The garbage of a stage has been collected when the next one begins."""
    import corpus_pipeline

    full = lambda: max(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    before, seen = full(), []
    corpus_pipeline.stage(lambda *_: seen.append(full()))(spark, None, "")
    assert seen[0] > before


def test_words_of_many_parts_are_looked_up_together(monkeypatch):
    r = random.Random(8)
    texts = ["", " a b ", "Idiot idiots idiotic", *(" ".join(f"word{r.randrange(60)}" for _ in range(r.randrange(30))) for _ in range(90))]
    terms, calls = toxicity.Terms(toxicity.Terms.vocabulary(pa.array([f"word{i}" for i in range(40)] + ["idiot", "a"]))), []
    lookup = terms.lookup
    monkeypatch.setattr(terms, "lookup", lambda words: calls.append(len(words)) or lookup(words))
    parts = [texts[i : i + 7] for i in range(0, len(texts), 7)]
    got = [dict(zip(*(x.tolist() for x in q), strict=True)) for q in terms.count(parts)]
    assert len(calls) == 1 and len(got) == len(texts)
    monkeypatch.setattr(toxicity, "WIDE", 1)
    assert got == [dict(zip(*(x.tolist() for x in q), strict=True)) for q in terms.count(parts)] and len(calls) == 1 + len(parts)
    ids = {t.as_py(): i for i, t in enumerate(toxicity.Terms.vocabulary(pa.array([f"word{i}" for i in range(40)] + ["idiot", "a"])))}
    assert got == [dict(Counter(ids[t] for w in x.lower().split() for t in toxicity.terms_of(w) if t in ids)) for x in texts]
