"""Nulls, empty and repeated rows, ties, empty tables, and extra columns whose names clash, for every operator and stage."""

import zlib

import pytest

from tidewright.llm import exact, html, media, mixing, ngram, packing, partenum, toxicity, urls, warc

EXTRA = "`my col-x` string, _all int, _score double, _evidence string, _id string, _row int, _src string, _k double, _many string, k string, root string, size string, node string, print string, copies int, held int, block string"
SCHEMA = f"doc_id long, text string, source string, {EXTRA}"
TAIL = ("a", 1, 0.5, "e", "i", 2, "s", 0.25, "m", "k", "r", "z", "n", "p", 3, 4, "b")
TEXTS = [(1, None, "x"), (2, "", "x"), (3, " \t ", None), (4, "one two three four five six seven", "y"), (5, "one  two three four five six\nseven", "y"), (5, "one  two three four five six\nseven", "y"), (None, "Null id has words of its own here", None), (None, None, None), (8, "one two three four five six seven eight", "x")]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(*r, *TAIL) for r in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 0), (5, 1), (5, 0), (8, 0), (None, 1), (77, 1), (2, None)], "doc_id long, toxic int")


@pytest.mark.parametrize("name", ["toxicity", "exact", "near", "mixing"])
def test_stages_keep_all_columns(rows, none, labels, name):
    f = {"toxicity": lambda d: toxicity.clean(d, d, labels), "exact": exact.deduplicated, "near": partenum.representatives, "mixing": mixing.mixed}[name]
    out = f(rows)
    assert out.columns == rows.columns and [t for _, t in out.dtypes] == [t for _, t in rows.dtypes]
    got = out.collect()
    assert all(tuple(r)[3:] == TAIL for r in got) and {tuple(r)[:3] for r in got} <= set(TEXTS)
    kept = sorted(((r["doc_id"], r["text"]) for r in got), key=str)
    if name == "exact":
        assert [d for d, _ in kept] == [1, 3, 4, 8, None] and "one  two three four five six\nseven" not in {t for _, t in kept}
    if name == "near":  # 4 and 5 are equal sets, 8 has three of four shingles: below 0.8
        assert sorted(d or -1 for d, _ in kept) == [-1, -1, 1, 2, 3, 4, 8]
    if name == "toxicity":
        assert len(got) == len(TEXTS)
    empty = f(none)
    assert empty.count() == 0 and empty.columns == none.columns


def test_operators_on_odd_rows(rows, none, labels):
    assert packing.pack(rows).agg({"length": "sum"}).first()[0] == sum(r["doc_tokens"] for r in packing.pack(rows).filter("start = 0").collect())
    mixed = mixing.mix(rows).collect()
    assert len(mixed) == len(TEXTS) and all(0 <= r["taken"] <= 2 * r["size"] for r in mixed)
    scores = ngram.scores(rows).collect()
    assert sorted(r["n_tokens"] for r in scores) == [1, 1, 1, 1, 8, 8, 8, 9, 9]
    groups = exact.exact_groups(rows).collect()
    assert sorted(r["group_size"] for r in groups) == [1, 1, 1, 3, 3, 3, 3, 3, 3]
    assert sum(r["kept"] for r in groups) == 5 and {r["keep_id"] for r in groups if r["group_size"] == 3} == {1, 4}
    near = partenum.join(rows).collect()
    assert len(near) == len(TEXTS) and {r["n_shingles"] for r in near if r["doc_id"] in (1, 2, 3)} == {0}
    assert {r["component_id"] for r in near if r["doc_id"] in (4, 5)} == {4}
    assert {(r["n_bytes"], r["payload_bytes"]) for r in media.media(rows).collect() if r["doc_id"] in (1, 2)} == {(0, 64)}
    tox = toxicity.toxicity(rows, labels).collect()
    assert len(tox) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in tox)
    assert len({r["score"] for r in tox if r["doc_id"] in (1, 2, 3)}) == 1
    for f in (packing.pack, mixing.mix, ngram.scores, exact.exact_groups, partenum.join, media.media, lambda d: toxicity.toxicity(d, labels)):
        assert f(none).count() == 0


def test_repeated_labelled_ids_are_one_example(spark):
    one = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 3 != 1)
    docs = spark.createDataFrame([(one, f"text number {i}") for i in range(50)], "doc_id long, text string")
    out = toxicity.toxicity(docs, spark.createDataFrame([(one, 1)] * 20, "doc_id long, toxic int")).collect()
    assert len(out) == 50 and all(r["evidence"] == [one] for r in out)


def test_page_operators_on_odd_rows(spark):
    pages = [(1, None, None), (1, None, None), (2, "http://A.com/en/x", ""), (3, "no scheme", "<p>"), (None, "http://x", "<article><p>Long enough to be a text of its own, surely.</p></article>"), (4, "u://H?q", "same"), (5, None, "same"), (5, "again", "same")]
    df = spark.createDataFrame([(*p, "k", 1) for p in pages], "page_id long, url string, html string, `my col-x` string, text int")
    texts = html.extract(df).collect()
    assert len(texts) == len(pages) and all(r["text"] is not None and r["n_chars"] == len(r["text"]) for r in texts)
    judged = urls.judge_urls(df).collect()
    assert len(judged) == len(pages) and {(r["host"], r["path"]) for r in judged if r["page_id"] in (1, 3)} == {("", "")}
    assert next(r for r in judged if r["page_id"] == 2)["rule"] == "com/en/"
    back = warc.round_trip(df).collect()
    assert len(back) == len(pages)
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in back if r["page_id"] in (4, 5)) == [(4, "response", None), (5, "revisit", 4), (5, "revisit", 4)]
    none = df.limit(0)
    assert html.extract(none).count() == urls.judge_urls(none).count() == warc.round_trip(none).count() == 0
