"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words. Within a source a document's expected number of copies is c * w, at most 2, with a
weight w that grows with the bits of its size (long documents are worth repeating sooner); c is set so that the expected
words equal the target. The whole part of that number is certain. The fractional part f is an inclusion probability:
documents are ranked by the odds of a random number over the odds of f, and the first ones are taken until the words that
the certain copies leave open are filled. So the sample's size is fixed, with unequal probabilities.

Nothing sorts a source: its documents are counted in bins of the rank key, and only the bin in which the target is reached is
looked at row by row. The result is one cut per source, which any scan of the documents can apply without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import hash_unit, small_join, whole, word_count, written

WEIGHTS, SHARE, MOST, BINS, SEED = (5.0, 2.0, 1.0), 1.5, 2, 4096, "mix"
_LOW = -(2**63) + 1


def _keys(source: Column) -> Column:
    """Sources as a key without nulls."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def measured(docs: DataFrame) -> DataFrame:
    """Columns _id, _src, size, _w, _u beside the documents': all that the draw depends on."""
    d = docs.withColumn("size", word_count(F.col("text"))).withColumn("_src", _keys(F.col("source")))
    d = d.withColumn("_id", F.coalesce("doc_id", F.lit(_LOW)))
    return d.withColumn("_w", F.length(F.bin("size")).cast("double")).withColumn("_u", hash_unit(SEED, F.col("doc_id")))


def targets(strata: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: source_size, target. The level at which sources stop is found in one pass over the sources in
    order of the level that would fill them; there are as many rows as sources."""
    s = strata.groupBy("_src", "source").agg(F.sum("s").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = s.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most).withColumn("fill", F.col("cap") / F.col("weight"))
    w = Window.orderBy("fill", F.col("source").asc_nulls_last())
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    s = s.withColumn("all", F.sum("source_size").over(everything) * F.lit(share))
    s = s.withColumn("level", (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after))
    s = s.withColumn("level", F.max(F.when(F.col("fill") >= F.col("level"), F.col("level"))).over(everything))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return s.select("_src", "source_size", target.alias("target"))


def rates(strata: DataFrame, goal: DataFrame, most: int = MOST) -> DataFrame:
    """One row per source and weight: expected copies as whole and fraction, and the words left for the draw."""
    s = strata.join(goal, "_src")
    down = Window.partitionBy("_src").orderBy(F.col("_w").desc())
    before, after = down.rowsBetween(Window.unboundedPreceding, -1), down.rowsBetween(0, Window.unboundedFollowing)
    c = F.try_divide(F.col("target") - F.coalesce(F.sum("s").over(before), F.lit(0)) * most, F.sum(F.col("_w") * F.col("s")).over(after))
    s = s.withColumn("c", c)
    src = Window.partitionBy("_src")
    s = s.withColumn("c", F.max(F.when(F.col("c") * F.col("_w") <= most, F.col("c"))).over(src))
    s = s.withColumn("rate", F.least(F.lit(float(most)), F.coalesce(F.col("c") * F.col("_w"), F.lit(float(most)))))
    s = s.withColumn("whole", F.floor("rate")).withColumn("part", F.col("rate") - F.col("whole"))
    return s.withColumn("open", F.col("target") - F.sum(F.col("whole") * F.col("s")).over(src)).select("_src", "_w", "source_size", "target", "whole", "part", "open")


def rank_key() -> Column:
    """Q / (1 + Q) of Q = odds of the random number over odds of the inclusion probability."""
    u, f = F.col("_u"), F.col("part")
    a, b = u * (F.lit(1.0) - f), f * (F.lit(1.0) - u)
    return F.when(f > 0, a / (a + b))


def plan(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(thin documents, the draw). The draw has one row per source and weight: rates, and the source's cut."""
    thin = written(measured(docs.select("doc_id", "text", "source")).select("doc_id", "source", "_id", "_src", "size", "_w", "_u"), "mix-thin")
    strata = written(thin.groupBy("_src", "source", "_w").agg(F.sum("size").alias("s")), "mix-strata")
    rate = written(rates(strata, targets(strata, weights, share, most), most), "mix-rates")
    keyed = small_join(thin, rate, ["_src", "_w"]).withColumn("_k", rank_key()).filter("_k IS NOT NULL").withColumn("_bin", F.floor(F.col("_k") * BINS))
    bins = keyed.groupBy("_src", "_bin").agg(F.sum("size").alias("s"), F.first("open").alias("open"))
    upto = Window.partitionBy("_src").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("sum", F.sum("s").over(upto))
    edge = written(bins.filter("sum >= open AND sum - s < open").groupBy("_src").agg(F.min("_bin").alias("_edge"), F.min(F.struct("_bin", (F.col("sum") - F.col("s")).alias("b")))["b"].alias("below"), F.first("open").alias("open")), "mix-edges")
    near = small_join(keyed.select("_src", "_bin", "_k", "_id", "size"), edge, "_src").filter("_bin = _edge")
    row = Window.partitionBy("_src").orderBy("_k", "_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("sum", F.col("below") + F.sum("size").over(row))
    inside = (F.col("sum") <= F.col("open")) | ((F.col("sum") - F.col("size") < F.col("open")) & (F.col("size") / 2 <= F.col("open") - (F.col("sum") - F.col("size"))))
    last = near.groupBy("_src").agg(F.max(F.when(inside, F.struct("_k", "_id", "size"))).alias("last"))
    cut = edge.join(last, "_src", "left").select("_src", F.coalesce("last", F.struct((F.col("_edge") / F.lit(float(BINS))).alias("_k"), F.lit(-(2**63)).alias("_id"), F.lit(0).cast("long").alias("size"))).alias("cut"))
    nothing = F.when(F.col("open") <= 0, F.struct(F.lit(-1.0).alias("_k"), F.lit(0).cast("long").alias("_id"), F.lit(0).cast("long").alias("size")))
    everything = F.struct(F.lit(2.0).alias("_k"), F.lit(0).cast("long").alias("_id"), F.lit(0).cast("long").alias("size"))
    draw = rate.join(cut, "_src", "left").withColumn("cut", F.coalesce("cut", nothing, everything))
    return thin, written(draw, "mix-draw")


def drawn(measured_docs: DataFrame, draw: DataFrame) -> DataFrame:
    """The documents with ``copies``."""
    d = small_join(measured_docs, draw, ["_src", "_w"]).withColumn("_k", rank_key())
    hit = F.coalesce(F.struct("_k", "_id", "size") <= F.col("cut"), F.lit(False)) & F.col("_k").isNotNull()
    return d.withColumn("copies", F.col("whole").cast("long") + hit.cast("long"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken per document.

    Null text has size 0 and is never needed; a null source is a source of its own, after all others; a null doc_id draws
    like any other key; rows that agree in doc_id and size share their rank. An empty table gives no rows.
    """
    thin, draw = plan(docs, weights, share, most)
    return drawn(thin, draw).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mixed corpus itself: the documents' own columns, each row as often as it was drawn. Texts are not shuffled."""
    _, draw = plan(docs, weights, share, most)
    out = drawn(measured(whole(docs, "doc_id", "text", "source")), draw)
    return out.filter("copies > 0").withColumn("_n", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("_all.*")


_SIZE = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
#: The same draw in DuckDB; docs: a table or query, with doc_id, text, source.
SQL = """WITH d AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS src, {size} AS size, coalesce(doc_id, -9223372036854775807) AS id,
 (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM {docs}),
m AS (SELECT *, CAST(length(bin(size)) AS DOUBLE) AS w FROM d),
st AS (SELECT src, source, w, CAST(sum(size) AS BIGINT) AS s FROM m GROUP BY ALL),
so AS (SELECT src, any_value(source) AS source, CAST(sum(s) AS BIGINT) AS source_size FROM st GROUP BY src),
wt AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS weight, source_size * 2 AS cap FROM so),
fl AS (SELECT *, cap / weight AS fill, (SELECT sum(source_size) FROM so) * 1.5::DOUBLE AS total FROM wt),
lv AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT) / sum(weight) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM fl),
tg AS (SELECT src, source_size, least(cap::DOUBLE, coalesce((SELECT max(level) FROM lv WHERE fill >= level) * weight, cap::DOUBLE)) AS target FROM lv),
c0 AS (SELECT st.src, w, s, source_size, target, CASE WHEN sum(w * s) OVER b = 0 THEN NULL ELSE (target - coalesce(sum(s) OVER a, 0)::BIGINT * 2) / sum(w * s) OVER b END AS c FROM st JOIN tg USING (src)
 WINDOW a AS (PARTITION BY st.src ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), b AS (PARTITION BY st.src ORDER BY w DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
c1 AS (SELECT *, max(CASE WHEN c * w <= 2 THEN c END) OVER (PARTITION BY src) AS cc FROM c0),
r0 AS (SELECT *, least(2.0::DOUBLE, coalesce(cc * w, 2.0::DOUBLE)) AS rate FROM c1),
r1 AS (SELECT *, floor(rate)::BIGINT AS whole, rate - floor(rate) AS part FROM r0),
r2 AS (SELECT *, target - sum(whole * s) OVER (PARTITION BY src)::BIGINT AS open FROM r1),
k AS (SELECT m.doc_id, m.source, m.src, m.id, m.size, r2.* EXCLUDE (src), CASE WHEN part > 0 THEN u * (1.0 - part) / (u * (1.0 - part) + part * (1.0 - u)) END AS q FROM m JOIN r2 ON m.src = r2.src AND m.w = r2.w),
n AS (SELECT *, CASE WHEN q IS NOT NULL THEN sum(CASE WHEN q IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY src ORDER BY q NULLS LAST, id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT END AS cum FROM k),
t AS (SELECT *, CASE WHEN q IS NOT NULL AND open > 0 AND (cum <= open OR (cum - size < open AND size / 2 <= open - (cum - size))) THEN 1 ELSE 0 END AS hit FROM n)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST((whole + hit) * size AS BIGINT) AS taken FROM t"""


def oracle(docs: str = "documents") -> str:
    return SQL.format(size=_SIZE, docs=docs)
