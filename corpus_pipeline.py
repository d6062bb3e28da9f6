"""A training corpus from raw documents: toxic documents, copies and near copies out, sources mixed, tokens packed.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the columns
of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import exact, mixing, packing, partenum, toxicity
from tidewright.llm.common import read, scratch, sweep, trim, written

#: Tables that the last stage wrote on the way; its result has been written when the next stage begins.
_used: list[str] = []


def stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        sweep(spark, _used)
        trim(spark)
        with scratch() as paths:
            out = f(spark, docs, sf_dir)
        _used.extend(paths)
        return out

    return run


@stage
def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 or more go; labels only train."""
    return toxicity.clean(docs, docs, read(spark, sf_dir, "labels"))


@stage
def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return exact.deduplicated(docs)


@stage
def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a Jaccard similarity of 0.8 of five-word shingles the smallest doc_id stays."""
    return partenum.representatives(docs, words=5, num=80, den=100)


@stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mixed(docs)


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a sequence."""
    return packing.pack(docs, cache=100_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("ngram_jaccard", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: Neighbour votes, differencing and the draw's effects are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written before the next stage reads it."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
