"""Exact deduplication with counting quotient filters.

Each partition puts the 64-bit fingerprints of its texts into counting quotient filters: the top bits choose a shard's
filter, the next bits are the quotient (the home slot), the rest the remainder, kept sorted within its run, with a counter.
Filters of one shard merge without loss: the smaller one moves bits of its remainders to its quotients until both have as many
slots, then the runs of equal slots are merged by their sorted remainders, and counters of equal ones are added. Fingerprints
counted more than once go on to the comparison of the texts' bytes; all others are unique. A partition makes a filter only for
shards of which it has a fingerprint, so there are no more filters than rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import SPACE, small_join, whole, written

#: Fingerprints expected in one merged filter; the number of shards follows from it and the rows.
PER_SHARD = 1_000_000


class QuotientFilter:
    """Home slots in ascending order, remainders in ascending order within each slot's run, counters."""

    def __init__(self, q: int, home: np.ndarray, rest: np.ndarray, counts: np.ndarray, width: int = 64):
        """width: bits of quotient and remainder together."""
        self.q, self.home, self.rest, self.counts, self.width = q, home, rest, counts, width

    @classmethod
    def of(cls, values: np.ndarray, q: int, width: int = 64) -> QuotientFilter:
        """The last ``width`` bits of the values."""
        prints, counts = np.unique(values & np.uint64((1 << width) - 1), return_counts=True)
        shift = np.uint64(width - q)
        return cls(q, prints >> shift, prints & np.uint64((1 << (width - q)) - 1), counts, width)

    @property
    def prints(self) -> np.ndarray:
        return self.home << np.uint64(self.width - self.q) | self.rest

    def encode(self) -> bytes:
        """Occupied slots as bits, ends of runs as bits, remainders, and the counters above 1 with their places."""
        n = len(self.rest)
        occupied = np.zeros(1 << self.q, bool)
        occupied[self.home.astype(np.int64)] = True
        ends = np.append(self.home[1:] != self.home[:-1], True)[:n]
        wide = -(-(self.width - self.q) // 8)
        raw = np.ascontiguousarray(self.rest.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :wide]
        extra = np.flatnonzero(self.counts > 1)
        head = np.array([self.q, self.width, n, len(extra)], "<i8").tobytes()
        return head + np.packbits(occupied).tobytes() + np.packbits(ends).tobytes() + raw.tobytes() + extra.astype("<i8").tobytes() + self.counts[extra].astype("<i8").tobytes()

    @classmethod
    def decode(cls, data: bytes) -> QuotientFilter:
        q, width, n, m = (int(x) for x in np.frombuffer(data, "<i8", 4))
        wide = -(-(width - q) // 8)
        at = 32 + np.cumsum([0, max(1, (1 << q) // 8), -(-n // 8), n * wide, 8 * m, 8 * m])
        part = [data[a:z] for a, z in zip(at[:-1], at[1:], strict=True)]
        occupied = np.unpackbits(np.frombuffer(part[0], np.uint8))[: 1 << q]
        ends = np.unpackbits(np.frombuffer(part[1], np.uint8))[:n].astype(np.int64)
        raw = np.zeros((n, 8), np.uint8)
        raw[:, :wide] = np.frombuffer(part[2], np.uint8).reshape(n, wide)
        counts = np.ones(n, np.int64)
        counts[np.frombuffer(part[3], "<i8")] = np.frombuffer(part[4], "<i8")
        home = np.flatnonzero(occupied).astype(np.uint64)[np.cumsum(ends) - ends]  # an entry's run: the ends before it
        return cls(q, home, raw.view("<u8")[:, 0].astype(np.uint64), counts, width)

    def resized(self, q: int) -> QuotientFilter:
        """The same entries in more slots: remainders lose their upper bits to the quotients, the order stays."""
        shift = np.uint64(self.width - q)
        home = self.home << np.uint64(q - self.q) | self.rest >> shift
        return QuotientFilter(q, home, self.rest & np.uint64((1 << (self.width - q)) - 1), self.counts, self.width)

    def merge(self, other: QuotientFilter) -> QuotientFilter:
        big, small = (self, other) if len(self.rest) >= len(other.rest) else (other, self)
        q = max(big.q, small.q)
        big, small = big.resized(q), small.resized(q)
        starts, stops = (np.searchsorted(big.home, small.home, side=x) for x in ("left", "right"))
        low, high = starts, stops.copy()
        while (open_ := low < high).any():  # each entry's place in the run of its slot
            mid = np.minimum((low + high) >> 1, max(len(big.rest) - 1, 0))
            less = open_ & (big.rest[mid] < small.rest)
            low, high = np.where(less, mid + 1, low), np.where(open_ & ~less, mid, high)
        same = low < stops
        same[same] = big.rest[low[same]] == small.rest[same]
        counts = big.counts.copy()
        counts[low[same]] += small.counts[same]
        put = lambda x, y: np.insert(x, low[~same], y[~same])
        return QuotientFilter(q, put(big.home, small.home), put(big.rest, small.rest), put(counts, small.counts), self.width)


def merged(filters: list[QuotientFilter]) -> QuotientFilter:
    """Pairwise, so each fingerprint takes part in few merges."""
    while len(filters) > 1:
        filters = [filters[i].merge(filters[i + 1]) if i + 1 < len(filters) else filters[i] for i in range(0, len(filters), 2)]
    return filters[0]


def repeated(prints: DataFrame, column: str, bits: int) -> DataFrame:
    """(fp, n) for every value of the long column that occurs more than once; 2^bits shards."""
    width = 64 - bits

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) for b in batches]
        values = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
        shard = (values >> np.uint64(width)).astype(np.int64)
        found, starts = np.unique(shard, return_index=True)
        for s, a, z in zip(found.tolist(), starts, [*starts[1:], len(values)], strict=False):  # none if there are no values
            q = int(np.clip(np.log2(max(z - a, 2)), 3, 20))
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([QuotientFilter.of(values[a:z], q, width).encode()], pa.binary())], ["shard", "filter"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        f = merged([QuotientFilter.decode(x) for x in pdf["filter"]])
        many = f.counts > 1
        prints = f.prints[many] | np.uint64(int(pdf["shard"].iloc[0]) << width)
        return pd.DataFrame({"fp": prints.view(np.int64), "n": f.counts[many]})

    built = prints.select(column).mapInArrow(build, "shard int, filter binary")
    return built.groupBy("shard").applyInPandas(meet, "fp long, n long")


def normal(text: Column) -> Column:
    """Runs of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(thin, dups). thin: _row, doc_id, sha, fp per row. dups: per text that occurs more than once sha, keep_id, keep_row,
    group_size; of several rows with the smallest doc_id (null last) one stays."""
    thin = docs.select("doc_id", normal(F.col("text")).alias("t")).select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.unhex(F.sha2("t", 256)).alias("sha"), F.xxhash64("t").alias("fp"))
    thin = written(thin, "exact-thin")
    bits = max(4, (thin.count() // PER_SHARD).bit_length())
    many = written(repeated(thin, "fp", bits), "exact-many")
    # the bytes of all texts whose fingerprint repeats; equal ones meet as one row per task before the shuffle
    texts = small_join(docs.select("doc_id", normal(F.col("text")).alias("t")).withColumn("fp", F.xxhash64("t")), many.select("fp"), "fp", "left_semi")
    same = texts.groupBy("fp", "t").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    same = written(same.select(F.unhex(F.sha2("t", 256)).alias("sha"), "keep_id", "group_size"), "exact-same")
    rows = small_join(thin, same.select("sha"), "sha", "left_semi").groupBy("sha").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "_row"))["_row"].alias("keep_row"))
    return thin, written(same.join(rows, "sha"), "exact-groups")


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    Null text counts as empty; empty texts are equal to one another. Rows that repeat a doc_id with the same text are copies
    like any others: one stays. A null doc_id stays only where no other row of its group has one (keep_id then null).
    """
    thin, dups = groups(docs)
    out = small_join(thin, dups, "sha", "left")
    alone = F.col("keep_row").isNull()
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (alone | (F.col("keep_row") == F.col("_row"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns. Rows of one doc_id and text are told apart by nothing, so any of them
    is the one that stays."""
    _, dups = groups(docs)
    d = whole(docs, "doc_id", "text").withColumn("_sha", F.unhex(F.sha2(normal(F.col("text")), 256)))
    g = dups.select(F.col("sha").alias("_sha"), "keep_id", F.lit(True).alias("_many"))
    d = small_join(d, g, "_sha", "left").filter(F.col("_many").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id")))
    once = d.filter(F.col("_many").isNull()).select("_all.*")
    return once.unionByName(d.filter("_many").dropDuplicates(["_sha"]).select("_all.*"))


SQL = r"""SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256 FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)"""
