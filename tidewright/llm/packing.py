"""Packing token ids into windows by Karmarkar-Karp multiway differencing.

A partial partition is a vector of window sums, largest first. Differencing takes the two partial partitions of the
largest spread and lays the largest sums of one onto the smallest of the other, so opposing imbalances cancel; what is left
at the end has near-equal windows. The number of windows is the least that could hold the tokens, and rises whenever the
largest window exceeds the capacity.

Documents longer than a window give whole windows of their own first (no padding); the rests go through the differencing
in batches of bounded size. Each task packs its own rows: no shuffle, no hot key, and a lost task is simply run again with
the same rows and the same result.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

WINDOW = 2048
#: Pieces differenced together, and the longest of them: shorter ones balance better but cut documents more often.
BATCH, PIECE = 512, 512
#: End-of-document id.
END = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padding long"


def difference(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(window of each item, sums of the windows) by multiway differencing. Ties go to the earlier item."""
    n = len(sizes)
    if n == 0 or k <= 1:
        return np.zeros(n, np.int64), np.array([sizes.sum() if n else 0], np.int64)
    sums: dict[int, np.ndarray] = {}
    slots: dict[int, np.ndarray] = {}
    heap = []
    for i, s in enumerate(sizes):
        v, t = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        v[0], t[0] = s, i
        sums[i], slots[i] = v, t
        heap.append((-int(s), i))
    heapq.heapify(heap)
    left, right, base = np.empty((n - 1, k), np.int64), np.empty((n - 1, k), np.int64), n
    for m in range(n - 1):
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        v = sums.pop(a) + sums.pop(b)[::-1]
        left[m], right[m] = slots.pop(a), slots.pop(b)[::-1]
        order = np.argsort(-v, kind="stable")
        left[m], right[m] = left[m][order], right[m][order]
        sums[base + m], slots[base + m] = (v := v[order]), n + m * k + np.arange(k)
        heapq.heappush(heap, (-int(v[0] - v[-1]), base + m))
    owner = np.full(n + (n - 1) * k + 1, -1, np.int64)  # the last place takes what an empty slot writes
    owner[n + (n - 2) * k : n + (n - 1) * k] = np.arange(k)
    for m in range(n - 2, -1, -1):
        mine = owner[n + m * k : n + (m + 1) * k]
        owner[left[m]] = mine
        owner[right[m]] = mine
    return owner[:n], sums[base + n - 2] if n > 1 else sums[0]


def balance(sizes: np.ndarray, capacity: int = WINDOW) -> tuple[np.ndarray, int]:
    """(window of each item, number of windows), no window above the capacity."""
    total = int(sizes.sum())
    k = max(1, -(-total // capacity))
    while True:
        owner, sums = difference(sizes, k)
        if sums.max(initial=0) <= capacity:
            return owner, k
        k += max(1, int(k * (sums.max() - capacity) / capacity) // 2)


class Packer:
    """Packs a stream of (doc_id, id bytes) and yields rows of SCHEMA in batches."""

    def __init__(self, task: int, capacity: int = WINDOW, batch: int = BATCH, piece: int = PIECE):
        self.next, self.capacity, self.batch, self.piece = task << 36, capacity, batch, piece
        self.rows: list[tuple] = []
        self.pieces: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n, at, cap = len(ids) // 4, 0, self.capacity
        while n - at >= cap:
            self.rows.append((doc_id, at, cap, zlib.crc32(ids[4 * at : 4 * (at + cap)]), n, self.next, 0, 0))
            self.next += 1
            at += cap
        if rest := n - at:
            parts = -(-rest // self.piece)
            for p in range(parts):
                end = n if p == parts - 1 else at + rest // parts
                self.pieces.append((doc_id, at, end - at, zlib.crc32(ids[4 * at : 4 * end]), n))
                at = end
            if len(self.pieces) >= self.batch:
                self.flush()

    def flush(self) -> None:
        if not self.pieces:
            return
        owner, k = balance(np.array([p[2] for p in self.pieces], np.int64), self.capacity)
        filled = [0] * k
        placed = []
        for p, w in zip(self.pieces, owner.tolist(), strict=True):
            placed.append((*p, self.next + w, filled[w]))
            filled[w] += p[2]
        pad = [0 if f & (f - 1) == 0 else self.capacity - f for f in filled]  # a window of a power of two isn't padded
        self.rows += [(*p, pad[p[5] - self.next]) for p in placed]
        self.next += k
        self.pieces = []

    def take(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows, strict=True)) if self.rows else [[]] * 8
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [f.split()[0] for f in SCHEMA.split(", ")])


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = WINDOW, batch: int = BATCH, piece: int = PIECE, cache: int | None = None) -> DataFrame:
    """Packs ``docs`` (doc_id, text); one row per piece.

    vocabulary: path of a tokenizer file present on every executor (default: the public word vocabulary). cache: words that a
    worker holds; fewer take less memory and more time. A null or empty
    text is the end id alone. Repeated rows are packed as often as they occur, a null doc_id stays null, other columns are
    ignored, an empty table gives no rows.
    """
    from tidewright.llm.tokens import CACHE, IdCache

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = IdCache.shared(vocabulary)
        ids.limit = cache or CACHE
        p = Packer(TaskContext.get().partitionId(), capacity, batch, piece)
        for b in batches:
            texts = (t.as_py() or "" for t in b.column(1))
            for doc_id, got in zip(b.column(0).to_pylist(), ids.encode_many(texts), strict=True):
                p.add(doc_id, got + END.to_bytes(4, "little"))
                if len(p.rows) >= 4096:
                    yield p.take()
        p.flush()
        yield p.take()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
