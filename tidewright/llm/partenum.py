"""Jaccard self-join of word shingles by PartEnum signatures.

Sets are put into bands of sizes so that similar sets lie in one band or in neighbouring ones. In a band similar sets differ in
at most k features. The feature domain is cut into n1 parts, each into n2; in some part at most k2 = k / n1 features differ, so
some n2 - k2 of its subparts agree: a signature is the content of such a subset of subparts, and similar sets share one. A set
has the signatures of its own band and of the next one. Long sets use k2 = 0 (the subsets are the parts themselves); short ones
use n2 = 3, k2 = 1. Long sets have more parts than k + 1. Sets that differ in at most d features agree in n1 - d parts, so each
may leave out its n1 - d - 1 least parts in any order that depends on a part's content alone: the greatest part that they agree
in is left out by neither. The order is by number of features, as parts of few features are shared by chance or by a common
passage; d is the most that a set of this size can differ from a similar one of the band.

Sets that are equal are one node from the start. Buckets of a signature are not expanded into pairs: each member is compared
with the bucket's least member, components are formed, and only members of different components are looked at again, in tiles
of bounded size: first along a forest of likely links, then the rest. Of the rest, members whose sketches (a bound on the
intersection that no similar pair fails) leave nobody of another component drop out; the others' whole sets meet in tiles,
components are joined at once, and only the links that join go out: fewer than a tile has members. Words, shingles and equal sets are told apart by 64-bit hashes, and
intersections are counted over all of them; a wrong link needs two different shingles or sets of the same 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import bucketed, small_join, whole, written
from tidewright.llm.components import components
from tidewright.llm.shingles import WordHashes, identity, mix, shingles
from tidewright.llm.worker import release

#: Differences up to which the subsets of three subparts are enumerated; parts beyond k + 1 of longer sets.
SHORT, SLACK = 12, 2
#: Members of one tile's side, and their features where whole sets meet.
TILE, FEATURES = 1024, 2_000_000
#: Members of a bucket that are held at once; a larger one is passed on as it is read.
HELD = 1_000_000
#: Documents handled together.
GROUP = 256
#: Bytes of a document's row: whether it has a doc_id, doc_id, size, fingerprint; what follows is its sketch.
FACTS = 32


class Bands:
    """Size bands and their parameters for a similarity of num / den."""

    def __init__(self, num: int, den: int):
        self.g = Fraction(num, den)
        self.ends: list[int] = []  # the largest size of each band

    def upto(self, size: int) -> np.ndarray:
        while not self.ends or self.ends[-1] < size:
            low = self.ends[-1] + 1 if self.ends else 1
            self.ends.append(max(low, int(low / self.g)))
        return np.array(self.ends, np.int64)

    def differences(self, band: np.ndarray) -> np.ndarray:
        """The most features in which similar sets of a band and the one below it can differ."""
        g = self.g
        while len(self.ends) <= int(band.max(initial=0)):
            self.upto(self.ends[-1] + 1 if self.ends else 1)
        each = np.array([int(2 * r * (1 - g) / (1 + g)) for r in self.ends], np.int64)
        return each[band]

    def partners(self, size: np.ndarray, band: np.ndarray) -> np.ndarray:
        """The most features in which a set of a size can differ from a similar one of a band; 0 if none can be similar
        without being equal."""
        self.differences(band)
        num, den = self.g.numerator, self.g.denominator
        ends = np.array([0, *self.ends], np.int64)
        most = np.minimum(ends[band + 1], size * den // num)
        return np.where(most > ends[band], (size + most) * (den - num) // (den + num), 0)


def _runs(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1]) if len(keys) else np.zeros(0, np.int64)


def signatures(flat: np.ndarray, sizes: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(signature, set) for sets given one after another, each sorted."""
    band = np.searchsorted(bands.upto(int(sizes.max(initial=1))), sizes)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    owner = np.repeat(np.arange(len(sizes)), sizes)
    content = mix(flat ^ np.uint64(0x5851F42D4C957F2D))
    high = flat >> np.uint64(32)
    for up in (0, 1):
        inst = band + up
        k = bands.differences(inst)
        mine = bands.partners(sizes, inst)
        short = (k > 0) & (k <= SHORT)
        n1 = np.where(short, k // 2 + 1, k + 1 + SLACK)
        fine = np.where(mine == 0, 0, np.where(short, 3 * n1, n1))  # equal sets alone need no signature
        base = np.concatenate([[0], np.cumsum(fine)]).astype(np.int64)
        if not base[-1]:
            continue
        use = fine[owner] > 0
        at = base[owner[use]] + ((high[use] * fine[owner[use]].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        starts = _runs(at)  # the parts are ranges of the hash, and each set is sorted
        dense = np.zeros(base[-1], np.uint64)
        dense[at[starts]] = np.add.reduceat(content[use], starts)
        part = np.repeat(np.arange(len(sizes)), fine)
        index = np.arange(base[-1]) - base[part]
        salt = mix(inst[part].astype(np.uint64) * np.uint64(1 << 32) + index.astype(np.uint64) + np.uint64(1))
        long_ = np.flatnonzero(~short[part])
        if len(long_):
            held = np.zeros(base[-1], np.int64)
            held[at[starts]] = np.diff(np.append(starts, len(at)))
            order = long_[np.lexsort((index[long_], dense[long_], held[long_], part[long_]))]
            place = np.arange(len(order)) - _runs(part[order])[np.cumsum(np.concatenate([[0], part[order][1:] != part[order][:-1]]))]
            take = order[place >= (n1 - mine - 1)[part[order]]]
            out.append((mix(dense[take] + salt[take]), part[take]))
        three = np.flatnonzero(short[part])
        if len(three):
            s = dense[three].reshape(-1, 3)
            rest = s.sum(1, dtype=np.uint64)[:, None] - s
            out.append((mix(rest.reshape(-1) ^ salt[three]), part[three]))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def sketch(s: np.ndarray) -> bytes:
    """Counts of the features by their low bits, four bits each, 15 for 15 or more: about one class a feature."""
    c = 1 << int(np.clip(round(np.log2(max(1, len(s)))), 4, 16))
    n = np.minimum(np.bincount((s & np.uint64(c - 1)).astype(np.int64), minlength=c), 15).astype(np.uint8)
    return (n[0::2] << 4 | n[1::2]).tobytes()


def narrow(raw: bytes) -> bytes:
    """A sketch folded to a quarter of its classes, at least 256: what tells most sets apart, for a first look."""
    c = 2 * len(raw)
    if c <= 256:
        return raw
    x = np.frombuffer(raw, np.uint8)
    n = np.minimum(np.stack([x >> 4, x & 15], 1).reshape(-1, max(256, c // 4)).sum(0), 15).astype(np.uint8)
    return (n[0::2] << 4 | n[1::2]).tobytes()


class Sketches:
    """Sketches side by side, folded to the fewest classes among them. The intersection of two sets is at most the sum of
    the lesser counts of each class; a class that is full on both sides says nothing. A coarser fold is asked first."""

    def __init__(self, raw: list[bytes], size: np.ndarray, num: int, den: int):
        c = 2 * min(map(len, raw))
        self.fine = np.empty((len(raw), c), np.uint8)
        self.full = np.zeros(len(raw), bool)
        for i, r in enumerate(raw):
            x = np.frombuffer(r, np.uint8)
            n = np.stack([x >> 4, x & 15], 1).reshape(-1, c)
            self.full[i] = (n == 15).any()
            self.fine[i] = np.minimum(n.sum(0, dtype=np.int64), 30) if len(n) > 1 else n[0]
            self.full[i] |= (self.fine[i] == 30).any()
        self.coarse = self.fine.reshape(len(raw), 8, c // 8).sum(1, dtype=np.uint8)  # at most 240
        self.size, self.num, self.den = size, num, den

    def may(self, i: int, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the sets j can be similar to set i, the bounds of their intersections)."""
        a, b = self.size[i], self.size[j]
        open_ = (a * self.den >= b * self.num) & (b * self.den >= a * self.num)
        skip = self.full[i] & self.full[j]
        bound = np.full(len(j), np.iinfo(np.int64).max)
        for h in (self.coarse, self.fine):
            at = np.flatnonzero(open_ & ~skip)
            bound[at] = np.minimum(h[j[at]], h[i]).sum(-1, dtype=np.int64)
            open_[at] = (self.den + self.num) * bound[at] >= self.num * (a + b[at])
        return open_, bound


def _texts(col: pa.Array) -> Iterator[bytes]:
    for t in col:
        yield (t.as_py() or "").encode("utf-8", "surrogatepass")


def _print() -> Column:
    """A text's fingerprint: with the doc_id it names the rows to read again."""
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("print")


def _emit(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Rows of one shuffle: (key = signature, node), and one a document with extra = (doc_id or null, size, fingerprint). The
    first of equal sets in a task also has the sketch there, and its key is the node; copies are dealt out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bands, done = WordHashes(), Bands(num, den), set()
        for b in batches:
            ids = b.column(0)
            for a in range(0, b.num_rows, GROUP):
                sets = [shingles(hashes.of(t), words) for t in _texts(b.column(1).slice(a, GROUP))]
                names = [identity(s) for s in sets]
                extra = []
                for doc_id, print_, s in zip(ids.slice(a, GROUP).to_pylist(), b.column(2).slice(a, GROUP).to_pylist(), sets, strict=True):
                    extra.append(np.array([0 if doc_id is None else 1, doc_id or 0, len(s), print_], ">i8").tobytes())
                if len(done) > 1_000_000:
                    done.clear()
                fresh: list[int] = []
                for i, (s, n) in enumerate(zip(sets, names, strict=True)):
                    if len(s) and n not in done:  # copies in one task give their signatures once
                        done.add(n)
                        fresh.append(i)
                        extra[i] += sketch(s)
                node = np.array(names, np.int64)
                spread = mix(node.view(np.uint64) + np.arange(a, a + len(node), dtype=np.uint64)).view(np.int64)
                spread[fresh] = node[fresh]
                yield pa.RecordBatch.from_arrays([pa.array(spread), pa.array(node), pa.array(extra, pa.binary())], ["key", "node", "extra"])
                if fresh:
                    sig, who = signatures(np.concatenate([sets[i] for i in fresh]), np.array([len(sets[i]) for i in fresh]), bands)
                    owner = node[np.array(fresh)][who]
                    yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(owner), pa.nulls(len(sig), pa.binary())], ["key", "node", "extra"])
        hashes.clear()
        del hashes, done
        release()

    return docs.select("doc_id", "text", _print()).mapInArrow(run, "key long, node long, extra binary")


def _gather(sorted_rows: DataFrame) -> DataFrame:
    """From rows sorted by (key, node): kind 0 documents (b node, extra), 3 nodes (the same of one of its documents, and the
    sketch), 1 stars (a node, b least node of its bucket),
    2 members of buckets of three nodes or more (a a name of the bucket's members, b node; the least, which its star compares
    with all others, has an empty extra): equal buckets count once."""

    def rows(kind: int, a: np.ndarray, b: np.ndarray, extra: pa.Array | None = None) -> pa.RecordBatch:
        extra = pa.nulls(len(a), pa.binary()) if extra is None else extra
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), extra], ["kind", "a", "b", "extra"])

    def closed(key: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(key):
            return
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
        key, node = key[new], node[new]
        starts = _runs(key)
        sizes = np.diff(np.append(starts, len(key)))
        least = np.repeat(node[starts], sizes)
        many = np.repeat(sizes, sizes)
        star = node != least
        if star.any():
            pair = np.unique(np.stack([node[star], least[star]], 1), axis=0)
            yield rows(1, np.ascontiguousarray(pair[:, 0]), np.ascontiguousarray(pair[:, 1]))
        if (many > 2).any():
            of = np.repeat(mix(np.add.reduceat(mix(node.view(np.uint64)), starts)).view(np.int64), sizes)
            for some, extra in ((star, None), (~star, b"")):
                pair = np.unique(np.stack([of[some & (many > 2)], node[some & (many > 2)]], 1), axis=0)
                yield rows(2, np.ascontiguousarray(pair[:, 0]), np.ascontiguousarray(pair[:, 1]), pa.array([extra] * len(pair), pa.binary()))

    def passed(key: int, least: int, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        """A part of a bucket too large to hold: it is named by its signature, and its rows are sorted, so the least is known."""
        node = node[np.concatenate([[True], node[1:] != node[:-1]])]
        yield rows(1, node[node != least], np.full(int((node != least).sum()), least))
        yield rows(2, np.full(len(node), key), node, pa.array([b"" if x else None for x in node == least], pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # of the last bucket, which may go on
        size, large = 0, None  # large: (key, least) of a bucket that is passed on
        last: np.ndarray = np.zeros(0, np.int64)  # the last node whose sketch has been seen
        for b in batches:
            extra = b.column(2)
            doc = np.asarray(extra.is_valid())
            k, n = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            if doc.any():
                of, what = n[doc], extra.filter(pa.array(doc))
                yield rows(0, k[doc], of, pc.binary_slice(what, 0, FACTS))
                full = pc.greater(pc.binary_length(what), FACTS)
                of, what = of[np.asarray(full)], what.filter(full)
                before = np.concatenate([last, of])[-len(of) - 1 : -1] if len(of) else of
                new = np.concatenate([np.ones(len(of) - len(before), bool), of[len(of) - len(before) :] != before])
                if new.any():  # one row a node; its copies come from other tasks and have its key
                    yield rows(3, of[new], of[new], what.filter(pa.array(new)))
                last = of[-1:] if len(of) else last
            k, n = k[~doc], n[~doc]
            if large and len(k):
                more = int(np.searchsorted(k, large[0], side="right"))
                if more:
                    yield from passed(*large, n[:more])
                k, n, large = k[more:], n[more:], large if more == len(k) else None
            if not len(k):
                continue
            cut = int(np.searchsorted(k, k[-1]))
            if cut or (held and held[0][0][0] != k[0]):
                yield from closed(*(np.concatenate(c) for c in zip(*held, (k[:cut], n[:cut]), strict=True)))
                held, size = [], 0
            held.append((k[cut:], n[cut:]))
            size += len(k) - cut
            if size > HELD:
                large = int(k[-1]), int(held[0][1][0])
                for _, x in held:
                    yield from passed(*large, x)
                held, size = [], 0
        if held:
            yield from closed(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return sorted_rows.mapInArrow(run, "kind int, a long, b long, extra binary")


def _texts_of(docs: DataFrame, facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) for the given nodes: one document each is read again. Only its id and fingerprint are broadcast, up to
    a bound; the texts of other documents are never shuffled below it."""
    want = written(facts.join(nodes, "node", "left_semi").select("node", F.coalesce("doc_id", F.lit(-(2**63))).alias("_id"), "print"), "near-want")
    d = docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("_id"), _print(), "text")
    got = written(small_join(d, want, ["_id", "print"], rows=200_000).select("node", "text"), "near-texts")
    return got if got.count() == want.count() else got.dropDuplicates(["node"])  # rows that repeat an id and its text


def _verified(pairs: DataFrame, docs: DataFrame, facts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar: den * intersection >= num * union."""
    pairs = written(pairs, "near-pairs")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    texts = _texts_of(docs, facts, nodes)
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        last, y = None, np.zeros(0, np.uint64)
        for t in batches:
            ok = []
            for b, left, right in zip(t.column(1).to_pylist(), _texts(t.column(2)), _texts(t.column(3)), strict=True):
                if b != last:  # the join has sorted by b
                    last, y = b, shingles(hashes.of(right), words)
                x = shingles(hashes.of(left), words)
                if len(x) * den < len(y) * num or len(y) * den < len(x) * num:
                    ok.append(False)
                    continue
                both_ = np.sort(np.concatenate([x, y]))
                same = int((both_[1:] == both_[:-1]).sum())
                ok.append(den * same >= num * (len(x) + len(y) - same))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([t.column(0).filter(keep), t.column(1).filter(keep)], ["a", "b"])
        hashes.clear()
        release()

    return written(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "near-links")


def _possible(pairs: DataFrame, facts: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that sizes and sketches don't rule out. A node is the a of as many pairs as it has signatures, but may be
    the b of any number: the facts of those are a table of their own, whose join's hot keys adaptive execution splits."""
    some = facts.select("node", "size", F.col("sketch").alias("data"))
    centres = written(some.join(pairs.select(F.col("b").alias("node")).distinct(), "node", "left_semi"), "near-facts")
    a, b = (x.select(*[F.col(c).alias(f"{c}_{s}") for c in x.columns]) for x, s in ((some, "a"), (centres, "b")))
    p = pairs.join(a, F.col("a") == F.col("node_a")).join(b, F.col("b") == F.col("node_b")).select("a", "b", "size_a", "size_b", "data_a", "data_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            sizes = [t.column(i).to_pylist() for i in (2, 3)]
            each = zip(*sizes, t.column(4).to_pylist(), t.column(5).to_pylist(), strict=True)
            keep = pa.array([bool(Sketches([x, y], np.array([m, n]), num, den).may(0, np.array([1]))[0][0]) for m, n, x, y in each], pa.bool_())
            yield pa.RecordBatch.from_arrays([t.column(0).filter(keep), t.column(1).filter(keep)], ["a", "b"])

    return p.mapInArrow(run, "a long, b long")


def _facts(rows: DataFrame, n: int) -> DataFrame:
    """(node, doc_id, size, print, sketch, short) of the rows of kind 3, in buckets by node, so that no sketch is shuffled again
    to meet its node; short: the sketch for a first look, which tiles of all buckets repeat."""
    facts = rows.filter("kind = 3").select(F.col("b").alias("node"), *_numbers(), F.expr(f"substring(extra, {FACTS + 1})").alias("sketch"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            short = pa.array([narrow(x.as_py()) for x in b.column(4)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, short], [*b.schema.names, "short"])

    return bucketed(facts.mapInArrow(run, "node long, doc_id long, size long, print long, sketch binary, short binary"), "near-facts", "node", n)


def _numbers() -> list[Column]:
    """doc_id, size and fingerprint from a document's row."""
    number = lambda at: F.conv(F.hex(F.substring("extra", at, 8)), 16, -10).cast("long")
    return [F.when(number(1) == 1, number(9)).alias("doc_id"), number(17).alias("size"), number(25).alias("print")]


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(sig, node, root, n) of the buckets whose members are of more than one component; n: the bucket's members."""
    m = members.select("sig", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = m.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo <> hi")
    return written(m.join(open_.select("sig", "n"), "sig"), "near-open")


def _tiled(m: DataFrame, facts: DataFrame, parts: Column) -> DataFrame:
    """Rows of (sig, node, root) with the facts of their nodes (node, size, data), sorted by tile: a bucket's members are
    dealt into ``parts`` sides, and every two sides meet in a tile (sig, lo, hi)."""
    m = m.withColumn("c", parts.cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("c")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    m = m.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).join(facts, "node")
    return m.select("sig", "lo", "hi", "own", "node", "root", "size", "data").repartition("sig", "lo", "hi").sortWithinPartitions("sig", "lo", "hi", "node")


class Tile:
    """Members of one tile: which two sides, and by member its side, node, root, size and data."""

    def __init__(self, t: pa.Table):
        self.sig, self.lo, self.hi = (t.column(i)[0].as_py() for i in range(3))
        self.own, self.node, self.root, self.size = (t.column(i).to_numpy() for i in range(3, 7))
        self.data = t.column(7)

    def others(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each member of the first side, and those of the second that it has to be compared with but for their components."""
        left, right = np.flatnonzero(self.own == self.lo), np.flatnonzero(self.own == self.hi)
        for i in left:
            yield i, right[self.node[right] > self.node[i]] if self.lo == self.hi else right


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[Tile]:
    """The tiles of two members or more, from rows sorted by tile."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        c = [b.column(i).to_numpy() for i in range(3)]
        new = (np.flatnonzero((c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1]) | (c[2][1:] != c[2][:-1])) + 1).tolist()
        for s, e in zip([0, *new], [*new, b.num_rows], strict=True):
            key = tuple(int(x[s]) for x in c)
            if key != last and held:
                if sum(x.num_rows for x in held) > 1:
                    yield Tile(pa.Table.from_batches(held))
                held = []
            last = key
            held.append(b.slice(s, e - s))
    if sum(x.num_rows for x in held) > 1:
        yield Tile(pa.Table.from_batches(held))


def _likely(members: DataFrame, facts: DataFrame, roots: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of one bucket in different components that the short sketches don't rule out: a forest of the likeliest ones,
    which would join each tile's components if all were links. A row (bucket, null) says that a bucket may hold more."""
    m = _open(members, roots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _tiles(batches):
            both, label, a, b, more = Sketches(t.data.to_pylist(), t.size, num, den), t.root.copy(), [], [], False
            for i, j in t.others():
                j = j[t.root[j] != t.root[i]]
                n, j = len(j), j[label[j] != label[i]]
                more |= len(j) < n
                if not len(j):
                    continue
                ok, bound = both.may(i, j)
                j = j[ok]
                if len(j):
                    j = j[np.lexsort((-bound[ok], label[j]))]
                    more |= len(j) > len(_runs(label[j]))
                    j = j[_runs(label[j])]  # the likeliest of each component, which then counts as joined
                    label[np.isin(label, label[j])] = label[i]
                    a.append(np.full(len(j), t.node[i]))
                    b.append(t.node[j])
            if more:
                yield pa.RecordBatch.from_arrays([pa.array([t.sig], pa.int64()), pa.nulls(1, pa.int64())], ["a", "b"])
            if a:
                x, y = np.concatenate(a), np.concatenate(b)
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], ["a", "b"])

    return _tiled(m, facts.select("node", "size", F.col("short").alias("data")), F.ceil(F.col("n") / TILE)).mapInArrow(run, "a long, b long").distinct()


def _undecided(members: DataFrame, facts: DataFrame, roots: DataFrame, num: int, den: int) -> DataFrame:
    """(sig, node, root, size) of the members that have somebody of another component in their bucket whom the sketches don't
    rule out."""
    m = _open(members, roots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _tiles(batches):
            both, mark = Sketches(t.data.to_pylist(), t.size, num, den), np.zeros(len(t.node), bool)
            for i, j in t.others():
                j = j[t.root[j] != t.root[i]]
                if len(j):
                    j = j[both.may(i, j)[0]]
                    mark[j] = True
                    mark[i] |= len(j) > 0
            if mark.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(mark.sum()), t.sig)), *(pa.array(x[mark]) for x in (t.node, t.root, t.size))], ["sig", "node", "root", "size"])

    return written(_tiled(m, facts.select("node", "size", F.col("sketch").alias("data")), F.ceil(F.col("n") / TILE)).mapInArrow(run, "sig long, node long, root long, size long").distinct(), "near-undecided")


def joining(t: Tile, num: int, den: int) -> list[tuple[int, int]]:
    """Links (a, b) that join all components of a tile that similar sets join; data: the sets."""
    sets = [np.frombuffer(x, "<u8") for x in t.data.to_pylist()]
    feature = np.unique(np.concatenate(sets), return_inverse=True)[1]
    member = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    cuts = np.cumsum([0, *(len(x) for x in sets)])
    order = np.argsort(feature, kind="stable")
    held = member[order]  # by feature
    count = np.bincount(feature)
    start = np.cumsum(count) - count
    label, out = t.root.copy(), []
    for i, j in t.others():
        j = j[label[j] != label[i]]
        if not len(j):
            continue
        f = feature[cuts[i] : cuts[i + 1]]
        at = np.repeat(start[f] - (np.cumsum(count[f]) - count[f]), count[f])
        both = np.bincount(held[at + np.arange(len(at))], minlength=len(sets))[j]
        j = j[den * both >= num * (t.size[i] + t.size[j] - both)]
        if len(j):
            j = j[np.unique(label[j], return_index=True)[1]]
            label[np.isin(label, label[j])] = label[i]
            out += [(max(int(t.node[i]), int(x)), min(int(t.node[i]), int(x))) for x in t.node[j]]
    return out


def _rest(undecided: DataFrame, docs: DataFrame, facts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The links (a, b) that join the components of undecided members, found among their whole sets."""
    texts = _texts_of(docs, facts, undecided.select("node").distinct())

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            for a in range(0, b.num_rows, GROUP):
                data = [shingles(hashes.of(x), words).astype("<u8").tobytes() for x in _texts(b.column(1).slice(a, GROUP))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, GROUP), pa.array(data, pa.binary())], ["node", "data"])
        hashes.clear()
        release()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _tiles(batches):
            if found := joining(t, num, den):
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])
        release()

    whole_ = written(texts.mapInArrow(sets, "node long, data binary"), "near-sets")
    many = undecided.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("features"))
    m = undecided.join(many, "sig")
    parts = F.ceil(F.greatest(F.col("n") / TILE, F.col("features") / FEATURES))
    return written(_tiled(m.drop("size"), whole_.join(undecided.select("node", "size").distinct(), "node"), parts).mapInArrow(run, "a long, b long").distinct(), "near-joining")


def join(docs: DataFrame, words: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, node, component_id, root, print) per row; node names equal sets, root components, print texts.

    Null or empty texts have no shingles and are linked with nothing (component_id is their doc_id). Rows repeating a doc_id
    are documents of their own with that id; a null doc_id never names a component unless all its ids are null. Extra
    columns are ignored. No link is lost: see above.
    """
    rows = _emit(docs, words, num, den)
    n = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    got = written(_gather(rows.repartition(n, "key").sortWithinPartitions("key", "node")), "near-rows")
    documents = written(got.filter("kind = 0").select(F.col("b").alias("node"), *_numbers()), "near-docs")
    facts = _facts(got, n)
    stars = written(got.filter("kind = 1").select("a", "b").distinct(), "near-stars")
    links = _verified(_possible(stars, facts, num, den), docs, facts, words, num, den)
    roots = components(links)
    members = written(got.filter("kind = 2 AND extra IS NULL").select(F.col("a").alias("sig"), F.col("b").alias("node")).distinct(), "near-members")
    left = written(_likely(members, facts, roots, num, den), "near-likely")
    more = written(left.filter("b IS NOT NULL").join(stars, ["a", "b"], "left_anti"), "near-more")
    if not more.isEmpty():
        links = links.unionByName(_verified(_possible(more, facts, num, den), docs, facts, words, num, den))
        roots = components(links)
    members = members.join(left.filter("b IS NULL").select(F.col("a").alias("sig")), "sig", "left_semi")
    undecided = _undecided(members, facts, roots, num, den)
    if not undecided.isEmpty():
        links = links.unionByName(_rest(undecided, docs, facts, words, num, den))
        roots = components(links)
    linked = small_join(documents.filter("size > 0").select("node", "doc_id", "size", "print"), roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = written(linked.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "near-names")
    out = small_join(linked, names, "root", "left").select("doc_id", F.col("size").alias("n_shingles"), "node", F.coalesce("component_id", "doc_id").alias("component_id"), "root", "print")
    return out.unionByName(documents.filter("size = 0").select("doc_id", F.col("size").alias("n_shingles"), "node", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("root"), "print"))


def representatives(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of which one stays per component (the smallest doc_id, null last), with all their columns. Rows without
    shingles stay. Rows that repeat a doc_id and its text share their fate."""
    key = F.struct(F.col("doc_id").isNull().alias("z"), F.coalesce("doc_id", F.lit(0)).alias("i"), "print")
    j = join(docs, words, num, den).filter("n_shingles > 0").select("root", key.alias("k"))
    first = written(j.groupBy("root").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "near-first")
    gone = written(small_join(j, first, "root").filter("k <> first").select("k").distinct(), "near-gone")
    d = whole(docs, "doc_id", "text").select("_all", "doc_id", _print()).select("_all", key.alias("k"))
    return small_join(d, gone, "k", "left_anti", rows=200_000).select("_all.*")
