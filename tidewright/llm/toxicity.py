"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are words and word beginnings (insults are inflected). All terms of a bounded sample of labelled documents are indexed,
weighted by their document frequency over the whole corpus and by how much more often toxic examples hold them; no term,
example or document is left out. The index is inverted and cut into blocks of similar examples: where many examples of a block
hold a term, their weights are a row of the block's matrix, elsewhere postings. Postings are added first; a block's product is
skipped where the block's greatest weights, with the postings' best sum in it, cannot reach the cosines already found. Neighbours
vote with weights that fall with distance; the share of votes is calibrated by isotonic regression on the examples themselves,
each left out of its own vote. One task makes the index, a file in the shared folder; workers map it and hold no copy.
"""

from __future__ import annotations

import math
import pickle
import shutil
import tempfile
import uuid
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyarrow import fs
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from tidewright.llm.common import remember, shared_dir, whole, written
from tidewright.llm.worker import claim, release

#: Labelled rows that the classifier is fitted on, at most (those of the smallest hashes); everything else covers all rows.
SAMPLE = 8000
#: The weight of a term is its idf times log2(2 + toxic examples / other examples) to this power: 1 or more for every term.
RELEVANCE = 2
NEIGHBOURS, THRESHOLD = 15, 0.7
#: Queries, characters of texts, and rows, at once; characters whose words are looked up together, and rows that come back together.
QUERIES, CHUNK, ROWS = 128, 3_000_000, 1024
WIDE, SLICE = 10 * CHUNK, 8 * ROWS
#: Blocks of examples, frequent terms by which they are told apart, rounds of that; a term is a column of a block's matrix where
#: its shares of the block's and of all examples multiply to more than DENSE; more than single precision can be off.
BLOCKS, APART, ROUNDS, DENSE, SLACK = 16, 512, 6, 0.003, 2e-5
#: Bytes to which arrays in the stored classifier are aligned.
ALIGN = 64
#: Lengths of the word beginnings used beside the word.
HEADS = (4, 5, 6)
_TRIM = ".,;:!?\"'()[]{}<>«»“”„…*_-–—"


def terms_of(word: str) -> list[str]:
    """A word and its beginnings; a beginning is marked by a trailing '*'."""
    w = word.strip(_TRIM)
    return [w, *(w[:n] + "*" for n in HEADS if len(w) >= n)] if w else []


class Terms:
    """Ids of the terms of words, and counts of the terms of texts. Words are looked up as Arrow columns, each distinct one of many
    texts once, as every lookup hashes the whole vocabulary anew; nothing is kept between lookups."""

    def __init__(self, vocabulary: pa.Array):
        """vocabulary: terms in the order of their ids."""
        star, size = (f.to_numpy(zero_copy_only=False) for f in (pc.ends_with(vocabulary, "*"), pc.utf8_length(vocabulary)))
        self.sets = []
        for n in (*HEADS, 0):
            own = np.flatnonzero(star & (size == n + 1) if n else ~star)
            values = vocabulary.take(pa.array(own))
            self.sets.append((n, pc.utf8_slice_codeunits(values, 0, n) if n else values, np.append(own, -1).astype(np.int32)))
        self.place = np.zeros(len(vocabulary), np.int32)

    @staticmethod
    def vocabulary(words: pa.Array) -> pa.Array:
        """All terms of distinct words, in order."""
        w = pc.unique(pc.utf8_trim(words, characters=_TRIM))
        w = w.filter(pc.greater(pc.utf8_length(w), 0))
        size = pc.utf8_length(w)
        heads = [pc.binary_join_element_wise(pc.unique(pc.utf8_slice_codeunits(w.filter(pc.greater_equal(size, n)), 0, n)), "*", "") for n in HEADS]
        terms = pa.concat_arrays([w, *heads])
        return terms.take(pc.sort_indices(terms))

    def lookup(self, words: pa.Array) -> np.ndarray:
        """(words, beginnings and the word): ids of the terms, -1 for none."""
        w = pc.utf8_trim(words, characters=_TRIM)
        size = pc.utf8_length(w)
        out = np.empty((len(words), len(self.sets)), np.int32)
        for i, (n, values, ids) in enumerate(self.sets):
            if n:
                found = pc.index_in(pc.if_else(pc.greater_equal(size, n), pc.utf8_slice_codeunits(w, 0, n), None), value_set=values)
            else:
                found = pc.index_in(w, value_set=values)
            out[:, i] = ids[found.fill_null(-1).to_numpy(zero_copy_only=False)]
        return out

    def of(self, ids: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(terms, occurrences) from the rows of lookup() for a text's words, in no order; ``times``: how often each word counts."""
        there = ids >= 0
        n = None if times is None else np.broadcast_to(times[:, None], ids.shape)[there]
        ids = ids[there]
        at = np.arange(len(ids), dtype=np.int32)
        self.place[ids] = at  # the last occurrence stands for all
        last = self.place[ids]
        keep = np.flatnonzero(last == at)
        return ids[keep], np.bincount(last, n, len(ids))[keep].astype(np.int32)

    def count(self, parts: Iterable[list[str]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(terms, occurrences) of each text. Texts are split a part at a time; only numbers and distinct words are held of it until
        the words of WIDE characters are looked up."""
        held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        size = 0
        for texts in parts:
            words = pc.utf8_split_whitespace(pa.array([t.lower() for t in texts], pa.large_string()))
            flat = pc.dictionary_encode(words.values)
            held.append((words.offsets.to_numpy(), flat.indices.to_numpy(), flat.dictionary))
            size += sum(map(len, texts))
            del words, flat
            if size >= WIDE:
                yield from self._counted(held)
                held, size = [], 0
        if held:
            yield from self._counted(held)

    def _counted(self, held: list[tuple[np.ndarray, np.ndarray, pa.Array]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """From parts of texts: where each text's words begin, all words' numbers, and the part's distinct words by number."""
        flat = pc.dictionary_encode(pa.concat_arrays([d for _, _, d in held]))
        table, rows, at = self.lookup(flat.dictionary.cast(pa.string())), flat.indices.to_numpy(), 0
        blank = pc.equal(flat.dictionary, "").to_numpy(zero_copy_only=False)  # the ends of a text that begins or ends with space
        table[blank] = -1
        for cuts, numbers, distinct in held:
            own = rows[at : at + len(distinct)]
            at += len(distinct)
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                yield self.of(table[own[numbers[a:z]]])


class Vocabulary:
    """The sample's terms, and a worker's lookup of them, which outlives its tasks."""

    def __init__(self, terms: pa.Array):
        self.list: pa.Array | None = terms
        self._terms: Terms | None = None

    @property
    def terms(self) -> Terms:
        claim("toxicity")
        if self._terms is None:
            self._terms = Terms(self.list)
            self.list = None
        return self._terms


def chunks(column: Iterable) -> Iterator[list[str]]:
    """The texts in lists of about CHUNK characters; null is empty."""
    out: list[str] = []
    size = 0
    for x in column:
        out.append(x.as_py() or "")
        size += len(out[-1])
        if size >= CHUNK:
            yield out
            out, size = [], 0
    if out:
        yield out


def bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def sample(labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(doc_id, toxic) of at most ``most`` training rows. Repeated ids: toxic if any row says so. Null ids or labels go."""
    rows = labels.select("doc_id", "toxic").filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(bucket(F.col("doc_id"), 3) != 1)
    rows = rows.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    return written(rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "toxic-sample")


class BlockMaxIndex:
    """Exact top-k by cosine over sparse vectors. A vector's weight of a term is (1 + log n) * weight / length for n occurrences of
    the term; occurrences are what is stored, so that an entry takes few bytes."""

    def __init__(self, term: np.ndarray, count: np.ndarray, sizes: np.ndarray, weights: np.ndarray):
        """Vectors one after another, in the order of ids: terms and occurrences, and how many terms each has (one at least).
        weights: of all terms."""
        self.n, terms, self.weights = len(sizes), len(weights), weights
        n, starts = self.n, np.cumsum(sizes) - sizes
        self.logs = 1 + np.log(np.maximum(np.arange(int(count.max(initial=0)) + 1), 1), dtype=float)
        length = np.array([np.sqrt(np.sum((self.logs[count[a : a + k]] * weights[term[a : a + k]]) ** 2)) for a, k in zip(starts, sizes, strict=True)])
        block = self.blocks(term, count, starts, sizes, length)
        self.order = np.argsort(block, kind="stable")  # place -> number of the vector
        self.where = np.empty(n, np.int64)
        self.where[self.order] = np.arange(n)
        block, self.length = block[self.order], length[self.order]
        self.cuts = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if n else np.zeros(0, np.int64)
        self.ends = np.append(self.cuts[1:], n)[: len(self.cuts)]
        share = np.bincount(term, minlength=terms) / max(n, 1)
        small = np.uint16 if n < 1 << 16 else np.int32
        columns, self.matrices, self.most, exact, rest = [], [], [], [], []
        for a, z in zip(self.cuts, self.ends, strict=True):  # one block's entries at a time
            own = self.order[a:z]
            k = sizes[own]
            at = np.repeat(starts[own] - (np.cumsum(k) - k), k) + np.arange(k.sum())
            t, c, d = term[at], count[at], np.repeat(np.arange(z - a), k)
            held = np.bincount(t, minlength=terms)
            mine = (held > 1) & (held * share > DENSE * (z - a))
            columns.append(np.flatnonzero(mine).astype(np.int32))
            often = mine[t]
            place = np.cumsum(mine) - 1
            m = np.zeros((len(columns[-1]), z - a), np.float32)
            m[place[t[often]], d[often]] = self.logs[c[often]] * weights[t[often]] / self.length[a + d[often]]
            self.matrices.append(m)
            self.most.append(m.max(1, initial=0))
            exact.append((np.bincount(d[often], minlength=z - a), t[often], c[often]))
            rest.append((t[~often], (a + d[~often]).astype(small), c[~often]))
        used = np.unique(np.concatenate([np.zeros(0, np.int32), *columns]))
        self.place, self.used = np.full(terms, -1, np.int32), used
        self.place[used] = np.arange(len(used))
        self.columns = [self.place[c] for c in columns]
        both = lambda parts, i, kind: np.concatenate([np.zeros(0, kind), *(x[i] for x in parts)])
        self.exact = np.append(0, np.cumsum(both(exact, 0, np.int64))).tolist(), self.place[both(exact, 1, np.int32)].astype(np.uint16 if len(used) < 1 << 16 else np.int32), both(exact, 2, count.dtype)  # the matrices' entries by vector
        del exact
        t = both(rest, 0, np.int32)
        self.sizes = np.bincount(t, minlength=terms)
        self.starts = np.cumsum(self.sizes) - self.sizes
        by = np.argsort(t, kind="stable")
        del t
        self.docs, self.counts = both(rest, 1, small)[by], both(rest, 2, count.dtype)[by]

    def blocks(self, term: np.ndarray, count: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Each vector's block: those whose frequent terms are most alike, by a few rounds of spherical k-means."""
        n, k = self.n, min(BLOCKS, self.n)
        often = np.argsort(-np.bincount(term, minlength=len(self.weights)), kind="stable")[:APART]
        at = np.full(len(self.weights), -1, np.int64)
        at[often] = np.arange(len(often))
        x = np.zeros((n, len(often)), np.float32)
        for i, (a, z) in enumerate(zip(starts, starts + sizes, strict=True)):
            some = np.flatnonzero(at[term[a:z]] >= 0)
            t = term[a:z][some]
            x[i, at[t]] = self.logs[count[a:z][some]] * self.weights[t] / length[i]
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        centre, label = x[:: max(1, n // max(1, k))][:k], np.zeros(n, np.int64)
        for _ in range(ROUNDS if n else 0):
            label = (x @ centre.T).argmax(1)
            centre = np.stack([x[label == j].sum(0) for j in range(k)])
            centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)
        return label

    @classmethod
    def of(cls, vectors: list[dict[int, int]], weights: np.ndarray) -> BlockMaxIndex:
        """vectors: occurrences by term."""
        term, count = (np.concatenate([np.zeros(0, np.int32), *(np.fromiter(v, np.int32, len(v)) for v in x)]) for x in (vectors, [v.values() for v in vectors]))
        return cls(term, count, np.array([len(v) for v in vectors], np.int64), weights)

    @staticmethod
    def pair(v) -> tuple[np.ndarray, np.ndarray]:
        return (np.array(list(v), np.int64), np.array(list(v.values()), float)) if isinstance(v, dict) else v

    def nearest(self, query, k: int, without: int = -1) -> list[tuple[float, int]]:
        """(cosine, id) of the k best with a cosine above 0, best first; of equal ones the smaller ids. A query is a unit vector,
        {term: weight} or (terms, weights)."""
        return self.nearest_of([query], k, [without])[0]

    def nearest_of(self, queries: list, k: int, without: list[int]) -> list[list[tuple[float, int]]]:
        pairs = [self.pair(q) for q in queries]
        if not self.n:
            return [[] for _ in pairs]
        often, rest = np.zeros((len(pairs), len(self.used))), np.empty((len(pairs), self.n))
        for i, (t, w) in enumerate(pairs):
            at = self.place[t]
            often[i, at[at >= 0]] = w[at >= 0]
            size = self.sizes[t]
            held = np.flatnonzero(size)
            t, w, size = t[held], w[held], size[held]
            at = np.repeat(self.starts[t] - (np.cumsum(size) - size), size)
            at += np.arange(len(at))
            sums = self.logs.take(self.counts.take(at, mode="clip"), mode="clip")
            sums *= np.repeat(w * self.weights[t], size)
            rest[i] = np.bincount(self.docs.take(at, mode="clip"), sums, self.n)
        rest /= self.length
        scores, single = rest.astype(np.float32), often.astype(np.float32)
        bound = np.maximum.reduceat(scores, self.cuts, axis=1) + np.stack([single[:, c] @ m for c, m in zip(self.columns, self.most, strict=True)], 1)
        first, least = bound.argmax(1), np.zeros(len(pairs), np.float32)
        for more in (False, True):
            for b, (a, z) in enumerate(zip(self.cuts, self.ends, strict=True)):
                todo = np.flatnonzero((first != b) & (bound[:, b] >= least - SLACK) if more else first == b)
                if len(todo):
                    scores[todo, a:z] += single[np.ix_(todo, self.columns[b])] @ self.matrices[b]
                    if not more and z - a > k + 1:  # one more than k, as its own may go
                        least[todo] = np.partition(scores[todo, a:z], z - a - k - 1, axis=1)[:, z - a - k - 1]
                if more:  # none of the k best is here
                    scores[np.flatnonzero((first != b) & (bound[:, b] < least - SLACK)), a:z] = 0
        for i, x in enumerate(without):
            if x >= 0:
                scores[i, self.where[x]] = 0
        cuts, columns, counts = self.exact
        often *= self.weights[self.used]  # the matrices' weights, but for logs and lengths
        out = []
        for i, (s, low) in enumerate(zip(scores, least, strict=True)):
            hit = np.flatnonzero(s >= max(low - SLACK, 1e-30))  # the k best are among them
            if len(hit) > 4 * k:
                hit = hit[s[hit] >= np.partition(s[hit], len(hit) - k)[len(hit) - k] - SLACK]
            mine, value = often[i], rest[i, hit]
            for x, j in enumerate(hit.tolist()):
                own = slice(cuts[j], cuts[j + 1])
                value[x] += mine.take(columns[own], mode="clip") @ self.logs.take(counts[own], mode="clip") / self.length[j]
            value = np.round(value, 12)
            number = self.order[hit]
            top = np.lexsort((number, -value))[:k]
            out.append(list(zip(value[top].tolist(), number[top].tolist(), strict=True)))
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (upper ends, values). A pool's rate is drawn to the rate of all by the weight of one example;
    where that would put it below the pool before it, it takes that one's."""
    u, at = np.unique(x, return_inverse=True)  # equal votes are one observation
    pools: list[list[float]] = []  # sum, count, upper end
    for total, count, end in zip(np.bincount(at, y), np.bincount(at), u, strict=True):
        pools.append([float(total), float(count), float(end)])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, c, e = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + c, e]
    return np.array([p[2] for p in pools]), np.maximum.accumulate([(p[0] + y.mean()) / (p[1] + 1) for p in pools])


class Neighbours:
    """The classifier but for its calibration: index and labels. examples: (doc_id, label, terms, occurrences)."""

    def __init__(self, idf: np.ndarray, ids: list[int], labels: list[int], sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray):
        """Examples: ids, labels, how many terms each has; all their terms and occurrences one after another."""
        y = np.repeat(np.array(labels, bool), sizes)
        pos, neg = (np.bincount(terms[y == v], minlength=len(idf)) for v in (True, False))
        self.weights = idf * np.log2(2 + pos / np.maximum(1, neg)) ** RELEVANCE
        blank = [v for v, n in zip(labels, sizes, strict=True) if not n]  # no words at all
        self.ids, self.labels = ([v for v, n in zip(x, sizes, strict=True) if n] for x in (ids, labels))
        self.cuts = np.append(0, np.cumsum(sizes[sizes > 0]))
        self.held = [terms, counts.astype(np.min_scalar_type(int(counts.max(initial=0))))]
        self.prior = (sum(labels) + 1) / (len(labels) + 2)
        self.blank = min((sum(blank) + self.prior) / (len(blank) + 1), self.prior)
        self._index: BlockMaxIndex | None = None

    @property
    def index(self) -> BlockMaxIndex:
        """Made where it is first used, in the task that stores the classifier; the driver never needs it."""
        if self._index is None:
            release()
            self._index = BlockMaxIndex(*self.held, np.diff(self.cuts), self.weights)
            release()
        return self._index

    def store(self, folder: str) -> str:
        """Writes classifier and index as a file of the folder, arrays behind the rest, each from a multiple of ALIGN on; its path."""
        arrays: list[pickle.PickleBuffer] = []
        assert self.index
        parts = [pickle.dumps(self, protocol=5, buffer_callback=arrays.append), *(a.raw() for a in arrays)]
        sizes = np.array([len(parts), *map(len, parts)], "<i8").tobytes()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = uuid.uuid4().hex  # a task that runs twice writes two files
        with store.open_output_stream(f"{base}/{name}", compression=None) as f:
            for x in (sizes, *parts):
                f.write(x)
                f.write(bytes(-len(x) % ALIGN))
        return f"{folder}/{name}"

    @staticmethod
    def stored(path: str) -> Neighbours:
        """What store() wrote; its arrays are views of the mapped file, or of a copy if its store is not a local one."""
        store, name = fs.FileSystem.from_uri(path)
        if isinstance(store, fs.LocalFileSystem):
            data = np.memmap(name, np.uint8, "r")
        else:
            with tempfile.TemporaryFile() as f:
                with store.open_input_stream(name, compression=None) as source:
                    shutil.copyfileobj(source, f, 1 << 20)
                f.flush()
                data = np.memmap(f, np.uint8, "r")
        n = int(data[:8].view("<i8")[0])
        sizes = data[8 : 8 * (n + 1)].view("<i8")
        ends = np.cumsum(-(-np.append(8 * (n + 1), sizes) // ALIGN) * ALIGN)
        head, *arrays = (data[a : a + k] for a, k in zip(ends.tolist(), sizes.tolist(), strict=False))
        return pickle.loads(head, buffers=arrays)

    def example(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return self.vector(*(h[self.cuts[i] : self.cuts[i + 1]] for h in self.held))

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts, dtype=float)) * self.weights[terms]
        return terms, w / math.sqrt(w @ w) if len(w) else w

    def votes(self, vectors: list, without: list[int]) -> list[tuple[float, list[int]]]:
        out = []
        for near in self.index.nearest_of(vectors, NEIGHBOURS, without):
            weight = [1 / (1.05 - s) for s, _ in near]
            total = sum(w * self.labels[i] for w, (_, i) in zip(weight, near, strict=True))
            out.append(((total + self.prior) / (sum(weight) + 1), [self.ids[i] for _, i in near]))
        return out

    def left_out(self, numbers: list[int]) -> list[float]:
        """The votes on these examples, each left out of its own."""
        return [v for v, _ in self.votes([self.example(i) for i in numbers], numbers)]

    def score(self, queries: list[tuple[np.ndarray, np.ndarray]], ends: np.ndarray, values: np.ndarray) -> list[tuple[float, list[int]]]:
        """(probability, ids of the examples that voted) of each (terms, occurrences), none of them empty."""
        out = []
        for raw, near in self.votes([self.vector(*q) for q in queries], [-1] * len(queries)):
            at = min(int(np.searchsorted(ends, raw)), len(values) - 1)
            p = 0.98 * float(values[at]) + 0.02 * raw  # keeps the order of raw votes within a pool
            out.append((min(1.0, max(0.0, p)), near))
        return out


#: The classifier that this worker has mapped, by its path.
_mapped: dict[str, Neighbours] = {}


def mapped(path: str) -> Neighbours:
    claim("toxicity", _mapped)
    if path not in _mapped:
        _mapped.clear()
        _mapped[path] = Neighbours.stored(path)
    return _mapped[path]


Fitted = tuple[Broadcast, str, np.ndarray, np.ndarray]


def fit(documents: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Fitted:
    """Examples and all their terms from the sample, document frequencies from all documents: (vocabulary, path of the
    classifier, calibration). Of rows that repeat a labelled doc_id the one with the least text is the example."""
    spark = documents.sparkSession
    rows = sample(labels, most)
    texts = documents.select("doc_id", "text").join(F.broadcast(rows), "doc_id")  # at most ``most`` rows are broadcast
    texts = texts.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("text").alias("text"))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        for b in batches:
            for d, y, text in zip(b.column(0), b.column(1), b.column(2), strict=True):
                c = Counter((text.as_py() or "").lower().split())
                names = sorted(c)
                data = ["\n".join(names).encode("utf-8", "surrogatepass"), np.array([c[t] for t in names], "<i4").tobytes()]
                cols = [pa.array([d.as_py()], pa.int64()), pa.array([y.as_py()], pa.int32()), *(pa.array([zlib.compress(x, 1)], pa.binary()) for x in data)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "toxic", "words", "tfs"])

    got = texts.mapInArrow(own, "doc_id long, toxic int, words binary, tfs binary").toArrow().sort_by("doc_id")  # at most ``most`` rows

    def words_of(a: int) -> list[list[str]]:
        return [[w for w in zlib.decompress(x.as_py()).decode("utf-8", "surrogatepass").split("\n") if w] for x in got["words"][a : a + QUERIES]]

    distinct = pa.array([], pa.string())
    for a in range(0, len(got), QUERIES):  # the examples' words are never all unpacked at once
        distinct = pc.unique(pa.concat_arrays([distinct, pa.array([*chain.from_iterable(words_of(a))], pa.string())]))
    vocabulary = Terms.vocabulary(distinct)
    shared, terms, lookup = spark.sparkContext.broadcast(Vocabulary(vocabulary)), len(vocabulary), Terms(vocabulary)  # bounded: the sample's terms
    sizes, held = [], []
    for a in range(0, len(got), QUERIES):
        some = words_of(a)
        flat = pc.dictionary_encode(pa.array([*chain.from_iterable(some)], pa.string()))
        table, rows_, at = lookup.lookup(flat.dictionary), flat.indices.to_numpy(), 0
        for ws, tfs in zip(some, got["tfs"][a : a + QUERIES], strict=True):
            held.append(lookup.of(table[rows_[at : at + len(ws)]], np.frombuffer(zlib.decompress(tfs.as_py()), "<i4")))
            sizes.append(len(held[-1][0]))
            at += len(ws)
    ids, given = got["doc_id"].to_pylist(), got["toxic"].to_pylist()
    found, counts = (np.concatenate([np.zeros(0, np.int32), *(h[i] for h in held)]) for i in (0, 1))
    del got, distinct, lookup, vocabulary, held

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n = shared.value.terms, 0
        seen = np.zeros(terms, np.int64)
        for b in batches:
            n += b.num_rows
            for ids, _ in words.count(chunks(b.column(0))):
                seen[ids] += 1
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, found)), pa.array(np.append(n, seen[found]))], ["term", "df"])

    sums = documents.select("text").mapInArrow(frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # as many rows as terms
    df, term, n = np.zeros(terms), sums["term"].to_numpy(), sums["df"].to_numpy()
    df[term[term >= 0]] = n[term >= 0]
    total = int(n[term < 0].sum())
    model = Neighbours(np.log((total + 1) / (df + 1)) + 1, ids, given, np.array(sizes, np.int64), found, counts)
    unmade, labelled, prior = spark.sparkContext.broadcast(model), np.array(model.labels, float), model.prior  # bounded: the sample's vectors
    del model, sums, found, counts
    release()
    folder = remember(f"{shared_dir(spark)}/toxic-index-{uuid.uuid4().hex}")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([unmade.value.store(folder)])], ["path"])
        release()

    path = spark.range(0, 1, 1, 1).mapInArrow(make, "path string").toArrow()["path"][0].as_py()
    unmade.destroy()

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = mapped(path)
        for b in batches:
            ids = b.column(0).to_pylist()
            for a in range(0, len(ids), QUERIES):
                yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + QUERIES], pa.int64()), pa.array(model.left_out(ids[a : a + QUERIES]), pa.float64())], ["id", "raw"])

    if not len(labelled):
        return shared, path, np.array([1.0]), np.array([prior])
    got = spark.range(0, len(labelled), 1, 8).mapInArrow(votes, "id long, raw double").toArrow()  # at most ``most`` rows
    raw = np.empty(len(labelled))
    raw[got["id"].to_numpy()] = got["raw"].to_numpy()
    return shared, path, *isotonic(raw, labelled)


def scored(docs: DataFrame, fitted: Fitted) -> DataFrame:
    """All columns of ``docs`` and _score, _evidence (ids of the labelled neighbours). The text is the column of that name, or
    that field of the struct _all: it is sent once. Rows come back as they are done, not in the batches that they came in."""
    vocabulary, path, ends, values = fitted
    inside = docs.schema["_all"].dataType.fieldNames().index("text") if docs.columns == ["_all"] else None
    at = docs.columns.index("text") if inside is None else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, model = vocabulary.value.terms, mapped(path)
        known: dict[bytes, tuple[float, list[int]]] = {}

        def score(full: list[tuple[bytes, tuple[np.ndarray, np.ndarray]]]) -> None:
            if full:
                known.update(zip([k for k, _ in full], model.score([q for _, q in full], ends, values), strict=True))

        for batch in batches:
            for a in range(0, batch.num_rows, SLICE):
                b = batch.slice(a, SLICE)
                text = b.column(at) if inside is None else pc.struct_field(b.column(at), [inside])
                if len(known) > 20_000:
                    known.clear()
                keys: list[bytes] = []
                fresh: set[bytes] = set()
                order: list[bytes] = []  # of the texts that are counted

                def new(text=text, keys=keys, fresh=fresh, order=order) -> Iterator[list[str]]:
                    for part in chunks(text):
                        mine = [xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in part]
                        keys.extend(mine)
                        unseen = {k: t for k, t in zip(mine, part, strict=True) if k not in known and k not in fresh}
                        fresh.update(unseen)
                        order.extend(unseen)
                        yield [*unseen.values()]

                full: list[tuple[bytes, tuple[np.ndarray, np.ndarray]]] = []
                for q, k in zip(terms.count(new()), order, strict=True):  # a text's key is there before its terms
                    known[k] = (model.blank, [])
                    if len(q[0]):
                        full.append((k, q))
                    if len(full) == QUERIES:
                        score(full)
                        full = []
                score(full)
                out = [known[k] for k in keys]
                for x in range(0, b.num_rows, ROWS):
                    some = out[x : x + ROWS]
                    cols = [*b.slice(x, ROWS).columns, pa.array([s for s, _ in some], pa.float64()), pa.array([e for _, e in some], pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(cols, [*b.schema.names, "_score", "_evidence"])

    schema = StructType([*docs.schema.fields, StructField("_score", DoubleType()), StructField("_evidence", ArrayType(LongType()))])
    return docs.mapInArrow(run, schema)


def toxicity(documents: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence for every row.

    Text without a term of any example (null, empty) has no neighbours and gets the rate of such examples; without usable labels every row gets the prior 0.5.
    Scores depend on the text alone. Repeated rows are scored each; other columns are ignored.
    """
    s = scored(documents.select("doc_id", "text"), fit(documents, labels, most))
    return s.select("doc_id", (bucket(F.col("doc_id"), 3) == 1).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"), F.col("_evidence").alias("evidence"))


def clean(documents: DataFrame, training: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """The rows that are not predicted toxic, with all their columns."""
    return scored(whole(documents), fit(training, labels, most)).filter(F.col("_score") < THRESHOLD).select("_all.*")
