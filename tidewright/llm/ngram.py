"""Language-model scores from an Elias-Fano n-gram trie.

The model is an interpolated bigram model: P(w | v) = (c(v w) + mu * P1(w)) / (c(v) + mu), with P1 the smoothed unigram
probability; it sums to one up to the quantisation, because c(v) is the sum of c(v w). Its trie is spread over shards: words by
their hash, n-grams by the hash of the n-gram, so a frequent word fills no shard. A word's place in its shard and the shard give
it a number, and n-grams are of these numbers, so only the 64-bit hashes of words can collide.

The words' level of a shard has their hashes, their counts as running sums, and the quantised logarithm of their smoothed
probability. The n-grams' levels have the contexts with the quantised logarithm of their back-off weight mu / (c(v) + mu), monotone
pointers into the successors, and the successors, made monotone by their context's place, with the quantised logarithm of their
share c(v w) / (c(v) + mu): a block knows its words' P1 and their contexts' counts and interpolates itself, so P1 is not sent
again with each n-gram, and shares, of which a context has few different ones, go back in few bytes. Monotone sequences are
Elias-Fano coded in 64-bit words; a shard's levels lie in one memory map and are never decoded: a query is a successor search for
the context and, in its range, for the word, by select and rank in the packed words.

Corpus blocks ask and shards answer: a block sends a shard its own distinct words, then n-grams, with their training counts;
the shard adds up all blocks' counts, builds its levels and answers every block in the order in which it asked, which the block
finds again from its tokens. Texts are tokenised once; the tokens lie in one file a block in the shared folder and are never
shuffled. A block sends nothing to a shard of which it has nothing, so no more rows are sent than n-grams. No vocabulary or model
is collected or broadcast, and what is gathered grows with the corpus.
"""

from __future__ import annotations

import mmap
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import remember, shared_dir, written
from tidewright.llm.shingles import WordHashes, mix
from tidewright.llm.worker import release

#: Tokens of a block, about; training and other tokens of a shard, about; weight of the unigram model.
BLOCK, SHARD, MU = 1_000_000, 4_000_000, 300.0
#: Steps of a code in one power of ten; the code of what isn't there; parts of a step in which interpolated scores are summed, as
#: whole numbers, so that their order doesn't matter.
STEPS, NONE, FINE = 2048, 65535, 1 << 16
END = np.uint64(0x454E44)  # never the hash of a word but by a chance of 2^-64
#: Numbers that no word has: the start of a text, a word that is not in the training texts.
START, UNKNOWN, FIRST = 0, 1, 2


def code(probability: np.ndarray) -> np.ndarray:
    """The quantised logarithm of probabilities down to 10^-31."""
    return np.clip(np.rint(np.log10(probability) * -STEPS), 0, NONE - 1).astype("<u2")


def value(codes: np.ndarray) -> np.ndarray:
    """The logarithms to base 10 of codes or of sums of codes."""
    return codes.astype(np.float64) / -STEPS


def squeezed(x: np.ndarray, kind: str) -> bytes:
    """Numbers compressed byte by byte: first the low bytes of all, and so on."""
    raw = np.ascontiguousarray(x.astype(kind)).view(np.uint8).reshape(len(x), np.dtype(kind).itemsize)
    return zstandard.compress(np.ascontiguousarray(raw.T).tobytes(), 3)


def spread(data: bytes, kind: str) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(wide, -1).T).view(kind).reshape(-1)


class EliasFano:
    """A monotone sequence of 64-bit numbers, queried where it lies: low bits packed, high bits in unary, and the number of
    ones before each 64-bit word of these."""

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        n = len(values)
        top = int(values[-1]) if n else 0
        low = min(63, max(0, ((top + 1) // n).bit_length() - 1)) if n else 0
        high = (values >> np.uint64(low)).astype(np.int64)
        packed = np.zeros(n * low // 64 + 2, np.uint64)
        if low and n:
            bit = np.arange(n, dtype=np.int64) * low
            word, shift = bit >> 6, (bit & 63).astype(np.uint64)
            rest = values & np.uint64((1 << low) - 1)
            for w, part in ((word, rest << shift), (word + 1, np.where(shift > 0, rest >> (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0)))):
                starts = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
                packed[w[starts]] |= np.bitwise_or.reduceat(part, starts)
        at = high + np.arange(n)
        unary = np.zeros(((int(high[-1]) if n else 0) + n) // 64 + 1, np.uint64)
        if n:
            starts = np.flatnonzero(np.append(True, at[1:] >> 6 != at[:-1] >> 6))
            unary[at[starts] >> 6] = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), starts)
        before = np.cumsum(np.bitwise_count(unary), dtype=np.int64) - np.bitwise_count(unary)
        ones = before.astype("<u4") if n < 1 << 32 else before.astype("<i8")
        head = np.array([n, low, len(packed), len(unary), ones.itemsize], "<i8").tobytes()
        return head + packed.astype("<u8").tobytes() + unary.astype("<u8").tobytes() + ones.tobytes() + bytes(-ones.nbytes % 8)

    def __init__(self, data: np.ndarray, at: int = 0):
        """Views of the bytes from ``at``; ``end``: where they end."""
        self.n, self.low, a, b, wide = (int(x) for x in data[at : at + 40].view("<i8"))
        at += 40
        self.packed, self.unary = data[at : at + 8 * a].view("<u8"), data[at + 8 * a : at + 8 * (a + b)].view("<u8")
        at += 8 * (a + b)
        self.ones = data[at : at + wide * b].view("<u4" if wide == 4 else "<i8")
        self.end = at + wide * b + -(wide * b) % 8
        self.zeros = np.arange(b, dtype=np.int64) * 64 - self.ones  # before each word: one number for 64 bits

    def _in_word(self, word: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The place of the k-th one, from 0, of each word."""
        word, k, place = word.copy(), k.astype(np.int64), np.zeros(len(k), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count(word & np.uint64((1 << width) - 1)).astype(np.int64)
            right = k >= count
            k -= np.where(right, count, 0)
            place += np.where(right, width, 0)
            word = np.where(right, word >> np.uint64(width), word)
        return place

    def _select(self, before: np.ndarray, k: np.ndarray, flip: bool) -> np.ndarray:
        w = np.searchsorted(before, k, side="right") - 1
        word = self.unary[w]
        return w * 64 + self._in_word(~word if flip else word, k - before[w])

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.uint64)
        bit = i.astype(np.int64) * self.low
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        over = self.packed[word + 1] << (np.uint64(63) - shift) << np.uint64(1)
        return ((self.packed[word] >> shift) | over) & np.uint64((1 << self.low) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        high = self._select(self.ones, i, False) - i
        return (high.astype(np.uint64) << np.uint64(self.low)) | self.lows(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of values below x, whether the next value is x) of each x."""
        x = np.asarray(x, np.uint64)
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        top = int(self.get(np.array([self.n - 1]))[0])
        inside = x <= np.uint64(top)
        h = (np.minimum(x, np.uint64(top)) >> np.uint64(self.low)).astype(np.int64)
        bits = np.where(inside, x, np.uint64(0)) & np.uint64((1 << self.low) - 1)
        begin = np.where(h > 0, self._select(self.zeros, np.maximum(h - 1, 0), True) - np.maximum(h - 1, 0), 0)
        # the last bucket ends with the sequence; before it there are zeros enough
        last = h >= top >> self.low
        end = np.where(last, self.n, self._select(self.zeros, np.where(last, 0, h), True) - h)
        low, high = begin, end.copy()
        while (wide := low < high).any():
            mid = (low + high) >> 1
            less = wide & (self.lows(np.minimum(mid, self.n - 1)) < bits)
            low, high = np.where(less, mid + 1, low), np.where(wide & ~less, mid, high)
        found = inside & (low < end) & (self.lows(np.minimum(low, self.n - 1)) == bits)
        return np.where(inside, low, self.n), found


def mapped(data: bytes) -> np.ndarray:
    """The bytes in an anonymous memory map: outside the interpreter's heap, given back when nothing views it."""
    m = mmap.mmap(-1, max(1, len(data)))
    m.write(data)
    return np.frombuffer(m, np.uint8, len(data))


class Words:
    """The words' level: hashes, counts as running sums, codes of the smoothed probability but for the level's normaliser."""

    @staticmethod
    def build(hashes: np.ndarray, counts: np.ndarray, tokens: int) -> bytes:
        """hashes: sorted, distinct; tokens: of all shards. The normaliser is (tokens + 0.5 * (kinds + 1)) / tokens."""
        total = np.concatenate([[0], np.cumsum(counts)]).astype(np.uint64)
        return EliasFano.encode(hashes) + EliasFano.encode(total) + code((counts + 0.5) / max(tokens, 1)).tobytes()

    def __init__(self, data: np.ndarray):
        self.hashes = EliasFano(data)
        self.total = EliasFano(data, self.hashes.end)
        self.codes = data[self.total.end :].view("<u2")

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place or -1, count, code) of each word."""
        at, there = self.hashes.successor(hashes)
        place = np.where(there, at, -1)
        count, codes = np.zeros(len(at), np.int64), np.full(len(at), NONE, "<u2")
        if there.any():
            at = at[there]
            count[there] = (self.total.get(at + 1) - self.total.get(at)).astype(np.int64)
            codes[there] = self.codes[at]
        return place, count, codes


class Trie:
    """The n-grams' levels: contexts, their back-off codes, pointers, successors, their codes."""

    @staticmethod
    def build(contexts: np.ndarray, words: np.ndarray, back: np.ndarray, codes: np.ndarray) -> bytes:
        """The n-grams (context, word) sorted, distinct; ``back`` and ``codes`` of each n-gram."""
        names, starts = np.unique(contexts, return_index=True)
        place = np.repeat(np.arange(len(names), dtype=np.uint64), np.diff(np.append(starts, len(contexts))))
        wide = int(words.max(initial=0)).bit_length()
        if wide + len(names).bit_length() > 64:
            raise ValueError("too many n-grams in one shard")
        levels = [EliasFano.encode(x.astype(np.uint64)) for x in (names, np.append(starts, len(contexts)), (place << np.uint64(wide)) | words.astype(np.uint64))]
        return np.array([wide], "<i8").tobytes() + b"".join(levels) + back[starts].astype("<u2").tobytes() + codes.astype("<u2").tobytes()

    def __init__(self, data: np.ndarray):
        self.wide = int(data[:8].view("<i8")[0])
        self.contexts = EliasFano(data, 8)
        self.pointers = EliasFano(data, self.contexts.end)
        self.words = EliasFano(data, self.pointers.end)
        codes = data[self.words.end :].view("<u2")
        self.back, self.codes = codes[: self.contexts.n], codes[self.contexts.n :]

    def find(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The code of each n-gram, NONE if it isn't there."""
        out = np.full(len(words), NONE, "<u2")
        names, of = np.unique(contexts, return_inverse=True)
        c, there = self.contexts.successor(names.astype(np.uint64))
        some = np.flatnonzero(there[of] & (words < 1 << self.wide))
        if not len(some):
            return out
        begin, end = (self.pointers.get(np.minimum(c, self.contexts.n - 1) + k).astype(np.int64)[of[some]] for k in (0, 1))
        at, found = self.words.successor((c[of[some]].astype(np.uint64) << np.uint64(self.wide)) | words[some].astype(np.uint64))
        found &= (begin <= at) & (at < end)
        out[some[found]] = self.codes[at[found]]
        return out


def _packed(arrays: list[tuple[np.ndarray, str]]) -> bytes:
    parts = [squeezed(x, kind) for x, kind in arrays]
    return np.array([len(parts), *map(len, parts)], "<i8").tobytes() + b"".join(parts)


def _unpacked(data: bytes, kinds: list[str]) -> list[np.ndarray]:
    sizes = np.frombuffer(data, "<i8", len(kinds) + 1)[1:]
    at = np.cumsum([8 * (len(kinds) + 1), *sizes])
    return [spread(data[a:z], kind) for a, z, kind in zip(at[:-1], at[1:], kinds, strict=True)]


#: A block's payload: ids, known ids, training flags, sizes, tokens as numbers of its words, shards of its words.
PAYLOAD = ["<i8", "u1", "u1", "<i8", "<u4", "<u4"]
#: What a shard tells of words: numbers, counts, codes. What a block asks of n-grams: of each context, by ascending numbers, the step
#: from the one before, its n-grams and its count; of each n-gram the word's number and the training count.
TOLD, ASKED = ["<i8", "<i8", "<u2"], ["<i8", "<i8", "<i8", "<i8", "<i8"]


def _shard(x: np.ndarray, n: int) -> np.ndarray:
    return (mix(x) % np.uint64(n)).astype(np.int64)


def _blocks(docs: DataFrame, shards: int, folder: str) -> DataFrame:
    """(block, words, counts, path, trained, starts): the documents of a task in blocks, tokenised, the end of each the last of
    its tokens; words by falling frequency, with their training counts; the payload is a file in the folder. Files that a lost or
    repeated task left are in no row."""

    def closed(name: int, ids: list, train: list[bool], docs: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(d) + 1 for d in docs], np.int64)
        tokens = np.full(int(sizes.sum()), END, np.uint64)
        body = np.ones(len(tokens), bool)
        body[np.cumsum(sizes) - 1] = False
        tokens[body] = np.concatenate(docs)
        words, token, n = np.unique(tokens, return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        words, token = words[order], place[token]
        seen = np.repeat(np.array(train), sizes)
        counts = np.bincount(token[seen], minlength=len(words))
        payload = [np.array([i or 0 for i in ids]), np.array([i is not None for i in ids]), np.array(train), sizes, token, _shard(words, shards)]
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base)
        path = f"{base}/{name}-{uuid.uuid4().hex[:8]}"
        with store.open_output_stream(path, compression=None) as f:
            f.write(_packed([*zip(payload, PAYLOAD, strict=True)]))
        cols = [([name], pa.int64()), ([words.astype("<u8").tobytes()], pa.binary()), ([squeezed(counts, "<u4")], pa.binary()), ([path], pa.string()), ([int(seen.sum())], pa.int64()), ([sum(train)], pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in cols], ["block", "words", "counts", "path", "trained", "starts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, task, n = WordHashes(), TaskContext.get().partitionId(), 0
        ids, train, docs, size = [], [], [], 0
        for b in batches:
            for doc_id, held, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                ids.append(doc_id)
                train.append(held != 1)
                docs.append(hashes.of((text.as_py() or "").encode("utf-8", "surrogatepass")))
                size += len(docs[-1]) + 1
                if size >= BLOCK:
                    yield closed(task << 24 | n, ids, train, docs)
                    ids, train, docs, size, n = [], [], [], 0, n + 1
        if ids:
            yield closed(task << 24 | n, ids, train, docs)
        hashes.clear()
        release()

    return docs.mapInArrow(run, "block long, words binary, counts binary, path string, trained long, starts long")


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places) of the shards that occur, in ascending order."""
    order = np.argsort(shard, kind="stable")
    found, starts = np.unique(shard[order], return_index=True)
    for s, a, z in zip(found.tolist(), starts, [*starts[1:], len(order)], strict=False):  # none if there are none
        yield s, order[a:z]


class Block:
    """A block with what the shards told of its words: its distinct n-grams, and the n-gram of each token."""

    def __init__(self, payload: bytes, told: dict[int, bytes], shards: int, starts: int, normal: float, offset: int, mu: float):
        """told: by shard. normal: the denominator of the unigram model; offset: the words' level's normaliser in steps."""
        self.ids, self.known, self.train, self.sizes, token, shard = _unpacked(payload, PAYLOAD)
        number, count, codes = np.empty(len(shard), np.int64), np.empty(len(shard), np.int64), np.empty(len(shard), "<u2")
        for s, at in _by_shard(shard):
            number[at], count[at], codes[at] = _unpacked(told[s], TOLD)
        unseen = int(code(np.array([0.5 / normal]))[0])
        one = np.where(codes == NONE, unseen, np.minimum(codes.astype(np.int64) + offset, NONE - 1))
        self.begin = np.append(0, np.cumsum(self.sizes)[:-1])
        token = token.astype(np.int64)
        self.count = count[token]
        before = np.empty(len(token), np.int64)
        before[1:] = token[:-1] + 1
        before[self.begin] = 0  # the start; others are one more than their word's number in the block
        pair, self.which = np.unique(before * len(shard) + token, return_inverse=True)
        first, second = pair // len(shard), pair % len(shard)
        self.context, self.word = np.append(START, number)[first], number[second]
        self.total, self.one = np.append(starts, count)[first], one[second]
        self.shards, self.mu = shards, mu

    def questions(self) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, n-grams) of the n-grams whose words are both known, by ascending numbers."""
        at = np.flatnonzero((self.context != UNKNOWN) & (self.word != UNKNOWN))
        at = at[np.lexsort((self.word[at], self.context[at]))]
        spot = _shard(self.context[at].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + self.word[at].view(np.uint64), self.shards)
        for s, some in _by_shard(spot):
            yield s, at[some]

    def asked(self) -> list[tuple[int, bytes]]:
        seen = np.bincount(self.which, np.repeat(self.train, self.sizes), len(self.context)).astype(np.int64)
        out = []
        for s, p in self.questions():
            first = np.flatnonzero(np.diff(self.context[p], prepend=-1))
            each = np.diff(self.context[p][first], prepend=0), np.diff(np.append(first, len(p))), self.total[p][first], self.word[p], seen[p]
            out.append((s, _packed([*zip(each, ASKED, strict=True)])))
        return out

    def scored(self, answers: dict[int, bytes], tokens: int, normal: float) -> pd.DataFrame:
        share = np.zeros(len(self.word))
        for s, p in self.questions():
            got = spread(answers[s], "<u2")
            share[p] = np.where(got == NONE, 0, 10 ** value(got))
        joint = np.log10(share + self.mu / (self.total + self.mu) * 10 ** value(self.one))
        steps = np.rint(joint * (-STEPS * FINE)).astype(np.int64)
        ids = pd.array(self.ids, dtype="Int64")
        ids[self.known == 0] = pd.NA
        add = lambda x: np.add.reduceat(x, self.begin)
        return pd.DataFrame({"doc_id": ids, "held_out": self.train == 0, "n_tokens": self.sizes, "n_known": add((self.count > 0).astype(np.int64)), "train_tokens": np.full(len(ids), tokens), "base_score": add(np.log10((self.count + 0.5) / normal)), "score": value(add(steps[self.which])) / FINE})


def scores(docs: DataFrame, fold: int = 5, held: int = 1, mu: float = MU) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Trained on the rows whose crc32(doc_id as text) mod ``fold`` is not ``held``. Null text is empty and has one token, its
    end; a null doc_id counts as ''; repeated rows are trained on and scored each; other columns are ignored; a table without
    rows has no scores. Without training rows every probability is the unigram model's of nothing.
    """
    spark = docs.sparkSession
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % fold
    rows = docs.select("doc_id", F.when(crc == held, 1).otherwise(0).alias("held"), "text")
    size = int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6  # tokens, about
    n = max(1, -(-size // SHARD), min(spark.sparkContext.defaultParallelism, size // 100_000))
    folder = remember(f"{shared_dir(spark)}/ngram-payload-{uuid.uuid4().hex}")
    blocks = written(_blocks(rows, n, folder), "ngram-blocks")
    tokens, starts = (int(x or 0) for x in blocks.agg(F.sum("trained"), F.sum("starts")).first())

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, words, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words, counts = np.frombuffer(words, "<u8"), spread(counts, "<u4")
                for s, at in _by_shard(_shard(words, n)):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([s], pa.int32()), pa.array([words[at].tobytes()], pa.binary()), pa.array([squeezed(counts[at], "<u4")], pa.binary())], ["block", "shard", "words", "counts"])

    def tell_words(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        asked = [np.frombuffer(x, "<u8") for x in pdf["words"]]
        names, where = np.unique(np.concatenate(asked), return_inverse=True)
        counts = np.bincount(where, np.concatenate([spread(x, "<u4") for x in pdf["counts"]]), len(names)).astype(np.int64)
        level, told = Words(mapped(Words.build(names[counts > 0], counts[counts > 0], tokens))), []
        for x in asked:
            place, count, codes = level.find(x)
            told.append(_packed([*zip((np.where(place < 0, UNKNOWN, FIRST + place * n + shard), count, codes), TOLD, strict=True)]))
        kinds = pd.DataFrame({"block": [-1], "shard": [shard], "data": [None], "kinds": [int((counts > 0).sum())]})
        return pd.concat([pd.DataFrame({"block": pdf["block"], "shard": pdf["shard"], "data": told, "kinds": 0}), kinds], ignore_index=True)

    asked = blocks.select("block", "words", "counts").mapInArrow(ask_words, "block long, shard int, words binary, counts binary")
    told = written(asked.groupBy("shard").applyInPandas(tell_words, "block long, shard int, data binary, kinds long"), "ngram-words")
    kinds = int(told.filter("block = -1").agg(F.sum("kinds")).first()[0] or 0)
    normal = tokens + 0.5 * (kinds + 1)
    offset = int(np.rint(np.log10(normal / max(tokens, 1)) * STEPS))

    def block_of(pdf: pd.DataFrame) -> Block:
        by = {k: dict(zip(x["shard"], x["data"], strict=True)) for k, x in pdf.groupby("kind")}
        with fs.FileSystem.from_uri(folder)[0].open_input_stream(by[0][-1].decode(), compression=None) as f:
            payload = f.readall()
        return Block(payload, by[1], n, starts, normal, offset, mu)

    def ask_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        out = block_of(pdf).asked()
        return pd.DataFrame({"block": int(pdf["block"].iloc[0]), "shard": [s for s, _ in out], "data": [x for _, x in out]})

    def tell_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = [_unpacked(x, ASKED) for x in pdf["data"]]
        asked = [(np.repeat(np.cumsum(x[0]), x[1]), x[3], x[4], np.repeat(x[2], x[1])) for x in asked]
        context, word, seen, total = (np.concatenate([x[i] for x in asked]) for i in range(4))
        order = np.lexsort((word, context))
        cut = np.flatnonzero(np.append(True, (context[order][1:] != context[order][:-1]) | (word[order][1:] != word[order][:-1])))
        joint = np.add.reduceat(seen[order], cut)
        some, joint = order[cut[joint > 0]], joint[joint > 0]
        trie = Trie(mapped(Trie.build(context[some], word[some], code(mu / (total[some] + mu)), code(joint / (total[some] + mu)))))
        return pd.DataFrame({"block": pdf["block"], "shard": pdf["shard"], "data": [squeezed(trie.find(x[0], x[1]), "<u2") for x in asked]})

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        answers = pdf[pdf["kind"] == 2]
        return block_of(pdf).scored(dict(zip(answers["shard"], answers["data"], strict=True)), tokens, normal)

    kind = lambda df, k: df.select("block", F.lit(k).alias("kind"), "shard", "data")
    known = kind(blocks.select("block", F.lit(-1).alias("shard"), F.col("path").cast("binary").alias("data")), 0).unionByName(kind(told.filter("block >= 0"), 1))
    pairs = known.groupBy("block").applyInPandas(ask_pairs, "block long, shard int, data binary")
    answered = written(pairs.groupBy("shard").applyInPandas(tell_pairs, "block long, shard int, data binary"), "ngram-answers")
    return known.unionByName(kind(answered, 2)).groupBy("block").applyInPandas(judge, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
