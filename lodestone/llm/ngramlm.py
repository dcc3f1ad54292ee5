"""Language-model scores from Elias-Fano n-gram tries.

Texts are cut into chunks of a few megabytes.  A chunk sends each trie shard its
distinct words that live there, with the distinct words that follow each, and how
often training texts hold them.  A shard adds these up, builds a trie of two
levels and answers every chunk from it; the chunk then scores its texts.  So a
shard meets a word once per chunk and not once per text, and no model passes
through the driver or is held whole by a task.

A shard's trie: level 1 holds context words, level 2 their followers.  Keys, running
sums of counts and the monotone pointers from level 1 to level 2 are Elias-Fano coded,
a follower's key relative to its context; smoothed probabilities are quantised to 8
bits and back-off weights to 16.  The levels lie in mapped memory and are read as they
are coded; a look-up is a successor search inside the range that the context's
pointers tell.

p(w | v) = max(c(v w) - D, 0) / c(v) + b(v) p(w), with b(v) what the discounts D
leave, and p(w) = (c(w) + 1) / (N + V + 1), which keeps 1 / (N + V + 1) for unseen
words.  Contexts never seen fall back to p(w).

The followers of frequent contexts are dealt to several shards by follower; which
contexts are frequent comes from a sample and only places work: back-off weights
add up over the shards, so scores are those of a whole model.
"""

from __future__ import annotations

import io
import mmap
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import stored
from lodestone.llm.textops import NON_SPACE, blocks, mix64, words_of

CHUNK_BYTES = 6 << 20
END = np.uint64(0x656E64_5F656E64)
BEGIN = np.uint64(0x626567_696E5F5F)
#: Training tokens that a shard is meant to answer for.
SHARD_TOKENS = 1 << 20
#: One text in so many tells how many tokens there are and which words are frequent.
SAMPLE = 16
#: How many shards the followers of a frequent context are dealt to.
SPREAD = 16
FOLLOWER_BITS = 40
DISCOUNTS = np.array([0.0, 0.75, 1.1, 1.4])
_CODE_STEPS = 28.0
_BACKOFF_STEPS = 8192.0
_UNSEEN = 65535


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays, byte plane by byte plane, compressed."""
    out, packer = io.BytesIO(), zstandard.ZstdCompressor(level=1)
    for a in arrays:
        a = np.ascontiguousarray(a)
        data = packer.compress(a.view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"")
        out.write(np.array([len(a), len(data)], dtype=np.int64).tobytes() + a.dtype.str.encode().ljust(4) + data)
    return out.getvalue()


def _unpack(data: bytes) -> list[np.ndarray]:
    out, at, unpacker = [], 0, zstandard.ZstdDecompressor()
    while at < len(data):
        n, size = np.frombuffer(data, dtype=np.int64, count=2, offset=at)
        kind = np.dtype(data[at + 16 : at + 20].strip().decode())
        raw = unpacker.decompress(data[at + 20 : at + 20 + size])
        planes = np.frombuffer(raw, dtype=np.uint8).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind) if n else np.zeros(0, dtype=kind))
        at += 20 + int(size)
    return out


class EliasFano:
    """A sorted sequence of integers: low parts of so many bits one after the other, high parts in unary.

    Both are read where they lie.  Beside them lies how many ones there are before each
    512 bits of the high parts, from which select finds the k-th one or zero.
    """

    BLOCK = 512

    def __init__(self, head: np.ndarray, low: np.ndarray, high: np.ndarray, ones: np.ndarray) -> None:
        self.n, self.width, self.top = (int(x) for x in head)
        self.low, self.high, self.ones = low, high, ones
        self.mask = np.uint64((1 << self.width) - 1)

    @staticmethod
    def parts(values: np.ndarray, universe: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What the constructor takes, all of 64-bit integers: size, width and highest high part; low; high; ones."""
        n, values = len(values), values.astype("<u8")
        width = min(63, max(0, (universe // max(1, n)).bit_length() - 1))
        packed = []
        for a in range(0, n if width else 0, 1 << 16):  # a multiple of 8 values, so of whole bytes
            bits = np.unpackbits(values[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :width]
            packed.append(np.packbits(bits.ravel(), bitorder="little"))
        low = np.concatenate([*packed, np.zeros(16, dtype=np.uint8)])
        high = (values >> np.uint64(width)).astype(np.int64)
        top = int(high[-1]) if n else 0
        bits = np.zeros(-(-(n + top + 1) // EliasFano.BLOCK) * EliasFano.BLOCK, dtype=np.uint8)
        bits[high + np.arange(n)] = 1
        coded = np.packbits(bits, bitorder="little").view("<u8")
        blocks_ = np.bitwise_count(coded).reshape(-1, EliasFano.BLOCK // 64).sum(axis=1, dtype=np.uint64)
        return np.array([n, width, top], dtype=np.uint64), low[: len(low) // 8 * 8].view("<u8"), coded, np.concatenate([[0], np.cumsum(blocks_)]).astype(np.uint64)

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Where the k-th one, or zero, of the high parts stands, from 0."""
        out = np.empty(len(k), dtype=np.int64)
        before = self.ones.astype(np.int64) if one else np.arange(len(self.ones)) * self.BLOCK - self.ones.astype(np.int64)
        for a in range(0, len(k), 1 << 15):
            own = k[a : a + (1 << 15)]
            block = np.searchsorted(before[1:], own, side="right")
            left = own - before[block]
            words = self.high[block[:, None] * 8 + np.arange(8)]
            words = words if one else ~words
            word, left = _nth(words, left)
            byte, left = _nth(np.ascontiguousarray(words[np.arange(len(own)), word]).view(np.uint8).reshape(-1, 8), left)
            last = np.ascontiguousarray(words[np.arange(len(own)), word]).view(np.uint8).reshape(-1, 8)[np.arange(len(own)), byte]
            out[a : a + len(own)] = block * self.BLOCK + word * 64 + byte * 8 + _BIT_OF[last, left]
        return out

    def _low_at(self, at: np.ndarray) -> np.ndarray:
        bit = at.astype(np.uint64) * np.uint64(self.width)
        word, off = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        upper = (self.low[word + 1] << np.uint64(1)) << (np.uint64(63) - off)
        return ((self.low[word] >> off) | upper) & self.mask

    def at(self, places: np.ndarray) -> np.ndarray:
        """The values that stand at places."""
        return ((self._select(places, True) - places).astype(np.uint64) << np.uint64(self.width)) | self._low_at(places)

    def values(self) -> np.ndarray:
        return self.at(np.arange(self.n))

    def find(self, wanted: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """Where each value stands, -1 if it isn't there, or not from lo to before hi: a successor search among equal high parts."""
        high = (wanted >> np.uint64(self.width)).astype(np.int64)
        known = np.flatnonzero((wanted >> np.uint64(self.width) <= np.uint64(self.top)) & ((hi > lo) if hi is not None else True)) if self.n else np.zeros(0, dtype=np.int64)
        out = np.full(len(wanted), -1)
        h, low = high[known], wanted[known] & self.mask
        end = self._select(h, False) - h
        begin = np.zeros(len(h), dtype=np.int64)
        begin[h > 0] = self._select(h[h > 0] - 1, False) - (h[h > 0] - 1)
        if hi is not None:
            begin, end = np.maximum(begin, lo[known]), np.minimum(end, hi[known])
        a, b = begin, np.maximum(begin, end)
        while len(open_ := np.flatnonzero(a < b)):
            mid = (a[open_] + b[open_]) >> 1
            less = self._low_at(mid) < low[open_]
            a[open_], b[open_] = np.where(less, mid + 1, a[open_]), np.where(less, b[open_], mid)
        found = a < end
        found[found] = self._low_at(a[found]) == low[found]
        out[known[found]] = a[found]
        return out


#: Where the k-th one of a byte stands.
_BIT_OF = np.zeros((256, 8), dtype=np.int64)
for _byte in range(256):
    _ones = [i for i in range(8) if _byte >> i & 1]
    _BIT_OF[_byte, : len(_ones)] = _ones


def _nth(rows: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In each row of integers, which one holds the row's k-th one bit, and which of its own bits that is."""
    until = np.cumsum(np.bitwise_count(rows), axis=1, dtype=np.int64)
    at = (until <= k[:, None]).sum(axis=1)
    return at, k - np.where(at > 0, until[np.arange(len(k)), np.maximum(at, 1) - 1], 0)


class Trie:
    """One shard's model, over memory-mapped levels."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, context: np.ndarray, follower: np.ndarray, seen: np.ndarray) -> None:
        """From context words with their counts, and followers (ordered by context, then key) with theirs."""
        pointers = np.searchsorted(context, np.arange(len(words) + 1)).astype(np.uint64)
        sums = np.concatenate([[0], np.cumsum(counts)]).astype(np.uint64)
        discount = DISCOUNTS[np.minimum(seen, 3)]
        share = (seen - discount) / np.maximum(counts[context], 1)
        code = np.clip(1 + np.ceil(-np.log10(np.maximum(share, 1e-300)) * _CODE_STEPS - 1e-9), 1, 255).astype(np.uint8)
        left = np.bincount(context, weights=discount, minlength=len(words)) / np.maximum(counts, 1)
        backoff = np.where(left > 0, np.clip(1 + np.rint(-np.log10(np.maximum(left, 1e-300)) * _BACKOFF_STEPS), 1, _UNSEEN - 1), 0)
        backoff = np.where(counts > 0, backoff, _UNSEEN).astype(np.uint16)
        keys = (context.astype(np.uint64) << np.uint64(FOLLOWER_BITS)) | follower
        levels = (
            *EliasFano.parts(words, 1 << 64), *EliasFano.parts(pointers, int(pointers[-1]) + 1), *EliasFano.parts(sums, int(sums[-1]) + 1),
            *EliasFano.parts(keys, max(1, len(words)) << FOLLOWER_BITS), backoff, code,
        )
        mapped = mmap.mmap(-1, sum(a.nbytes for a in levels) + 1)  # anonymous: no folder of the machine is used
        for a in levels:
            mapped.write(a.tobytes())
        views, at = [], 0
        for a in levels:
            views.append(np.frombuffer(mapped, dtype=a.dtype, count=a.size, offset=at))
            at += a.nbytes
        self.words, self.pointers, self.sums, self.keys = (EliasFano(*views[4 * i : 4 * i + 4]) for i in range(4))
        self.backoff, self.code = views[16:]

    def answer(self, words: np.ndarray, children: np.ndarray, followers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts and back-off codes of words, and the probability codes of each one's children followers (0: unseen)."""
        at = self.words.find(words)
        held = np.maximum(at, 0)
        known = at >= 0
        counts, backoff = np.zeros(len(at), dtype=np.int64), np.full(len(at), _UNSEEN, dtype=np.uint16)
        lo, hi = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        if known.any():
            own = at[known]
            counts[known] = (self.sums.at(own + 1) - self.sums.at(own)).astype(np.int64)
            backoff[known] = self.backoff[own]
            lo[known], hi[known] = self.pointers.at(own).astype(np.int64), self.pointers.at(own + 1).astype(np.int64)
        keys = (np.repeat(held, children).astype(np.uint64) << np.uint64(FOLLOWER_BITS)) | followers
        place = self.keys.find(keys, np.repeat(lo, children), np.repeat(hi, children))
        code = np.zeros(len(place), dtype=np.uint8)
        code[place >= 0] = self.code[place[place >= 0]]
        return counts, backoff, code


class Layout(NamedTuple):
    """Which shards hold what."""

    shards: int
    frequent: np.ndarray

    def homes(self, words: np.ndarray) -> np.ndarray:
        return (mix64(words + np.uint64(0x51)) % np.uint64(self.shards)).astype(np.int64)

    def plan(self, home: np.ndarray, spread: np.ndarray, is_frequent: np.ndarray, context: np.ndarray, follower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries (word, shard), ordered by shard then word, and each pair's shard; frequent words have an entry in each of their shards."""
        word = np.concatenate([np.arange(len(home)), np.repeat(np.flatnonzero(is_frequent), SPREAD - 1)])
        shard = np.concatenate([home, (np.repeat(home[is_frequent], SPREAD - 1) + np.tile(np.arange(1, SPREAD), int(is_frequent.sum()))) % self.shards])
        entry = np.unique(shard * len(home) + word)
        return entry % len(home), entry // len(home), (home[context] + np.where(is_frequent[context], spread[follower], 0)) % self.shards


def _layout(docs: DataFrame, least: int, given: int | None) -> Layout:
    """Shards for the tokens of docs, at least `least` or as many as given, and the words that make up more than a quarter of a shard's fair share."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in blocks(batches, limit=4 << 20):
            words, n = np.unique(words_of([(t or b"").lower() for t in texts], NON_SPACE).hash, return_counts=True)
            often = n >= max(2, n.sum() >> 16)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(words[often], 0).view(np.int64)), pa.array(np.append(n[often], n.sum()))], ["word", "n"])

    sample = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    counts = sample.mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    total = counts.filter("word = 0").agg(F.sum("n")).first()[0] or 0
    shards = given or max(least, -(-total * SAMPLE // SHARD_TOKENS))
    found = counts.filter((F.col("word") != 0) & (F.col("n") >= max(2, total / (4 * shards)))).collect()  # 4 * shards rows at most
    return Layout(shards, np.sort(np.array([r.word for r in found] + [BEGIN.astype(np.int64)], dtype=np.int64).view(np.uint64)))


def _chunk_rows(chunk: int, ids: list, trains: np.ndarray, texts: list[bytes], layout: Layout) -> Iterator[tuple[int, int, bytes]]:
    """(chunk, shard, payload): the chunk's token stream with shard -1, then its words and followers for each shard."""
    words = words_of([t.lower() for t in texts], NON_SPACE)
    sizes = np.diff(words.lo)
    text = np.repeat(np.arange(len(texts)), sizes + 1)
    last = np.cumsum(sizes + 1) - 1
    current = np.empty(len(text), dtype=np.uint64)
    is_end = np.zeros(len(text), dtype=bool)
    is_end[last] = True
    current[~is_end], current[is_end] = words.hash, END
    distinct, token = np.unique(np.append(current, BEGIN), return_inverse=True)
    begin, token = token[-1], token[:-1].astype(np.uint32)
    learns = trains[text]
    count = np.bincount(token[learns], minlength=len(distinct))
    count[begin] = trains.sum()
    home, spread = layout.homes(distinct), (mix64(distinct + np.uint64(0x77)) % np.uint64(SPREAD)).astype(np.uint8)
    frequent = np.isin(distinct, layout.frequent)
    ids_known = np.array([i is not None for i in ids])
    yield chunk, -1, _pack(
        np.array([i or 0 for i in ids], dtype=np.int64), ids_known.view(np.uint8), trains.view(np.uint8), (sizes + 1).astype(np.int64), token,
        home.astype(np.uint32), spread, frequent.view(np.uint8), np.array([begin], dtype=np.int64),
    )
    context, follower, of_token = pairs_of(token, sizes + 1, begin, len(distinct))
    seen = np.bincount(of_token[learns], minlength=len(context))
    entry_word, entry_shard, pair_shard = layout.plan(home, spread, frequent, context, follower)
    order = np.argsort(pair_shard, kind="stable")
    shards = np.arange(layout.shards + 1)
    entry_at, pair_at = np.searchsorted(entry_shard, shards), np.searchsorted(pair_shard[order], shards)
    keys = mix64(distinct + np.uint64(0x33)) >> np.uint64(64 - FOLLOWER_BITS)
    for s in np.unique(entry_shard).tolist():
        own = entry_word[entry_at[s] : entry_at[s + 1]]
        pairs = order[pair_at[s] : pair_at[s + 1]]
        children = np.diff(np.searchsorted(context[pairs], np.append(own, len(distinct))))
        key = keys[follower[pairs]].astype("<u8").view(np.uint8).reshape(-1, 8)[:, : FOLLOWER_BITS // 8]
        yield chunk, s, _pack(distinct[own], count[own].astype(np.uint32), children.astype(np.uint32), np.ascontiguousarray(key).reshape(-1), seen[pairs].astype(np.uint32))


def pairs_of(token: np.ndarray, sizes: np.ndarray, begin: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (context, follower) in order, and each token's among them."""
    before = np.empty(len(token), dtype=np.int64)
    before[1:] = token[:-1]
    before[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = begin
    pair, of_token = np.unique(before * n + token, return_inverse=True)
    return pair // n, pair % n, of_token


def _answers(shard: int, rows: list[tuple[int, bytes]], layout: Layout) -> Iterator[tuple[int, int, bytes, int, int]]:
    """(chunk, shard, payload, tokens, words) for each chunk's questions; totals on the first."""
    asked = [_unpack(r[1]) for r in rows]
    followers = []
    for a in asked:
        key = np.zeros((len(a[4]), 8), dtype=np.uint8)
        key[:, : FOLLOWER_BITS // 8] = a[3].reshape(-1, FOLLOWER_BITS // 8)
        followers.append(key.reshape(-1).view("<u8"))
    words, at = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
    counts = np.bincount(at, weights=np.concatenate([a[1] for a in asked]), minlength=len(words)).astype(np.int64)
    context = np.repeat(at, np.concatenate([a[2] for a in asked]))
    seen = np.concatenate([a[4] for a in asked])
    learned = seen > 0
    pair, of = np.unique((context[learned].astype(np.uint64) << np.uint64(FOLLOWER_BITS)) | np.concatenate(followers)[learned], return_inverse=True)
    total = np.bincount(of, weights=seen[learned], minlength=len(pair)).astype(np.int64)
    trie = Trie(words, counts, (pair >> np.uint64(FOLLOWER_BITS)).astype(np.int64), pair & np.uint64((1 << FOLLOWER_BITS) - 1), total)
    own = (layout.homes(words) == shard) & (words != BEGIN) & (counts > 0)
    sums = int(counts[own].sum()), int(own.sum())
    for i, (row, a) in enumerate(zip(rows, asked, strict=True)):
        c, b, code = trie.answer(a[0], a[2], followers[i])
        yield row[0], shard, _pack(c, b, code), *(sums if i == 0 else (0, 0))


def _scores(stream: list[np.ndarray], answers: list[tuple[int, bytes]], layout: Layout, tokens: int, words: int) -> tuple[np.ndarray, ...]:
    """n_tokens, n_known, base_score, score by text of a chunk."""
    _, _, _, sizes, token, home, spread, frequent, begin = stream
    home, frequent = home.astype(np.int64), frequent.view(bool)
    context, follower, of_token = pairs_of(token, sizes, int(begin[0]), len(home))
    entry_word, entry_shard, pair_shard = layout.plan(home, spread.astype(np.int64), frequent, context, follower)
    order = np.argsort(pair_shard, kind="stable")
    count = np.zeros(len(home), dtype=np.int64)
    back, unseen = np.zeros(len(home)), np.zeros(len(home), dtype=bool)
    code = np.zeros(len(context), dtype=np.uint8)
    shards = np.arange(layout.shards + 1)
    entry_at, pair_at = np.searchsorted(entry_shard, shards), np.searchsorted(pair_shard[order], shards)
    for shard, payload in answers:
        c, b, k = _unpack(payload)
        own = entry_word[entry_at[shard] : entry_at[shard + 1]]
        count[own] = c
        unseen[own] |= b == _UNSEEN
        back[own] += np.where((b > 0) & (b < _UNSEEN), 10.0 ** ((1.0 - b) / _BACKOFF_STEPS), 0.0)
        code[order[pair_at[shard] : pair_at[shard + 1]]] = k
    back = np.where(unseen, 1.0, np.minimum(back, 1.0))
    single = (count + 1) / (tokens + words + 1)
    share = np.where(code > 0, 10.0 ** ((1.0 - code) / _CODE_STEPS), 0.0)
    log = np.log10(share + back[context] * single[follower])[of_token]
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return sizes, np.add.reduceat((count > 0)[token].astype(np.int64), at), np.add.reduceat(np.log10(single)[token], at), np.add.reduceat(log, at)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def language_model_scores(docs: DataFrame, learns: Column, chunk_bytes: int = CHUNK_BYTES, shards: int | None = None) -> DataFrame:
    """Scores every text of docs by a model learned from the rows where `learns` holds.

    Tokens are the words `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased, then one
    end; a null or empty text is the end alone.  Order 2 (a word and the one before).

    Returns a row per row of docs: doc_id, learned, n_tokens, n_known (tokens that
    training texts hold), train_tokens, base_score (log10 by p(w) alone) and score
    (log10 by the model).  Rows that repeat a doc_id, or have none, each count and
    are each returned.  A null `learns` is false.  Without training texts every
    score is 0.  Other columns are not read.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(learns, F.lit(False)).alias("learns"))
    layout = _layout(base, 2 * partitions, shards)
    partitions = max(partitions, layout.shards // 4)
    shared = spark.sparkContext.broadcast(layout)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout, chunk = shared.value, TaskContext.get().partitionId() << 32
        ids, trains, texts, size = [], [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            rows = []
            for row in _chunk_rows(chunk, ids, np.array(trains, dtype=bool), texts, layout):
                rows.append(row)
                if len(rows) == 512:
                    yield _batch(rows, ["chunk", "shard", "payload"], [pa.int64(), pa.int32(), pa.binary()])
                    rows = []
            if rows:
                yield _batch(rows, ["chunk", "shard", "payload"], [pa.int64(), pa.int32(), pa.binary()])

        for batch, values in blocks(batches):
            ids += batch.column("doc_id").to_pylist()
            trains += batch.column("learns").to_pylist()
            texts += [v or b"" for v in values]
            size += sum(map(len, texts[-len(values) :]))
            if size >= chunk_bytes:
                yield from out()
                chunk, ids, trains, texts, size = chunk + 1, [], [], [], 0
        if texts:
            yield from out()

    asked = stored(base.mapInArrow(ask, "chunk bigint, shard int, payload binary"), "chunks")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["chunk", "shard", "payload", "tokens", "words"], [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
        now, rows = None, []
        for batch in batches:
            for chunk, shard, payload in zip(*(batch.column(c).to_pylist() for c in ("chunk", "shard", "payload")), strict=True):
                if shard != now:
                    if rows:
                        yield _batch(list(_answers(now, rows, shared.value)), names, types)
                    now, rows = shard, []
                rows.append((chunk, payload))
        if rows:
            yield _batch(list(_answers(now, rows, shared.value)), names, types)

    questions = asked.filter("shard >= 0").repartition(partitions, "shard").sortWithinPartitions("shard", "chunk")
    answered = stored(questions.mapInArrow(answer, "chunk bigint, shard int, payload binary, tokens bigint, words bigint"), "answers")
    totals = answered.agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).first()
    tokens, words = totals.tokens or 0, totals.words or 0

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            n, known, single, model = _scores(stream, answers, shared.value, tokens, words)
            ids = pa.array(stream[0], mask=~stream[1].view(bool))
            return pa.RecordBatch.from_arrays(
                [ids, pa.array(stream[2].view(bool)), pa.array(n), pa.array(known), pa.array(np.full(len(n), tokens)), pa.array(single), pa.array(model)],
                ["doc_id", "learned", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

        stream, answers = None, []
        for batch in batches:
            for shard, payload in zip(batch.column("shard").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                if shard < 0:
                    if stream is not None:
                        yield out()
                    stream, answers = _unpack(payload), []
                else:
                    answers.append((shard, payload))
        if stream is not None:
            yield out()

    together = asked.filter("shard < 0").union(answered.select("chunk", "shard", "payload"))
    return together.repartition(partitions, "chunk").sortWithinPartitions("chunk", "shard").mapInArrow(score, "doc_id bigint, learned boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
