"""Substring dedup by super-k-mer partitioning.

A window is `window` consecutive words.  Consecutive windows of a document that
share a minimiser (the smallest hash among their runs of `mer` words) form a
super-k-mer.  It travels as one packed string to the minimiser's bucket, so a
word is shipped about three times instead of `window` times, and equal windows
always meet in one bucket.  There, sorting brings equal windows together; all
but the first one in (doc_id, start) order mark the words they cover.

Three words that are the minimiser of very many different windows, in template text
for instance, would make one bucket grow with the corpus.  A sample tells such runs
of words; they count as larger than all others, so their windows go to other
minimisers, and a window of nothing else goes to the bucket of its own hash.  Any
choice of such runs gives the same result, as equal windows still meet.

A map task ships one copy of equal super-k-mers in a chunk and marks the others
at once: a passage that a third of all documents share reaches its bucket once
for each chunk instead of once for each document.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import told_apart
from lodestone.llm.textops import NON_SPACE, blocks, mix64, runs, window_hashes, words_of

#: Text bytes that a map task packs at a time.
CHUNK_BYTES = 4 << 20
#: Super-k-mers that a bucket's task unpacks at a time.
PIECE = 8192
#: Windows that a bucket is meant to hold.
BUCKET_WINDOWS = 1 << 19
#: One text in so many tells how many windows there are and which runs of words are frequent.
SAMPLE = 16
#: Runs of words that are told as frequent at most: a list of 8 MiB, which is broadcast.
FREQUENT = 1 << 20
#: Windows that a bucket's task sorts at a time; a bucket that holds more is read once for each range of their hashes.
SORTED_WINDOWS = 1 << 22
_LAST = np.uint64(1 << 63)
_TO_SPACE = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_OUT = "bucket int, strings binary, ids binary, starts binary, marks binary"


def _sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """The minimum of every size consecutive values."""
    n = len(x) - size + 1
    step = 1
    while step * 2 <= size:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[:n], x[size - step :][:n])


class Deal(NamedTuple):
    """How windows are dealt to buckets."""

    window: int
    mer: int
    buckets: int
    #: Runs of mer words, sorted by hash, that are the minimisers of too many windows.
    frequent: np.ndarray

    def minimisers(self, hashes: np.ndarray) -> np.ndarray:
        """The minimiser of every window of words, or, if all its runs are frequent, a value of its own."""
        if len(hashes) < self.window:
            return np.zeros(0, dtype=np.uint64)
        mers = window_hashes(hashes, self.mer) >> np.uint64(1)
        if not len(self.frequent):
            return _sliding_min(mers, self.window - self.mer + 1)
        mers[np.isin(mers, self.frequent)] |= _LAST
        least = _sliding_min(mers, self.window - self.mer + 1)
        if (alone := least >= _LAST).any():
            least[alone] = window_hashes(hashes, self.window)[alone]
        return least


def _in_one_text(lo: np.ndarray, windows: int, window: int) -> np.ndarray:
    """Which of the windows, by first word, end before their text does."""
    whole = np.zeros(windows, dtype=bool)
    for a, b in zip(lo[:-1].tolist(), lo[1:].tolist(), strict=True):
        if b - a >= window:
            whole[a : b - window + 1] = True
    return whole


def _pack(texts: list[bytes], ids: np.ndarray, deal: Deal) -> Iterator[tuple]:
    """Rows of _OUT for a chunk of texts, which must be in the order of their ids."""
    words = words_of(texts, NON_SPACE)
    window, minimisers = deal.window, deal.minimisers(words.hash)
    if not len(minimisers):
        return
    whole = _in_one_text(words.lo, len(minimisers), window)
    text_of = words.text_of()[: len(minimisers)]
    new = np.concatenate([[True], (minimisers[1:] != minimisers[:-1]) | (text_of[1:] != text_of[:-1]) | (whole[1:] != whole[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(minimisers)]]) - 1
    kept = whole[first]
    first, last = first[kept], last[kept]
    if not len(first):
        return
    data = words.data.translate(_TO_SPACE)
    strings = [data[a:b] for a, b in zip(words.start[first].tolist(), words.end[last + window - 1].tolist(), strict=True)]
    seen: dict[bytes, int] = {}
    origin = np.array([seen.setdefault(s, i) for i, s in enumerate(strings)])
    own = text_of[first]
    start = (first - words.lo[own]).astype(np.int64)
    stop = start + last - first
    doc = ids[own]
    copy = origin != np.arange(len(origin))
    later = copy & ((doc != doc[origin]) | (start != start[origin]))  # a repeated row is not later than itself
    marks = np.stack([doc[later], start[later], stop[later]], axis=1).astype(np.int64) if later.any() else np.zeros((0, 3), dtype=np.int64)
    bucket = (mix64(minimisers[first]) % np.uint64(deal.buckets)).astype(np.int64)
    ships = np.flatnonzero(~copy)
    ships = ships[np.argsort(bucket[ships], kind="stable")]
    begin = runs(bucket[ships])
    packer = zstandard.ZstdCompressor(level=1)
    for i, (a, b) in enumerate(zip(begin, [*begin[1:], len(ships)], strict=True)):
        at = ships[a:b]
        yield int(bucket[at[0]]), packer.compress(b"\n".join(strings[j] for j in at.tolist())), doc[at].tobytes(), start[at].tobytes(), marks.tobytes() if i == 0 else None


def _bucket_marks(rows: list[tuple], window: int) -> list[np.ndarray]:
    """Marks (doc, first start, last start) of one bucket's repeated windows."""
    unpacker = zstandard.ZstdDecompressor()
    strings = [s for row in rows for s in unpacker.decompress(row[0]).split(b"\n")]
    doc = np.concatenate([np.frombuffer(row[1], dtype=np.int64) for row in rows])
    start = np.concatenate([np.frombuffer(row[2], dtype=np.int64) for row in rows])
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    n_windows = sum(max(0, s.count(b" ") + 2 - window) for s in strings)
    ranges = max(1, -(-n_windows // SORTED_WINDOWS))
    return [m for i in range(ranges) for m in _range_marks([strings[k] for k in order.tolist()], doc, start, window, ranges, i)]


def _range_marks(strings: list[bytes], doc: np.ndarray, start: np.ndarray, window: int, ranges: int, at_range: int) -> Iterator[np.ndarray]:
    """Marks of the windows whose hash falls into a range, of strings that are in the order of (doc, start)."""
    parts: list[tuple[np.ndarray, ...]] = []
    for a in range(0, len(strings), PIECE):
        words = words_of(strings[a : a + PIECE], NON_SPACE)
        hashes = window_hashes(words.hash, window)
        inside = _in_one_text(words.lo, len(hashes), window)
        if ranges > 1:
            inside &= hashes % np.uint64(ranges) == at_range
        at = np.flatnonzero(inside)
        own = words.text_of()[at]
        parts.append((own + a, start[own + a] + at - words.lo[own], hashes[at], window_hashes(mix64(words.hash), window)[at]))
    own, begins, whole, second = (np.concatenate(p) for p in zip(*parts, strict=True))
    del parts, words, hashes
    if not len(own):
        return
    by = np.argsort(whole, kind="stable")  # stable: the first of equal windows is the earliest
    if ((whole[by[1:]] == whole[by[:-1]]) & (second[by[1:]] != second[by[:-1]])).any():
        by = np.lexsort((second, whole))
    new = np.concatenate([[True], (whole[by[1:]] != whole[by[:-1]]) | (second[by[1:]] != second[by[:-1]])])
    origin = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
    repeated = (doc[own[by]] != doc[own[origin]]) | (begins[by] != begins[origin])
    hit = np.sort(by[repeated])
    if len(hit):
        cut = np.flatnonzero(np.concatenate([[True], (own[hit[1:]] != own[hit[:-1]]) | (begins[hit[1:]] != begins[hit[:-1]] + 1)]))
        end = np.concatenate([cut[1:], [len(hit)]]) - 1
        yield np.stack([doc[own[hit[cut]]], begins[hit[cut]], begins[hit[end]]], axis=1)


def _dealt(docs: DataFrame, window: int, mer: int, least: int) -> Deal:
    """Buckets for the windows of docs, and the runs of words that may be the minimisers of more than a quarter of a bucket.

    A run is the minimiser of window - mer + 1 windows at most wherever it stands.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in blocks(batches, limit=CHUNK_BYTES):
            words = words_of([t or b"" for t in texts], NON_SPACE)
            begins = np.unique(window_hashes(words.hash, window), return_index=True)[1]  # copies inside a chunk are shipped once
            own = (window_hashes(words.hash, mer) >> np.uint64(1))[begins]
            keys, n = np.unique(own, return_counts=True)
            often = n >= max(8, len(own) / (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(keys[often].view(np.int64), -1)), pa.array(np.append(n[often], len(own)))], ["mer", "n"])

    sample = docs.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text")
    counts = sample.mapInArrow(count, "mer bigint, n bigint").groupBy("mer").agg(F.sum("n").alias("n"))
    total = counts.filter("mer < 0").agg(F.sum("n")).first()[0] or 0
    buckets = max(least, -(-total * SAMPLE // BUCKET_WINDOWS))
    often = counts.filter((F.col("mer") >= 0) & (F.col("n") >= max(8, total / (4 * buckets * (window - mer + 1)), total / FREQUENT))).collect()  # FREQUENT rows at most
    return Deal(window, mer, buckets, np.sort(np.array([r.mer for r in often], dtype=np.uint64)))


def repeated_windows(docs: DataFrame, window: int = 20, mer: int = 3, buckets: int | None = None) -> DataFrame:
    """Intervals of windows, by first word, that repeat an earlier one: _id, lo, hi (both included).

    The number of buckets follows the number of windows, which a sample tells, and is at least `buckets`.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = _dealt(docs, window, mer, buckets or 4 * partitions)
    shared = spark.sparkContext.broadcast(dealt)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(texts: list[bytes], ids: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            own = np.concatenate(ids)
            order = np.argsort(own, kind="stable")
            rows = list(_pack([texts[i] for i in order.tolist()], own[order], shared.value))
            if rows:
                types = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["bucket", "strings", "ids", "starts", "marks"])

        texts, ids, size = [], [], 0
        for block, values in blocks(batches):
            texts += [v or b"" for v in values]
            ids.append(block.column("_id").to_numpy(zero_copy_only=False))
            size += sum(len(v or b"") for v in values)
            if size >= CHUNK_BYTES:
                yield from out(texts, ids)
                texts, ids, size = [], [], 0
        if texts:
            yield from out(texts, ids)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if parts and len(m := np.concatenate(parts)):
                yield pa.RecordBatch.from_arrays([pa.array(m[:, 0]), pa.array(m[:, 1].astype(np.int32)), pa.array(m[:, 2].astype(np.int32))], ["_id", "lo", "hi"])

        now, rows, passed = None, [], []
        for batch in batches:
            for bucket, strings, ids, starts, marks in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if bucket != now:
                    if rows:
                        yield from out(_bucket_marks(rows, window))
                    now, rows = bucket, []
                rows.append((strings, ids, starts))
                if marks:
                    passed.append(np.frombuffer(marks, dtype=np.int64).reshape(-1, 3))
            yield from out(passed)
            passed = []
        if rows:
            yield from out(_bucket_marks(rows, window))

    shipped = docs.select("_id", "text").mapInArrow(packed, _OUT)
    return shipped.repartition(max(partitions, dealt.buckets // 4), "bucket").sortWithinPartitions("bucket").mapInArrow(marked, "_id bigint, lo int, hi int")


def remove_repeated_substrings(docs: DataFrame, window: int = 20, mer: int = 3, buckets: int | None = None) -> DataFrame:
    """Removes each word covered by a window whose word sequence also starts earlier.

    Earlier means in a document of smaller doc_id, or at a smaller start in the
    same document.  Words are `[^\\x20\\x09-\\x0D]+`, unchanged.  Windows are judged
    on the input, not on what is left.

    Returns doc_id, `text` (the words that stay, joined by one space), n_words,
    n_removed for each row of docs.  Null and empty texts have no words.  A null
    doc_id counts as the smallest.  Rows that repeat a doc_id and its text are each
    returned and do not count as copies of each other; rows of one doc_id, or of
    none, with different texts are different documents, in an order by their texts'
    hashes.
    Other columns of docs are not read.
    """
    if not 1 <= mer <= window:
        raise ValueError("mer must be from 1 to window")
    keyed = told_apart(docs.select("doc_id", "text"))
    spans = repeated_windows(keyed, window, mer, buckets).groupBy("_id").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi")).withColumnRenamed("_id", "_marked")
    joined = keyed.join(spans, keyed["_id"] == spans["_marked"], "left").select("doc_id", "text", "lo", "hi")

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, gone = [], [], []
            for text, lo, hi in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("lo").to_pylist(), batch.column("hi").to_pylist(), strict=True):
                words = (text or b"").split()  # bytes split at exactly these six characters
                total.append(len(words))
                if lo:
                    change = np.zeros(len(words) + 1, dtype=np.int32)
                    np.add.at(change, np.array(lo), 1)
                    np.add.at(change, np.array(hi) + window, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
                gone.append(total[-1] - len(words))
                texts.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], ["doc_id", "text", "n_words", "n_removed"])

    return joined.mapInArrow(removed, "doc_id bigint, text string, n_words bigint, n_removed bigint")
