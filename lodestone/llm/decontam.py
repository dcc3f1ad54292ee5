"""Benchmark decontamination with a broadcast hash set of normalised item n-grams.

The windows of all benchmark items are hashed into one sorted table, which is
broadcast; each task scans its documents' token windows against it, confirms
every hit on the words themselves and marks the words that it covers.  Documents
are neither shuffled nor sorted.

The table's size is checked: items are dealt into blocks of at most
`block_windows` windows (12 MB of hashes and their words), and each block is one
scan of the documents, merged by document.  One block is the usual case.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.textops import ALNUM, blocks, window_hashes, words_of


class Windows(NamedTuple):
    """Item windows of one length in words, by hash; windows of equal hash are neighbours."""

    size: int
    hash: np.ndarray
    #: For each hash, the windows' words joined by a space, with the items that hold them.
    items: list[dict[bytes, set[int]]]


def _windows_of(text: str | None, window: int) -> tuple[int, list[bytes]]:
    words = words_of([(text or "").encode().lower()], ALNUM, hashed=False)
    own = [words.data[a:b] for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True)]
    size = min(window, len(own))
    return size, [b" ".join(own[i : i + size]) for i in range(len(own) - size + 1)] if own else []


def hash_set(items: list[tuple[int, str | None]], window: int) -> list[Windows]:
    """The windows of items (number, text), by length."""
    by_size: dict[int, dict[bytes, set[int]]] = {}
    for number, text in items:
        size, own = _windows_of(text, window)
        for w in own:
            by_size.setdefault(size, {}).setdefault(w, set()).add(number)
    out = []
    for size, held in sorted(by_size.items()):
        by_hash: dict[int, dict[bytes, set[int]]] = {}
        keys = list(held)
        words = words_of(keys, ALNUM)
        for key, h in zip(keys, window_hashes(words.hash, size)[words.lo[:-1]].tolist(), strict=True):
            by_hash.setdefault(h, {})[key] = held[key]
        hashes = np.array(sorted(by_hash), dtype=np.uint64)
        out.append(Windows(size, hashes, [by_hash[h] for h in hashes.tolist()]))
    return out


def find_hits(texts: list[bytes | None], table: list[Windows]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[set[int]]]:
    """(text, first byte, last byte) of hit words, the number of words by text, and the items by text.

    Bytes count from the beginning of each text.
    """
    words = words_of([(t or b"").lower() for t in texts], ALNUM)
    change = np.zeros(len(words.start) + 1, dtype=np.int32)
    items: list[set[int]] = [set() for _ in texts]
    for size, hashes, held in table:
        own = window_hashes(words.hash, size)
        if not len(own) or not len(hashes):
            continue
        # a table of one bit for each value of the low 20 bits leaves few windows to search for
        maybe = np.zeros(1 << 20, dtype=bool)
        maybe[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        at = np.flatnonzero(maybe[(own & np.uint64((1 << 20) - 1)).astype(np.int64)])
        found = np.minimum(np.searchsorted(hashes, own[at]), len(hashes) - 1)
        hit = hashes[found] == own[at]
        at, found = at[hit], found[hit]
        text = np.searchsorted(words.lo, at, side="right") - 1
        inside = at + size <= words.lo[text + 1]
        for i, k, t in zip(at[inside].tolist(), found[inside].tolist(), text[inside].tolist(), strict=True):
            key = b" ".join(words.data[a:b] for a, b in zip(words.start[i : i + size].tolist(), words.end[i : i + size].tolist(), strict=True))
            if key in held[k]:
                items[t] |= held[k][key]
                change[i] += 1
                change[i + size] -= 1
    marked = np.flatnonzero(np.cumsum(change[:-1]))
    text = np.searchsorted(words.lo, marked, side="right") - 1
    offset = np.concatenate([[0], np.cumsum([len(t or b"") + 1 for t in texts])])[text]
    return text, words.start[marked] - offset, words.end[marked] - offset, np.diff(words.lo), items


def _blocks_of(items: list[tuple[int, str | None]], window: int, most: int) -> Iterator[list[tuple[int, str | None]]]:
    block, size = [], 0
    for number, text in items:
        n = len(_windows_of(text, window)[1])
        if block and size + n > most:
            yield block
            block, size = [], 0
        block.append((number, text))
        size += n
    if block:
        yield block


def mark_contamination(docs: DataFrame, items: DataFrame, window: int = 10, block_windows: int = 1 << 20) -> DataFrame:
    """Marks the words of docs that lie inside any occurrence of an item's window.

    A window is `window` consecutive words of items.text; an item of fewer words,
    but not none, is one window.  Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the
    text with A-Z lower-cased.

    Returns the columns of docs and `_n_words`, `_n_hit`, `_items` (the item_ids
    with occurring windows, as sorted strings), `_spans` (from and to, in bytes of
    the UTF-8 text, of each hit word); input columns of these names are overwritten.  Null and empty texts, and null and empty
    items, have no words.  Repeated items count once by item_id; a null item_id is
    left out of `_items`, but its words are hit.  Each row of docs is judged by
    itself, whatever its doc_id.

    The item table goes to the driver, which deals it into blocks; a benchmark is
    a bounded list of test items by nature, and `block_windows` bounds what is
    broadcast at once.
    """
    rows = [(r[0], r[1]) for r in items.select("item_id", "text").toLocalIterator()]
    names = [None if r[0] is None else str(r[0]) for r in rows]
    tables = [hash_set(b, window) for b in _blocks_of([(i, r[1]) for i, r in enumerate(rows)], window, block_windows)] or [[]]
    schema = docs.withColumns({"_n_words": F.lit(0).cast("long"), "_n_hit": F.lit(0).cast("long"), "_items": F.array(F.lit("")), "_spans": F.array(F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")))}).schema

    def scan(df: DataFrame, table: list[Windows], first: bool) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast((table, names))

        def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, named = shared.value
            for batch, texts in blocks(batches):
                text, a, b, n_words, found = find_hits(texts, known)
                spans: list[list[dict]] = [[] for _ in texts]
                for t, x, y in zip(text.tolist(), a.tolist(), b.tolist(), strict=True):
                    spans[t].append({"a": x, "b": y})
                told = [{named[i] for i in s} - {None} for s in found]
                columns = {n: batch.column(n) for n in batch.schema.names}
                if not first:
                    for i, (old, more) in enumerate(zip(columns["_spans"].to_pylist(), columns["_items"].to_pylist(), strict=True)):
                        spans[i] = [{"a": x, "b": y} for x, y in sorted({(s["a"], s["b"]) for s in [*old, *spans[i]]})]
                        told[i] |= set(more)
                columns |= {
                    "_n_words": pa.array(n_words, pa.int64()),
                    "_n_hit": pa.array([len(s) for s in spans], pa.int64()),
                    "_items": pa.array([sorted(s) for s in told], pa.list_(pa.string())),
                    "_spans": pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        return df.mapInArrow(marked, schema)

    return reduce(lambda df, it: scan(df, it[1], it[0] == 0), enumerate(tables), docs)


def remove_spans(marked: DataFrame) -> DataFrame:
    """The result of mark_contamination with the hit words cut out of `text`; what stands between them stays."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            left = []
            for text, spans in zip(texts, batch.column("_spans").to_pylist(), strict=True):
                if spans:
                    ends = [0, *(s["b"] for s in spans)]
                    text = b"".join(text[a:b] for a, b in zip(ends, [*(s["a"] for s in spans), len(text)], strict=True))
                left.append(text)
            columns = {n: batch.column(n) for n in batch.schema.names} | {"text": pa.array(left, pa.binary()).cast(pa.string())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return marked.mapInArrow(cut, marked.withColumn("text", F.col("text").cast("string")).schema)
