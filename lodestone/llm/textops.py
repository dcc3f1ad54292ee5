"""Helpers that the corpus operators share inside Python tasks.

Texts are handled as UTF-8 bytes in blocks of about a megabyte, and words are
located and hashed for a whole block at once with numpy.  Nothing here keeps
more than one block, so memory does not depend on the size of a partition
(a single text larger than a block makes a block of its own).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

#: Word characters of `[^\x20\x09-\x0D]+`, by byte.
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Word characters of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, by byte.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_RNG = np.random.default_rng(20240229)
_BYTE_KEYS = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_POWERS = np.ones(1, dtype=np.uint64)
_INVERSES = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = max(n, BLOCK_BYTES + (1 << 16))
        grown = np.full(size, _BASE, dtype=np.uint64)
        grown[0] = 1
        inverse = np.full(size, _BASE_INVERSE, dtype=np.uint64)
        inverse[0] = 1
        _POWERS, _INVERSES = np.multiply.accumulate(grown), np.multiply.accumulate(inverse)
    return _POWERS[:n], _INVERSES[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit of the result depends on every bit of x."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Words(NamedTuple):
    """The words of a block of texts."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    #: Words of text i: lo[i] to lo[i + 1].
    lo: np.ndarray
    #: Hashes of the words' first bytes, for each length asked for.
    stems: list[np.ndarray]

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.lo) - 1), np.diff(self.lo))


def words_of(texts: list[bytes], table: np.ndarray, hashed: bool = True, stems: tuple[int, ...] = ()) -> Words:
    """Finds and hashes the words of texts; table tells word characters by byte and must exclude newline."""
    data = b"\n".join(texts) + b"\n"
    buffer = np.frombuffer(data, dtype=np.uint8)
    inside = table[buffer]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[::2], edge[1::2]
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    lo = np.searchsorted(start, np.concatenate([[0], np.cumsum(lengths)]))
    hashes = np.zeros(len(start), dtype=np.uint64)
    beginnings = [np.zeros(len(start), dtype=np.uint64) for _ in stems]
    i = 0
    while hashed and i < len(start):  # prefix sums over a block of whole words at a time
        j = max(i + 1, int(np.searchsorted(start, start[i] + BLOCK_BYTES)))
        base, own = start[i], buffer[start[i] : end[j - 1]]
        power, inverse = _powers(len(own))
        sums = np.empty(len(own) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE_KEYS[own] * power, out=sums[1:])
        a, b = start[i:j] - base, end[i:j] - base
        hashes[i:j] = mix64((sums[b] - sums[a]) * inverse[a])
        for n, out in zip(stems, beginnings, strict=True):
            out[i:j] = mix64((sums[np.minimum(b, a + n)] - sums[a]) * inverse[a])
        i = j
    return Words(data, start, end, hashes, lo, beginnings)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Order-dependent hashes of every size consecutive values."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    factor = 0xD6E8FEB86659FD93
    for i in range(size):
        total = total * np.uint64(factor) + hashes[i : i + n]
    return mix64(total)


def blocks(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of the batches whose texts hold about limit bytes, with the texts as UTF-8 bytes."""
    for batch in batches:
        at = batch.schema.get_field_index(text)
        values = batch.column(at).cast(pa.large_binary()).to_pylist()
        begin = size = 0
        for i, value in enumerate(values):
            size += len(value or b"") + 1
            if size >= limit:
                yield batch.slice(begin, i + 1 - begin), values[begin : i + 1]
                begin, size = i + 1, 0
        if begin < len(values):
            yield batch.slice(begin), values[begin:]


def runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal neighbours begins."""
    if not len(keys):
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
