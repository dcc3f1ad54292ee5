"""Bit planes of hashes: which positions of a Bloom filter are hit at least once, or at least twice.

Tasks ship short position lists by segment, and a segment's lists are merged one
after the other, so no task holds more than a segment.  Planes have a fixed size,
which bounds what comes to the driver and is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.textops import runs

SEGMENT_BITS = 1 << 16
FLUSH = 1 << 20
PARTS = "segment int, once binary, twice binary"


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Two positions a hash."""
    mask = np.uint64(bits - 1)
    return np.stack([hashes & mask, (hashes >> np.uint64(32)) & mask])


def part(hashes: np.ndarray, bits: int) -> pa.RecordBatch:
    """A task's positions as rows of PARTS: those it hits once, and those it hits more often."""
    at, count = np.unique(positions(hashes, bits).ravel(), return_counts=True)
    segment, within = (at // np.uint64(SEGMENT_BITS)).astype(np.int32), (at % np.uint64(SEGMENT_BITS)).astype(np.uint16)
    begin = runs(segment)
    rows = []
    for a, b in zip(begin, [*begin[1:], len(segment)], strict=True):
        more = count[a:b] > 1
        rows.append((int(segment[a]), within[a:b][~more].tobytes(), within[a:b][more].tobytes()))
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["segment", "once", "twice"])


def plane(parts: DataFrame, bits: int, times: int) -> np.ndarray:
    """The positions that parts hit at least `times` (1 or 2) times, packed into bits / 8 bytes."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, np.zeros(SEGMENT_BITS, dtype=np.uint8)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(seen >= times, bitorder="little").tobytes()], pa.binary())], ["segment", "plane"])

        for batch in batches:
            for segment, once, twice in zip(*(batch.column(c).to_pylist() for c in ("segment", "once", "twice")), strict=True):
                if segment != now:
                    if now is not None:
                        yield out()
                    now = segment
                    seen[:] = 0
                at = np.frombuffer(once, dtype=np.uint16)
                seen[at] = np.minimum(seen[at] + 1, 2)
                seen[np.frombuffer(twice, dtype=np.uint16)] = 2
        if now is not None:
            yield out()

    whole = np.zeros(bits // 8, dtype=np.uint8)
    size = SEGMENT_BITS // 8
    for row in parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(merged, "segment int, plane binary").collect():  # bits / 8 bytes at most
        whole[row.segment * size : (row.segment + 1) * size] = np.frombuffer(row.plane, dtype=np.uint8)
    return whole


def hits(whole: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Which hashes have all their positions in the plane."""
    at = positions(hashes, bits)
    return ((whole[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)
