"""Payloads as rows of chunks, so that none has to fit where a part of it is wanted."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
#: Bytes of chunks that are handed on at a time, and what a chunk counts for besides its own.
PART_BYTES, ROW_BYTES = 4 << 20, 100
CHUNKS = "hash string, at bigint, size bigint, whole bigint, bytes binary"


def _given(held: list[tuple[pa.Array, ...]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*held, strict=True)], ["hash", "at", "size", "whole", "bytes"])


def pieces(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """The chunks of batches (data), many at a time whatever their length."""
    held, size = [], 0
    for batch in batches:
        for value in batch.column("data"):
            if not value.is_valid:
                continue
            data = value.as_buffer()
            hash_, whole, at = hashlib.sha256(data).hexdigest(), data.size, 0
            while at < max(1, whole):  # as many chunks at a time as PART_BYTES hold
                n = max(1, min(PART_BYTES // chunk_bytes, -(-(whole - at) // chunk_bytes)))
                ends = np.minimum(at + chunk_bytes * np.arange(n + 1, dtype=np.int64), whole)
                part = data.slice(at, int(ends[-1]) - at)
                cut = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((ends - at).astype(np.int32)), part])
                held.append((pa.repeat(hash_, n), pa.array(ends[:-1]), pa.array(np.diff(ends)), pa.repeat(pa.scalar(whole, pa.int64()), n), cut))
                size += part.size + ROW_BYTES * n
                at += n * chunk_bytes
                if size >= PART_BYTES:
                    yield _given(held)
                    held, size = [], 0
    if held:
        yield _given(held)


def chunked(payloads: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunks of payloads (data): hash, at, size, whole (the payload's length), bytes; an empty payload is one empty chunk, null ones have none.

    Rows that repeat a payload give its chunks again.
    """

    return payloads.select(F.col("data").cast("binary").alias("data")).mapInArrow(lambda batches: pieces(batches, chunk_bytes), CHUNKS)


def ranges(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """The parts of chunks (hash, at, size, bytes; unique by hash and at) that wanted(hash, start, length) asks for: hash, start, at, bytes.

    A range is given in as many rows as it meets chunks, in order of `at`, its place in the
    payload; what lies beyond a payload's end has none, nor does a range of no length.
    Chunks before all ranges or behind them meet none and are not dealt out.
    """
    wanted = wanted.select("hash", "start", "length").filter("length > 0").distinct()
    reach = wanted.agg(F.min("start").alias("_from"), F.max(F.col("start") + F.col("length")).alias("_until"))  # one row
    near = chunks.join(F.broadcast(reach), (F.col("at") < F.col("_until")) & (F.col("at") + F.col("size") > F.col("_from"))).drop("_from", "_until")
    met = near.join(wanted, "hash").filter((F.col("at") < F.col("start") + F.col("length")) & (F.col("at") + F.col("size") > F.col("start")))
    first, last = F.greatest("at", "start"), F.least(F.col("at") + F.col("size"), F.col("start") + F.col("length"))
    part = F.substring(F.col("bytes"), (first - F.col("at") + 1).cast("int"), (last - first).cast("int"))
    return met.select("hash", "start", first.alias("at"), part.alias("bytes"))
