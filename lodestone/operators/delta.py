"""Objects as deltas against other objects: found by shared blocks, composed along chains, applied at the end.

Payloads are cut into blocks where a rolling hash of their bytes says so, so an
insertion moves few block ends.  The two payloads of a pair are cut side by side,
and the blocks in common are grown byte by byte to what is written down: runs to
copy from the base and bytes to insert.  A chain of deltas is one delta against its
root, made by mapping the upper one's runs through the lower one's, hop by hop for
all chains at once; payloads move once, when the root's meets the composed delta.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.objects import delta_savings
from lodestone.operators.rounds import stored

#: In order: a run of `length` bytes of the base from `at`, or the bytes of `data` where `at` is null.
DELTA = "array<struct<at: bigint, length: bigint, data: binary>>"
#: Bytes that a run, and an insertion beside its data, are counted as.
RUN_BYTES, INSERT_BYTES = 9, 5

_WINDOW = 16
#: Bytes of payloads, and rows, that _parts makes of a batch.
PART_BYTES, PART_ROWS = 4 << 20, 2000
_KEYS = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)

Run = tuple[int | None, int, bytes | None]


def block_ends(data: bytes, mean: int = 256) -> list[int]:
    """Where blocks of about mean bytes end: at a quarter of it at least and eight times it at most."""
    least, most = max(1, mean // 4), mean * 8
    keys = _KEYS[np.frombuffer(data, dtype=np.uint8)]
    rolled, factor, n = keys, int(_FACTOR), 1
    while n < _WINDOW:  # a window of 2n bytes is one of n bytes and the one before it
        wider = rolled * np.uint64(factor)
        wider[n:] += rolled[:-n]
        rolled, factor, n = wider, factor * factor % (1 << 64), 2 * n
    rolled ^= rolled >> np.uint64(31)
    marked = (np.flatnonzero((rolled * _FACTOR) >> np.uint64(32) < np.uint64((1 << 32) // mean)) + 1).tolist()
    ends, at = [], 0
    while at < len(data):
        next_ = bisect_left(marked, at + least)
        end = min(marked[next_] if next_ < len(marked) else len(data), at + most, len(data))
        ends.append(end)
        at = end
    return ends


def shared_blocks(base: bytes, target: bytes, mean: int = 256) -> list[tuple[int, int, int]]:
    """The target's blocks that are blocks of the base too, at their first place there: place in target, in base, length."""
    first, out, at = {}, [], 0
    for end in block_ends(base, mean):
        first.setdefault(base[at:end], at)
        at = end
    at = 0
    for end in block_ends(target, mean):
        here = first.get(target[at:end])
        if here is not None:
            out.append((at, here, end - at))
        at = end
    return out


def _alike(a: np.ndarray, b: np.ndarray) -> int:
    """How many bytes two arrays begin with in common."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        differs = np.flatnonzero(a[at : min(n, at + step)] != b[at : min(n, at + step)])
        if len(differs):
            return at + int(differs[0])
        at, step = at + step, step * 2
    return n


def runs_between(base: bytes, target: bytes, shared: list[tuple[int, int, int]]) -> list[Run]:
    """The target as runs of the base and insertions; shared are blocks in common (place in target, in base, length)."""
    a, b = np.frombuffer(base, dtype=np.uint8), np.frombuffer(target, dtype=np.uint8)
    out: list[Run] = []
    at = 0
    for there, here, n in sorted(shared):
        if there + n <= at or base[here : here + n] != target[there : there + n]:
            continue
        if there < at:
            here, there = here + at - there, at
        back = _alike(a[:here][::-1], b[at:there][::-1])
        here, there = here - back, there - back
        n = _alike(a[here:], b[there:])
        if there > at:
            out.append((None, there - at, target[at:there]))
        out.append((here, n, None))
        at = there + n
    if at < len(target):
        out.append((None, len(target) - at, target[at:]))
    return out


def applied_runs(base: bytes, runs: list[Run]) -> bytes:
    """The target of a delta; a run that leaves its base is an error."""
    parts = []
    for at, n, data in runs:
        if at is not None and at + n > len(base):
            raise ValueError("a run leaves its base")
        parts.append(data or b"" if at is None else base[at : at + n])
    return b"".join(parts)


def composed_runs(upper: list[Run], lower: list[Run]) -> list[Run]:
    """One delta that does what lower and then upper do."""
    ends = np.cumsum([n for _, n, _ in lower]).tolist()
    out: list[Run] = []

    def put(at: int | None, n: int, data: bytes | None) -> None:
        if out and at is not None and out[-1][0] is not None and out[-1][0] + out[-1][1] == at:
            out[-1] = (out[-1][0], out[-1][1] + n, None)
        elif out and at is None and out[-1][0] is None:
            out[-1] = (None, out[-1][1] + n, out[-1][2] + data)
        elif n:
            out.append((at, n, data))

    for at, n, data in upper:
        if at is None:
            put(None, n, data or b"")
            continue
        if at + n > (ends[-1] if ends else 0):
            raise ValueError("a run leaves its base")
        i = bisect_right(ends, at)
        while n:
            start = ends[i] - lower[i][1]
            skip = at - start
            own = min(n, lower[i][1] - skip)
            low, _, bytes_ = lower[i]
            put(None if low is None else low + skip, own, bytes_[skip : skip + own] if low is None else None)
            at, n, i = at + own, n - own, i + 1
    return out


def _parts(batches: Iterator[pa.RecordBatch], payloads: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches in parts of about PART_BYTES of the named columns, or one row, so that what Python makes of them doesn't grow with the batches."""
    for batch in batches:
        sizes = np.zeros(batch.num_rows, dtype=np.int64)
        for c in payloads:
            sizes += pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False)
        until, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            before = int(until[at - 1]) if at else 0
            end = max(at + 1, min(int(np.searchsorted(until, before + PART_BYTES, "right")), at + PART_ROWS))
            yield batch.slice(at, end - at)
            at = end


def _rows(column: pa.Array) -> list[list[tuple] | None]:
    """The lists of structs of a column as lists of tuples."""
    fields = [f.to_pylist() for f in column.flatten().flatten()]
    values, out, at = list(zip(*fields, strict=True)), [], 0
    for n in pc.list_value_length(column).to_pylist():
        out.append(None if n is None else values[at : at + n])
        at += n or 0
    return out


def _deltas(values: list[list[Run] | None]) -> pa.Array:
    flat = [r for runs in values for r in runs or ()]
    places = np.cumsum([0, *(len(runs or ()) for runs in values)])
    starts = pa.array(places, pa.int32(), mask=np.array([*(runs is None for runs in values), False]))
    columns = list(zip(*flat, strict=True)) or [(), (), ()]
    return pa.ListArray.from_arrays(starts, pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RUN_TYPE, strict=True)], fields=list(_RUN_TYPE)))


_RUN_TYPE = pa.struct([("at", pa.int64()), ("length", pa.int64()), ("data", pa.binary())])


def _by_row(f: Callable, schema: str) -> Callable:
    """f as a column function that takes rows a hundred at a time: an Arrow batch holds ten thousand, whose payloads have no bound."""
    return F.udf(f, schema, useArrow=False).asNondeterministic()  # so that no filter above works it out twice


def block_index(objects: DataFrame, mean: int = 256) -> DataFrame:
    """The blocks of objects (hash, data), a row an object: hash, blocks, which are at, length, digest (64 bits), first (whether no block before has that digest)."""

    def cut(data: bytes | None) -> list[tuple]:
        blocks, known, at = [], set(), 0
        for end in block_ends(data or b"", mean):
            digest = int.from_bytes(hashlib.blake2b(data[at:end], digest_size=8).digest(), "little", signed=True)
            blocks.append((at, end - at, digest, digest not in known))
            known.add(digest)
            at = end
        return blocks

    cut_ = _by_row(cut, "array<struct<at: bigint, length: bigint, digest: bigint, first: boolean>>")
    return objects.select("hash", cut_(F.col("data").cast("binary")).alias("blocks"))


def diffs(pairs: DataFrame, objects: DataFrame, mean: int = 256, most_bytes: int = 16 << 20) -> DataFrame:
    """Deltas of pairs (target, base) of objects (hash, data): target, base, target_len, delta_len, delta.

    Pairs and hashes are unique; a pair whose object is missing or whose payload is null
    or longer than most_bytes gives no row.  A block that a base repeats is found at its first place.
    """
    fit = objects.select("hash", F.col("data").cast("binary").alias("data")).filter(F.octet_length("data") <= most_bytes)
    both = pairs.select("target", "base").join(fit.select(F.col("hash").alias("target"), F.col("data").alias("own")), "target").join(fit.select(F.col("hash").alias("base"), F.col("data").alias("other")), "base")
    return diffs_beside(both, mean)


def diffs_beside(both: DataFrame, mean: int = 256) -> DataFrame:
    """diffs() of rows (target, base, own, other) that hold the payloads of both, which go nowhere; a null payload gives a null delta."""

    def run(own: bytes | None, other: bytes | None) -> tuple[list[Run] | None, int | None]:
        if own is None or other is None:
            return None, None
        runs = runs_between(other, own, shared_blocks(other, own, mean))
        return runs, sum(RUN_BYTES if at is not None else INSERT_BYTES + n for at, n, _ in runs)

    made = both.select("target", "base", F.octet_length("own").cast("long").alias("target_len"), _by_row(run, f"delta {DELTA}, delta_len bigint")("own", "other").alias("made"))
    return made.select("target", "base", "target_len", "made.delta_len", "made.delta")


def optimised(pairs: DataFrame, objects: DataFrame, mean: int = 256, most_bytes: int = 16 << 20) -> DataFrame:
    """diffs() that are smaller than their targets."""
    return delta_savings(diffs(pairs, objects, mean, most_bytes), most_bytes)


def _with_data(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Rows of keep with data: what `delta` makes of `root_data`, root_data itself for a null delta, null for a null root or a damaged delta."""

    def run(base: bytes | None, delta: list[Run] | None) -> bytes | None:
        try:
            return base if base is None or delta is None else applied_runs(base, delta)
        except ValueError:
            return None

    return rows.select(*keep, _by_row(run, "binary")("root_data", "delta").alias("data"))


def applied(deltas: DataFrame, objects: DataFrame) -> DataFrame:
    """The targets of deltas (target, base, delta) against objects (hash, data): their columns with data for delta; null without the base or where a run leaves it."""
    bases = objects.select(F.col("hash").alias("base"), F.col("data").cast("binary").alias("root_data"))
    return _with_data(deltas.join(bases, "base", "left"), [c for c in deltas.columns if c != "delta"])


def resolved_chains(objects: DataFrame, most: int = 5, wanted: DataFrame | None = None) -> DataFrame:
    """Each object's delta against the root of its chain: hash, root, hops, delta, problem; of those in wanted(hash), if it is given.

    objects(hash, base_hash, delta), hashes unique, have a null base and delta for whole ones,
    whose root they are themselves.  problem is null, or `self-reference`, `cycle`, `missing base`,
    `too deep` (more than `most` hops) or `damaged` (a run leaves its base).
    Objects are worked out once, and a hop moves only the chains that go on.
    """
    objects = stored(objects.select("hash", "base_hash", "delta"))
    lower = objects.select(F.col("hash").alias("root"), F.lit(True).alias("known"), F.col("base_hash").alias("next"), F.col("delta").alias("lower"))
    itself = F.when(F.col("hash") == F.col("base_hash"), "self-reference")
    first = objects if wanted is None else objects.join(wanted.select("hash"), "hash", "left_semi")
    chains = first.select("hash", F.coalesce("base_hash", "hash").alias("root"), F.col("base_hash").isNotNull().cast("long").alias("hops"), "delta", itself.alias("problem"), F.array("hash").alias("seen"), F.col("base_hash").isNotNull().alias("goes_on"))

    def compose(upper: list[Run] | None, below: list[Run] | None, goes_on: bool) -> tuple[list[Run] | None, bool]:
        try:
            return (composed_runs(upper or [], below or []) if goes_on else upper), False
        except ValueError:
            return None, True

    composed = _by_row(compose, f"delta {DELTA}, damaged boolean")
    done = []
    for hop in range(most):
        open_ = F.col("problem").isNull() & F.col("goes_on")
        done.append(chains.filter(~open_))
        chains = chains.filter(open_)
        if hop and chains.isEmpty():
            break
        met = chains.join(lower, "root", "left")
        told = F.when(F.col("known").isNull(), "missing base").when(F.array_contains("seen", F.col("root")), "cycle")
        if hop == most - 1:
            told = told.when(F.col("next").isNotNull(), "too deep")
        met = met.withColumn("problem", told).withColumn("goes_on", F.col("problem").isNull() & F.col("next").isNotNull())
        moved = met.select(
            "hash", F.when(F.col("goes_on"), F.col("next")).otherwise(F.col("root")).alias("root"), (F.col("hops") + F.col("goes_on").cast("long")).alias("hops"),
            "delta", "problem", F.when(F.col("goes_on"), F.array_append("seen", F.col("root"))).otherwise(F.col("seen")).alias("seen"), "goes_on", "lower",
        )
        moved = moved.withColumn("made", composed("delta", "lower", "goes_on"))
        problem = F.when(F.col("made.damaged"), "damaged").otherwise(F.col("problem")).alias("problem")
        chains = stored(moved.select("hash", "root", "hops", "made.delta", problem, "seen", "goes_on"))
    return reduce(DataFrame.union, [*done, chains]).drop("seen", "goes_on")


def contents(objects: DataFrame, most: int = 5, wanted: DataFrame | None = None) -> DataFrame:
    """The payloads of objects (hash, base_hash, delta, data; data is null for deltas): hash, hops, data, problem; data is null with a problem.  Of those in wanted(hash), if it is given."""
    chains = resolved_chains(objects, most, wanted)
    roots = objects.filter("data is not null").select(F.col("hash").alias("root"), F.col("data").cast("binary").alias("root_data"))
    made = _with_data(chains.join(roots, "root", "left").withColumn("root_data", F.when(F.col("problem").isNull(), F.col("root_data"))), ["hash", "hops", "problem"])
    return made.select("hash", "hops", "data", F.coalesce("problem", F.when(F.col("data").isNull(), "damaged")).alias("problem"))
