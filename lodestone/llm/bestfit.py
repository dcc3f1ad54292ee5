"""Best-fit packing in bulk-synchronous rounds.

Documents longer than a sequence give whole pieces, each a sequence of its own, and a
first piece of what is left over.  All shorter pieces are placed in rounds:

1. Sequences with room for the shortest piece left are the gaps.  A gap of several times
   the longest piece left offers that many slots of equal size, any other gap one.
2. Pieces and slots are sorted together by size, descending, over ranges.
3. Every range is swept: a piece takes the slot above it that was passed last and isn't
   taken, its successor by size, as a bracket closes the last open one.  Where several
   pieces have one successor, the first by rank has it and the others take those before.
   A sweep is a prefix sum and a stable sort by depth, with no loop over rows.
4. What a range can't settle meets across ranges: only the counts of open slots and of
   pieces left over, two numbers a range, come to the driver.  They give each open slot and
   each such piece the depth at which it stands in the whole order, and the two of one depth
   are neighbours there.
5. Where a sweep places few, the longest pieces left open new sequences by rank: OPENED of those
   that their tokens fill, or as many as pieces of their length need.
6. Gaps lose what they have taken, and the next round takes the pieces that are left.

A round places a tenth of the pieces left or opens most of the sequences that they need, so
rounds grow with the logarithm of what is left; 10 to 20 are usual, for any number of documents.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import discard, stored
from lodestone.llm.tokens import token_ids

PIECES = "item bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_SWEPT = "state int, part int, rank bigint, item bigint, length int, seq bigint"
MATCHED, PIECE, SLOT = 0, 1, 2


def swept(size: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of matched slots, of their pieces, of pieces left over and of slots left open, in an order of descending size."""
    balance = np.cumsum(np.where(piece, -1, 1))
    least = np.minimum.accumulate(np.minimum(balance, 0))
    missed = piece & (balance < np.concatenate([[0], least[:-1]]))
    at = np.flatnonzero(~missed)
    closes = piece[at]
    depth = np.cumsum(np.where(closes, -1, 1)) + closes
    order = np.argsort(depth, kind="stable")
    own, kind = depth[order], closes[order]
    pair = np.flatnonzero((own[1:] == own[:-1]) & kind[1:] & ~kind[:-1])
    slots, pieces = at[order[pair]], at[order[pair + 1]]
    left = ~missed
    left[slots] = left[pieces] = False
    return slots, pieces, np.flatnonzero(missed), np.flatnonzero(left)


def _sweep(pieces: DataFrame, slots: DataFrame, ranges: int) -> DataFrame:
    """Rows of _SWEPT: matches, and what each range leaves, ranked as it stands there."""
    both = pieces.select(F.col("length").alias("size"), F.lit(1).alias("kind"), F.col("item").alias("id")).unionAll(slots.select("size", F.lit(0).alias("kind"), F.col("seq").alias("id")))
    order = [F.col("size").desc(), F.col("kind").asc(), F.col("id").asc()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        size, kind, ids = (table.column(c).to_numpy() for c in ("size", "kind", "id"))
        taken, placed, missed, open_ = swept(size, kind == 1)
        part = TaskContext.get().partitionId()
        for state, own, seq in ((MATCHED, placed, ids[taken]), (PIECE, missed, None), (SLOT, open_, ids[open_])):
            n = len(own)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, state, dtype=np.int32)),
                    pa.array(np.full(n, part, dtype=np.int32)),
                    pa.array(np.arange(n)),
                    pa.nulls(n, pa.int64()) if state == SLOT else pa.array(ids[own]),
                    pa.array(size[own].astype(np.int32)),
                    pa.nulls(n, pa.int64()) if seq is None else pa.array(seq),
                ],
                ["state", "part", "rank", "item", "length", "seq"],
            )

    return both.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(run, _SWEPT)


class _Across(NamedTuple):
    """How the ranges of a sweep stand in the whole order."""

    #: part, height before it, pieces that find a slot of an earlier range, height after them, rank of the first piece that finds none.
    rows: list[tuple[int, int, int, int, int]]
    matched: int
    unmatched: int


def _across(out: DataFrame) -> _Across:
    counts = out.groupBy("part").agg(*(F.count_if(F.col("state") == s).alias(f"n{s}") for s in (MATCHED, PIECE, SLOT))).orderBy("part").collect()
    rows, height, matched, unmatched = [], 0, 0, 0
    for r in counts:
        found = min(r.n1, height)
        rows.append((r.part, height, found, height - found, unmatched))
        height += r.n2 - found
        matched += r.n0 + found
        unmatched += r.n1 - found
    return _Across(rows, matched, unmatched)


def _placed(out: DataFrame, parts: DataFrame) -> DataFrame:
    """item, length, seq of all pieces that a sweep matches, in a range or across ranges."""
    level = F.when(F.col("state") == PIECE, F.col("height") - F.col("rank")).otherwise(F.col("after") + F.col("rank") + 1)
    left = out.filter(F.col("state") != MATCHED).join(parts, "part").filter((F.col("state") == SLOT) | (F.col("rank") < F.col("found")))
    before = F.lag("seq").over(Window.partitionBy("level").orderBy("part", "state"))
    pairs = left.withColumn("level", level).withColumn("slot", before).filter(F.col("state") == PIECE)
    return out.filter(F.col("state") == MATCHED).select("item", "length", "seq").unionAll(pairs.select("item", "length", F.col("slot").alias("seq")))


#: A round opens sequences if its sweep placed no more than this share of its pieces.
FEW = 0.1
#: The share of the sequences that the pieces' tokens fill which a round opens at once; the rest may find room in their gaps.
OPENED = 0.8


def _opened(lengths: dict[int, int], capacity: int) -> tuple[int, int]:
    """How many sequences to open for pieces of these lengths (with their numbers), and how many pieces each takes by rank."""
    total, top = sum(n * k for n, k in lengths.items()), max(lengths)
    if total <= capacity:
        return 1, sum(lengths.values())
    fit = capacity // top
    alike = sum(k for n, k in lengths.items() if n > capacity // (fit + 1))
    return max(math.ceil(OPENED * total / capacity), math.ceil(alike / fit)), fit


def _without_longest(lengths: dict[int, int], most: int) -> dict[int, int]:
    left = {}
    for n in sorted(lengths, reverse=True):
        taken = min(most, lengths[n])
        most -= taken
        if lengths[n] > taken:
            left[n] = lengths[n] - taken
    return left


def _ranges(rows: int, usual: int, rows_per_range: int) -> int:
    """How many ranges to sweep: none larger than rows_per_range, and up to the usual number of partitions as long as they aren't small."""
    return max(rows // rows_per_range + 1, min(usual, rows // (rows_per_range >> 4 or 1) + 1))


def place(items: DataFrame, capacity: int, rows_per_range: int = 1 << 18) -> DataFrame:
    """A sequence for each item of `item` (unique) and `length` (1 to capacity).

    Returns item, length, seq; the lengths of a sequence add up to at most capacity.
    The driver holds how many pieces of each length are left: capacity numbers at most.
    """
    spark = items.sparkSession
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def counted(pieces: DataFrame) -> dict[int, int]:
        return {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}

    left, held, gaps, done, opened, free = items.select("item", F.col("length").cast("int").alias("length")), None, None, [], 0, 0
    lengths = counted(left)
    while lengths:
        top, low, n_left = max(lengths), min(lengths), sum(lengths.values())
        slots, n_slots = spark.createDataFrame([], "size int, seq bigint"), 0
        if gaps is not None:
            share = F.greatest(F.lit(1), F.floor(F.col("room") / top)).cast("int")
            slots = gaps.filter(F.col("room") >= low).select(F.floor(F.col("room") / share).cast("int").alias("size"), F.explode(F.array_repeat("seq", share)).alias("seq"))
            n_slots = opened + free // top
        out = stored(_sweep(left, slots, _ranges(n_left + n_slots, usual, rows_per_range)), "sweep")
        if held is not None:
            discard(held)
        held, across = out, _across(out)
        parts = F.broadcast(spark.createDataFrame(across.rows, "part int, height bigint, found bigint, after bigint, first bigint"))  # a row a range
        numbered = out.filter(F.col("state") == PIECE).join(parts, "part").filter(F.col("rank") >= F.col("found"))
        rest = numbered.select("item", "length", (F.col("first") + F.col("rank") - F.col("found")).alias("number"))  # from the longest on
        before = sum(n * k for n, k in lengths.items())
        lengths = counted(rest) if across.unmatched else {}
        free -= before - sum(n * k for n, k in lengths.items())
        placed = _placed(out, parts)
        left, first_new = rest.select("item", "length"), opened
        if lengths and across.matched <= FEW * n_left:
            number, fit = _opened(lengths, capacity)
            most = min(number * fit, across.unmatched)
            new = rest.filter(F.col("number") < most).select("item", "length", (F.lit(opened) + F.floor(F.col("number") / fit)).cast("long").alias("seq"))
            placed = placed.unionAll(new)
            left, opened = rest.filter(F.col("number") >= most).select("item", "length"), opened + -(-most // fit)
            after = _without_longest(lengths, most)
            free += (opened - first_new) * capacity - sum(n * (k - after.get(n, 0)) for n, k in lengths.items())
            lengths = after
        changes = placed.select("seq", (-F.col("length")).alias("room"))
        if gaps is not None:
            changes = changes.unionAll(gaps)
        room = (F.sum("room") + F.when(F.col("seq") >= first_new, capacity).otherwise(0)).cast("int")
        now = changes.groupBy("seq").agg(room.alias("room")).filter("room > 0")
        both = placed.select("item", "length", "seq", F.lit(0).alias("room"), F.lit("placed").alias("kind"))
        if lengths:
            both = both.unionAll(now.select(F.lit(0).cast("long"), F.lit(0), "seq", "room", F.lit("gap")))
        round_ = stored(both, "round", by="kind")
        done.append(round_.filter("kind = 'placed'").select("item", "length", "seq"))
        gaps = round_.filter("kind = 'gap'").select("seq", "room")
    if held is not None:
        discard(held)
    if not done:
        return spark.createDataFrame([], "item bigint, length int, seq bigint")
    return reduce(DataFrame.unionAll, done)


def best_fit_pack(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = 2048, with_ids: bool = False, special_tokens: tuple[tuple[str, int], ...] = (), rows_per_range: int = 1 << 18) -> DataFrame:
    """Packs the token ids of docs, each document's followed by id 0, into as few sequences of at most capacity tokens as best-fit finds.

    `ranks_path` names a byte-level BPE's ranks (base64 token and rank a line) and `pattern`
    its pre-token pattern; every executor has the file at that path.  `special_tokens` are
    strings with their ids that a text may hold as tokens; by default such strings are text.

    Only documents of more than capacity ids are cut: into pieces of capacity ids, but for
    the first, which has what is left over.  Returns a row per piece: doc_id, piece (from
    0), start (its document's ids before it), length, ids_crc32 (of the ids as little-endian
    unsigned 32-bit integers), sequence_id, offset (from 0, without gaps, in the sequence),
    and `ids` array<int> if with_ids.  Null and empty texts are the id 0 alone.  Every row is packed,
    rows that repeat a doc_id too; a null doc_id stays null.  Other columns aren't read; no rows give none.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_ids(ranks_path, pattern, special_tokens)
        number = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            types = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.bool_(), *[pa.list_(pa.int32())] * with_ids]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [*_names(PIECES), "whole", *["ids"] * with_ids])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.array(encode(text), dtype="<u4")
                ends = range(len(ids) % capacity or capacity, len(ids) + 1, capacity)
                start = 0
                for piece, end in enumerate(ends):
                    own = ids[start:end]
                    rows.append((number, doc_id, piece, start, len(own), zlib.crc32(own.tobytes()), len(own) == capacity, *([own.astype(np.int32)] if with_ids else [])))
                    number += 1
                    start = end
                    if len(rows) >= 4096:
                        yield out()
        if rows:
            yield out()

    schema = PIECES + ", whole boolean" + ", ids array<int>" * with_ids
    pieces = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema), "pieces")
    placed = place(pieces.filter("not whole").select("item", "length"), capacity, rows_per_range)
    earlier = Window.partitionBy("seq").orderBy(F.col("length").desc(), "item").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.select("item", F.col("seq").alias("sequence_id"), F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("long").alias("offset"))
    shared = pieces.filter("not whole").join(offsets, "item")
    whole = pieces.filter("whole").withColumns({"sequence_id": -1 - F.col("item"), "offset": F.lit(0).cast("long")})  # placed ones count from 0
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids]
    return shared.select(*columns).unionAll(whole.select(*columns))


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]
