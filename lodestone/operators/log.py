"""An append-only change log (pos, key, op, ...) as a table: folds, segments, checkpoints."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.rounds import cut

PUTS = ("put", "put_large")


def latest_state(log: DataFrame) -> DataFrame:
    """The last put or delete of each key: key, op, pos, len; constraints don't count."""
    ops = log.filter(F.col("op") != "constraint")
    return ops.groupBy("key").agg(F.max_by(F.struct("op", "pos", "len"), "pos").alias("s")).select("key", "s.op", "s.pos", "s.len")


def rebuilt(log: DataFrame) -> DataFrame:
    """The whole log folded into live objects: tombstones drop out."""
    return latest_state(log).filter(F.col("op") != "delete").select("key", "op", "pos", "len")


def pending_constraints(log: DataFrame) -> DataFrame:
    """Keys whose last entry of any kind is a constraint: key, pos; a later put or delete clears it."""
    return log.groupBy("key").agg(F.max("pos").alias("pos"), F.max_by("op", "pos").alias("op")).filter(F.col("op") == "constraint").select("key", "pos")


def constraint_read_through(index: DataFrame, pending: DataFrame) -> DataFrame:
    """Bases of each target: the index's if it has any, else the pending ones."""
    both = index.select("target", F.col("bases").alias("i")).join(pending.select("target", F.col("bases").alias("p")), "target", "full")
    return both.select("target", F.when(F.size("i") > 0, F.col("i")).otherwise(F.coalesce("p", F.array().cast("array<bigint>"))).alias("bases"))


def segment_boundaries(log: DataFrame, segment: str) -> DataFrame:
    return log.groupBy(segment).agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count("*").alias("entries"))


def replay(log: DataFrame, first: int, last: int) -> DataFrame:
    """Entries from first to last, both included."""
    return log.filter(F.col("pos").between(first, last))


def trimmed(log: DataFrame, up_to: int) -> DataFrame:
    return log.filter(F.col("pos") > up_to)


def checkpoint_split(log: DataFrame, segment: str, checkpoint: int) -> DataFrame:
    """By segment, entries applied before the checkpoint and still to apply, and the position to advance to."""
    done = F.col("pos") <= checkpoint
    return log.groupBy(segment).agg(F.count_if(done).alias("applied"), F.count_if(~done).alias("to_apply"), F.max("pos").alias("advance_to"))


class Seals(NamedTuple):
    """What a stretch of a log does to the bytes that its first segment already holds.

    The segment is sealed before the stretch's first entry with `before` + held >= most, before being
    the bytes of the stretch up to that entry.  From there on all is fixed: `seals` more segments begin, and
    the last holds `held` bytes at the stretch's end.  Without such an entry the segment holds `total` more.
    """

    total: int
    before: np.ndarray
    seals: np.ndarray
    held: np.ndarray

    def after(self, held: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Segments begun, and bytes held at the end, for each number of bytes held before."""
        at = np.searchsorted(self.before, most - held)
        found = at < len(self.before)
        own = np.minimum(at, max(0, len(self.before) - 1))
        if not len(self.before):
            return np.zeros(len(held), dtype=np.int64), held + self.total
        return np.where(found, self.seals[own], 0), np.where(found, self.held[own], held + self.total)


def seals_of(sizes: np.ndarray, most: int) -> Seals:
    """The seals of a stretch of entries of these sizes."""
    sums = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    n, total = len(sizes), int(sums[-1])
    next_ = np.maximum(np.searchsorted(sums[:n], sums[:n] + most), np.arange(n) + 1).tolist()  # the entry before which a segment that begins here is sealed
    seals, held = [1] * n, (total - sums[:n]).tolist()
    for i in range(n - 1, -1, -1):
        if next_[i] < n:
            seals[i], held[i] = 1 + seals[next_[i]], held[next_[i]]
    first = min(n, int(np.searchsorted(sums[:n], most)) + 1)
    return Seals(total, sums[:first], np.array(seals[:first], dtype=np.int64), np.array(held[:first], dtype=np.int64))


def joined_seals(stretches: list[Seals], most: int) -> Seals:
    """The seals of stretches that follow each other."""
    total, parts = 0, []
    for i, own in enumerate(stretches):
        if len(own.before) and not (parts and parts[-1][0][-1] >= most):  # where that is reached, no later entry is the first
            k, held = own.seals, own.held
            for later in stretches[i + 1 :]:
                more, held = later.after(held, most)
                k = k + more
            parts.append((own.before + total, k, held))
        total += own.total
    if not parts:
        return Seals(total, *[np.zeros(0, dtype=np.int64)] * 3)
    return Seals(total, *(np.concatenate(x) for x in zip(*parts, strict=True)))


_SEALS = "part string, level long, no long, total long, before array<long>, seals array<long>, held array<long>"


def _seals(row: object) -> Seals:
    return Seals(int(row.total), *(np.array(x, dtype=np.int64) for x in (row.before, row.seals, row.held)))


def sealed_segments(log: DataFrame, part: str, size: str, most: int, together: int = 64) -> DataFrame:
    """Entries with the number of their segment in each part of the log: part, pos, segment.

    A segment is sealed before an append once it holds `most` bytes: a running sum that
    starts anew.  Entries are dealt out by ranges of part and position, and a range tells
    by itself what becomes of any number of bytes that its first segment may already hold (Seals).  Of a part in
    several ranges, `together`
    ranges that follow each other are joined to one such function, and those again, until a part
    has one; then what each range begins with is told downwards, and ranges number their
    entries.  A task holds a range, or the functions of `together` of them.  Null sizes are 0; null parts are one part.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(part).cast("string")), F.lit(""))  # pandas would make numbers beside a null inexact
    own = log.select(key.alias("part"), F.col("pos").cast("long").alias("pos"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size"))
    kind = log.schema[part].dataType.simpleString()
    ranged = cut(own.repartitionByRange("part", "pos").withColumn("range", F.spark_partition_id()))

    def tell(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos", kind="stable")
        s = seals_of(frame["size"].to_numpy(), most)
        return pd.DataFrame({"part": frame["part"].iloc[:1].tolist(), "level": [0], "no": [int(frame["range"].iloc[0])], "total": [s.total], "before": [s.before], "seals": [s.seals], "held": [s.held]})

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("no")
        s = joined_seals([_seals(r) for r in frame.itertuples()], most)
        first = frame.iloc[0]
        return pd.DataFrame({"part": [first["part"]], "level": [int(first["level"]) + 1], "no": [int(first["no"]) // together], "total": [s.total], "before": [s.before], "seals": [s.seals], "held": [s.held]})

    spans = ranged.groupBy("part").agg((F.min("range") < F.max("range")).alias("spans")).filter("spans").select(F.col("part").alias("_part"))  # two a range at most
    crossing = ranged.join(spans, F.col("part") == F.col("_part"), "left_semi")
    levels = [cut(crossing.groupBy("part", "range").applyInPandas(tell, _SEALS))]
    ranges = int(ranged.agg(F.coalesce(F.max("range"), F.lit(0)).alias("n")).first().n) + 1
    while ranges > 1:
        levels.append(cut(levels[-1].groupBy("part", F.floor(F.col("no") / together)).applyInPandas(join, _SEALS)))
        ranges = -(-ranges // together)

    def begin(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("no")
        number, held, out = int(frame["number"].iloc[0]), np.array([int(frame["carried"].iloc[0])]), []
        for r in frame.itertuples():
            out.append((r.part, r.no, number, int(held[0])))
            more, held = _seals(r).after(held, most)
            number += int(more[0])
        return pd.DataFrame(out, columns=["part", "no", "number", "carried"])

    state = levels[-1].select("part", "no", F.lit(0).cast("long").alias("number"), F.lit(0).cast("long").alias("carried"))
    for below in reversed(levels[:-1]):
        up = state.select(F.col("part").alias("_part"), F.col("no").alias("_up"), "number", "carried")
        met = below.join(up, (F.col("part") == F.col("_part")) & (F.floor(F.col("no") / together) == F.col("_up"))).drop("_part")
        state = cut(met.groupBy("part", "_up").applyInPandas(begin, "part string, no long, number long, carried long"))

    def number(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["part", "pos"], kind="stable")
        now, segment, held, out = None, 0, 0, []
        for own, n, first, carried in zip(frame["part"].tolist(), frame["size"].tolist(), frame["number"].tolist(), frame["carried"].tolist(), strict=True):
            if own != now:
                now, segment, held = own, first, carried
            if held >= most:
                segment, held = segment + 1, 0
            held += n
            out.append(segment)
        return pd.DataFrame({"part": frame["part"], "pos": frame["pos"], "segment": out})

    begun = state.select(F.col("part").alias("_part"), F.col("no").alias("_no"), "number", "carried")
    placed = ranged.join(begun, (F.col("part") == F.col("_part")) & (F.col("range") == F.col("_no")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("number", "carried")]
    return placed.select("part", "pos", "size", "range", *zero).groupBy("range").applyInPandas(number, "part string, pos long, segment long").withColumn("part", F.when(F.col("part") != "", F.expr("substr(part, 2)")).cast(kind))


def longest_of_overlapping(segments: DataFrame, part: str) -> DataFrame:
    """Of each cluster of overlapping segments (id, first_pos, last_pos) the longest; ties to the smaller id."""
    w = Window.partitionBy(part).orderBy("first_pos", "last_pos", "id")
    reach = F.max("last_pos").over(w.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(reach.isNull() | (F.col("first_pos") > reach), 1).otherwise(0)
    clusters = segments.withColumn("_b", begins).withColumn("cluster", F.sum("_b").over(w))
    best = F.max_by(F.struct("id", "first_pos", "last_pos"), F.struct((F.col("last_pos") - F.col("first_pos")).alias("n"), (-F.col("id")).alias("i"))).alias("s")
    return clusters.groupBy(part, "cluster").agg(best, F.count("*").alias("overlapping")).select(part, F.col("cluster").cast("long").alias("cluster"), "s.id", "s.first_pos", "s.last_pos", "overlapping")


def appended(batch: DataFrame, order: list[str], head: int) -> DataFrame:
    """A batch's entries with dense positions after head, in the batch's order.

    Entries are dealt out by ranges of the order; each range is numbered by itself, and
    only a count for each range is summed up, so no task holds the batch.
    """
    ranged = cut(batch.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    own = Window.partitionBy("_range").orderBy(*order)
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + head).alias("_before"))
    return ranged.withColumn("_at", F.row_number().over(own)).join(before, "_range").withColumn("pos", (F.col("_before") + F.col("_at")).cast("long")).drop("_range", "_at", "_before")


def maintenance_report(log: DataFrame, checkpoint: int, orphans: DataFrame) -> DataFrame:
    """What a maintenance cycle does: entries consumed after the checkpoint, where it advances to, and whether there are orphans to sweep."""
    new = log.agg(F.count_if(F.col("pos") > checkpoint).alias("entries_consumed"), F.greatest(F.max("pos"), F.lit(checkpoint)).alias("checkpoint"))
    swept = orphans.agg((F.count("*") > 0).alias("maintenance_done"))
    return new.withColumn("_k", F.lit(0)).join(swept.withColumn("_k", F.lit(0)), "_k").drop("_k")
