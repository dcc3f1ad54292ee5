"""Reads in flight: of the reads of a key one leads and fetches, the others wait in state and get its result."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "key string, id bigint, event string, result string"


class _Reads(StatefulProcessor):
    def __init__(self, patience_ms: int) -> None:
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.leader = handle.getValueState("leader", "id long, due long")
        self.waiting = handle.getMapState("waiting", "id long", "at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, ANN001
        for e in sorted(rows, key=lambda e: (e.at_ms, e.kind != "read", e.id)):
            leads = self.leader.get()[0] if self.leader.exists() else None
            if e.kind == "read" and leads is None:
                yield self._lead(key[0], e.id, e.at_ms)
            elif e.kind == "read" and e.id != leads and not self.waiting.containsKey((e.id,)):
                self.waiting.updateValue((e.id,), (e.at_ms,))
            elif e.kind == "done" and leads is not None:
                yield Row(key=key[0], id=leads, event="answer", result=e.result)
                for (waits,) in sorted(self.waiting.keys()):
                    yield Row(key=key[0], id=waits, event="answer", result=e.result)
                self._clear()
            elif e.kind == "failed" and e.id == leads:
                yield from self._pass_on(key[0], leads, e.at_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, ANN001
        if self.leader.exists():
            leads, due = self.leader.get()
            if due <= expiredTimerInfo.getExpiryTimeInMs():
                yield from self._pass_on(key[0], leads, timerValues.getCurrentWatermarkInMs())

    def _lead(self, key: str, id_: int, at: int) -> Row:
        self.leader.update((id_, at + self.patience))
        self.handle.registerTimer(at + self.patience)
        return Row(key=key, id=id_, event="lead", result=None)

    def _pass_on(self, key: str, leads: int, at: int) -> Iterator[Row]:
        """The leader has failed; the oldest of those that wait leads now."""
        yield Row(key=key, id=leads, event="failed", result=None)
        self.handle.deleteTimer(self.leader.get()[1])
        self.leader.clear()
        first = min(((at_, id_) for (id_,), (at_,) in self.waiting.iterator()), default=None)
        if first is not None:
            self.waiting.removeKey((first[1],))
            yield self._lead(key, first[1], at)

    def _clear(self) -> None:
        self.handle.deleteTimer(self.leader.get()[1])
        self.leader.clear()
        self.waiting.clear()

    def close(self) -> None:
        pass


def answered_reads(events: DataFrame, delay: str, patience_ms: int) -> DataFrame:
    """What becomes of reads: key, id, event (`lead`, `answer`, `failed`), result.

    events(key string, id bigint, at timestamp, kind, result string): a `read` by an id; `done` with the
    result of a key's read, which may be null: it isn't there; `failed` by the id that led.  A key's first read leads; those that come until it is
    `done` wait, and all are answered with its result.  If the leader fails, or hasn't answered
    patience_ms after it began, by event time, it is told as failed and the oldest read that waits leads.  Later reads
    begin anew.  A read that comes again while it waits or leads changes nothing, nor does the failure of one that no longer
    leads; a late result of one answers those that wait.  Rows with a null key, id, time or kind are left out.

    A batch's events of one key are taken in order of time, in memory, so sources bound what a batch holds;
    waiting reads are in the state store, which must be RocksDB
    (spark.sql.streaming.stateStore.providerClass).  Events later than `delay` are dropped, as by any watermark.
    """
    own = events.filter("key is not null and id is not null and at is not null and kind is not null").withWatermark("at", delay)
    keyed = own.select("key", F.col("id").cast("long").alias("id"), "at", F.unix_millis("at").alias("at_ms"), "kind", "result").groupBy("key")
    return keyed.transformWithState(_Reads(patience_ms), OUTPUT, "Append", "EventTime")
