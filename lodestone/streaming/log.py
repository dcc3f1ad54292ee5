"""The change log as a stream: the latest state of each key, kept up as entries arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.log import latest_state


def streamed_states(log: DataFrame) -> DataFrame:
    """latest_state of a stream; in update mode each batch tells the keys that changed."""
    return latest_state(log)


def consume(log: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Applies each batch of a log once it is read, from where the checkpoint stands, until there is no more.

    A batch is told by its number; `apply` may see a batch again after a failure and
    must give the same outcome then.
    """
    return log.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(state: DataFrame | None, batch: DataFrame) -> DataFrame:
    """State (key, op, pos, len) after a batch of entries: later positions win, whatever order they come in."""
    entries = batch.filter(F.col("op") != "constraint").select("key", "op", "pos", "len")
    return latest_state(entries if state is None else state.unionByName(entries))


def distinct_reads(reads: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """One read of each key among those within the delay: the others wait for the first."""
    return reads.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def sweeps(spark: SparkSession, sweep: Callable[[int], None], seconds: int, checkpoint: str) -> StreamingQuery:
    """Calls sweep, with the number of the tick, every so many seconds until the query is stopped; a tick waits for the one before."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda _, n: sweep(n)).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def log_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of parquet files as a growing log."""
    return spark.readStream.schema(schema).parquet(path)
