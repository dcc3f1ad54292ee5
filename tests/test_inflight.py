"""Reads that lead, wait, fail and come late."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.streaming import inflight

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def test_followers_get_the_leaders_result(spark, tmp_path):
    source = str(tmp_path / "events")
    batches = [
        [("k", 1, 0, "read", None), ("k", 2, 1, "read", None), ("k", 3, 2, "read", None), ("j", 9, 0, "read", None), ("m", 5, 0, "read", None), ("m", 6, 1, "read", None), (None, 7, 1, "read", None)],
        [("k", 2, 3, "read", None), ("k", 1, 4, "failed", None), ("k", 3, 4, "failed", None), ("j", 9, 4, "done", "J"), ("j", 8, 5, "read", None)],
        [("k", 2, 6, "done", "K"), ("k", 4, 7, "read", None), ("j", 8, 6, "done", None)],
        [("z", 1, 100, "read", None)],  # m's leader never answers; the watermark passes it
        [("m", 6, 101, "done", "M"), ("z", 1, 102, "done", "Z")],
    ]
    old = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = []
        for batch in batches:  # each run goes on from the state of the one before
            made = spark.createDataFrame(batch, "key string, id bigint, at int, kind string, result string").withColumn("at", F.timestamp_seconds(F.col("at") + 1000))
            made.coalesce(1).write.mode("append").parquet(source)
            events = spark.readStream.schema("key string, id bigint, at timestamp, kind string, result string").parquet(source)
            told = inflight.answered_reads(events, "2 seconds", 30_000)
            query = told.writeStream.foreachBatch(lambda df, n: got.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, old)
    of = lambda key: [g[1:] for g in got if g[0] == key]
    assert of("k") == [(1, "lead", None), (1, "failed", None), (2, "lead", None), (2, "answer", "K"), (3, "answer", "K"), (4, "lead", None), (4, "failed", None)]
    assert of("j") == [(9, "lead", None), (9, "answer", "J"), (8, "lead", None), (8, "answer", None)]
    assert of("m") == [(5, "lead", None), (5, "failed", None), (6, "lead", None), (6, "answer", "M")]
    assert of("z") == [(1, "lead", None), (1, "answer", "Z")] and of(None) == []
