"""A store of payloads that streams fill: chunks in files, and manifests that say which files count."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from lodestone.operators.chunks import CHUNK_BYTES, CHUNKS, chunked, ranges
from lodestone.streaming.log import consume

#: Places of a batch's files: the query that wrote them, and the batch's number in it.
PLACES = "run string, batch bigint"
MANIFEST = "prefix string, hash string, len bigint, chunks bigint"


def _query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a streaming query has for as long as its checkpoint exists; another checkpoint has another, wherever it lies."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first().value)["id"]


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(f"{schema}, {PLACES}").option("basePath", path).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, {PLACES}")


def manifest(spark: SparkSession, store: str) -> DataFrame:
    """What is stored: hash, len, chunks, and the run and batch whose files hold it; one of them where several do."""
    every = _read(spark, f"{store}/manifest", MANIFEST)
    return every.groupBy("hash").agg(F.min(F.struct("run", "batch", "len", "chunks")).alias("m")).select("hash", "m.*")


def stored_chunks(spark: SparkSession, store: str) -> DataFrame:
    """The chunks of all payloads that a manifest names; files of a batch that didn't end are left alone."""
    return _read(spark, f"{store}/chunks", CHUNKS).join(manifest(spark, store).select("hash", "run", "batch"), ["hash", "run", "batch"]).drop("run", "batch")


def read_ranges(spark: SparkSession, store: str, wanted: DataFrame) -> DataFrame:
    """ranges() of a store; files are sorted by hash, so a reader passes over row groups of other hashes."""
    return ranges(stored_chunks(spark, store), wanted)


def store_stream(payloads: DataFrame, store: str, checkpoint: str, chunk_bytes: int = CHUNK_BYTES) -> StreamingQuery:
    """Stores a stream's payloads (data binary) by content, once each, in chunks below `store`.

    A batch writes its chunks, then its manifest, into folders named by its query's id and its
    number, so one that is applied again replaces itself and nothing else; a new checkpoint over an old
    store begins at batch 0 beside what is there.  A batch meets the hashes of manifests only of those of 256
    prefixes that its own hashes have.  Null payloads aren't stored.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        run = _query_id(spark, checkpoint)
        place = f"run={run}/batch={number}"
        new = batch.filter("data is not null").withColumn("hash", F.sha2("data", 256)).dropDuplicates(["hash"])
        new = new.withColumn("prefix", F.substring("hash", 1, 2))
        prefixes = [r.prefix for r in new.select("prefix").distinct().collect()]  # 256 at most
        known = _read(spark, f"{store}/manifest", MANIFEST).filter(F.col("prefix").isin(prefixes) & ~((F.col("run") == run) & (F.col("batch") == number)))
        fresh = new.join(known.select("hash"), "hash", "left_anti")
        chunked(fresh.select("data"), chunk_bytes).sortWithinPartitions("hash", "at").write.mode("overwrite").parquet(f"{store}/chunks/{place}")
        chunks = spark.read.schema(CHUNKS).parquet(f"{store}/chunks/{place}")
        told = chunks.groupBy("hash").agg(F.max("whole").alias("len"), F.count("*").alias("chunks"))
        told.select(F.substring("hash", 1, 2).alias("prefix"), "hash", "len", "chunks").sortWithinPartitions("prefix").write.mode("overwrite").parquet(f"{store}/manifest/{place}")

    return consume(payloads, apply, checkpoint)
