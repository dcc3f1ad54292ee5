"""Tables that an operator writes to the cluster's shared folder, to cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NULL_ID = -(2**63)
#: Ids below this stand for null doc_ids.
NULL_IDS_END = NULL_ID + 2**61


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one where it is unset and Spark is local, as in tests."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.gettempdir()}/checkpoints"
    return folder.rstrip("/")


_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df, written to the shared folder and read back; the files go with discard(), or when the driver's JVM ends.

    A reader that asks for one value of the column by opens only that value's files.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    table = spark.read.schema(schema).parquet(path)
    _PATHS[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that stored() gave and whose consumers have been written; other tables are left alone."""
    for table in tables:
        if path := _PATHS.pop(table, None):
            hadoop_path = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop_path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def fitted(sample: DataFrame, order: list[str], fit: Callable[[Iterator[pa.RecordBatch]], bytes]) -> bytes | None:
    """What fit makes of a sample of bounded size, sorted by order, in one executor task; None for no rows.

    Only the model, not the sample, comes to the driver, and a lost executor costs one more try.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (model := fit(batches)) is not None:
            yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    rows = sample.repartition(1).sortWithinPartitions(*order).mapInArrow(run, "model binary").collect()
    return bytes(rows[0].model) if rows else None


def row_id(doc_id: str = "doc_id", text: str = "text") -> Column:
    """doc_id, or for null a number below all ids that depends on the text alone."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID) + F.xxhash64(text).bitwiseAND(F.lit(2**61 - 1)))


def told_apart(docs: DataFrame) -> DataFrame:
    """docs with _id: ordered as doc_id is, nulls first, the same for rows of equal doc_id and text, and another for other rows.

    Where no doc_id has several texts, that is row_id(); else rows are numbered.
    """
    keyed = docs.withColumns({"_id": row_id(), "_version": F.xxhash64("text")})
    versions = keyed.groupBy("_id").agg((F.min("_version") != F.max("_version")).alias("several"))
    if not versions.agg(F.max("several").alias("several")).first().several:
        return keyed.drop("_version")
    texts = keyed.select(F.col("_id").alias("_row"), "_version").distinct().orderBy("_row", "_version")
    numbers = stored(texts.withColumn("_id", F.monotonically_increasing_id()), "numbers")
    return keyed.withColumnRenamed("_id", "_row").join(numbers, ["_row", "_version"]).drop("_row", "_version")
