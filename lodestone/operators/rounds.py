"""Rounds of joins: cutting lineage between them, and releasing what an earlier round kept."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def cut(df: DataFrame, *done: DataFrame) -> DataFrame:
    """df, computed once and told apart from its plan by a checkpoint; the tables in done, which it is made of, are no longer kept in memory.

    Checkpoints lie in the folder that spark.checkpoint.dir names; where it is unset and Spark is local, as in tests,
    in a temporary one that goes with the JVM.  A lost executor costs a round, not all before it.
    """
    _folder(df)
    kept = df.checkpoint()
    for old in done:
        old.unpersist()
    return kept


def stored(df: DataFrame, *done: DataFrame) -> DataFrame:
    """As cut, by a table written in that folder and read again.

    A checkpoint keeps its plan's estimated size, and a join's is the product of its sides', so a table that is joined with
    itself round by round has an estimate of twice as many digits each time, until planning takes longer than the work.
    What is read has the size of its files.
    """
    path = f"{_folder(df)}/{uuid.uuid4().hex}"
    with _without_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    for old in done:
        old.unpersist()
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


def removed(*tables: DataFrame) -> None:
    """Deletes the files of tables that stored() gave and that nothing reads any more; other tables are left alone."""
    for table in tables:
        if path := _PATHS.pop(table, None):
            own = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            own.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(own, True)


@contextmanager
def _without_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files: else they stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _folder(df: DataFrame) -> str:
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or f"file://{tempfile.gettempdir()}/checkpoints")
        if not folder:
            own = context._jvm.org.apache.hadoop.fs.Path(context.getCheckpointDir())
            own.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(own)
    return context.getCheckpointDir()


class Growing:
    """A table that grows by a part a round; parts are merged now and then, so that plans stay short."""

    def __init__(self, most: int = 16) -> None:
        self.parts: list[DataFrame] = []
        self.most = most

    def add(self, part: DataFrame) -> None:
        self.parts.append(part)
        if len(self.parts) == self.most:
            self.parts = [cut(reduce(DataFrame.union, self.parts))]

    def union(self, last: DataFrame) -> DataFrame:
        return reduce(DataFrame.union, [*self.parts, last])
