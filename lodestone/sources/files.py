"""Folders and documents as sources and sinks, through Spark's own readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from lodestone.functions.hashing import content_hash


def scan_folder(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder: path (relative), len, hash, bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    base = path if "://" in path or path.startswith("file:") else f"file:{path}"
    own = F.regexp_replace("path", "^[a-z]+:/*", "/")
    root = F.regexp_replace(F.lit(base.rstrip("/") + "/"), "^[a-z]+:/*", "/")
    return files.select(F.substr(own, F.length(root) + 1).alias("path"), F.col("length").alias("len"), content_hash(F.col("content")).alias("hash"), F.col("content").alias("bytes"))


def without(files: DataFrame, patterns: list[str]) -> DataFrame:
    """Files none of whose folders or names match a pattern, a regex for a whole name."""
    names = F.split("path", "/")
    return files.filter(~F.exists(names, lambda n: F.lit(False) if not patterns else n.rlike("^(?:" + "|".join(patterns) + ")$")))


def expected(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """Files whose hash is the expected one of their path."""
    return files.join(hashes.select("path", F.col("hash").alias("_e")), "path").filter(F.col("hash") == F.col("_e")).drop("_e")


def load_state(spark: SparkSession, path: str, schema: StructType, version: int, lines: bool = False) -> DataFrame:
    """JSON documents of one version, one a file or, as save_state writes them, one a line; fields that the schema doesn't name, and other versions, are errors."""
    rows = spark.read.schema(schema).option("multiLine", str(not lines)).option("mode", "FAILFAST").json(path)
    return rows.withColumn("version", F.when(F.col("version") == version, F.col("version")).otherwise(F.raise_error(F.concat(F.lit("unsupported version "), F.coalesce(F.col("version").cast("string"), F.lit("none"))))))


def save_state(state: DataFrame, path: str) -> None:
    state.write.mode("overwrite").json(path)


def write_texts(rows: DataFrame, path: str) -> None:
    """Texts as files: a folder `name=...` for each name, made where it isn't there."""
    rows.select("name", "text").write.mode("append").partitionBy("name").text(path)


def schema_contract(spark: SparkSession, schema: StructType) -> DataFrame:
    """A table's contract: a row for each field and each field inside it, with its path, type and whether it may be null."""

    def fields(schema: StructType, above: str) -> list[tuple[str, str, bool]]:
        out = []
        for f in schema.fields:
            kind, path = f.dataType, above + f.name
            out.append((path, kind.simpleString(), f.nullable))
            while isinstance(kind, (ArrayType, MapType)):
                kind, path = (kind.elementType, path + "[]") if isinstance(kind, ArrayType) else (kind.valueType, path + "{}")
            if isinstance(kind, StructType):
                out += fields(kind, path + ".")
        return out

    return spark.createDataFrame(fields(schema, ""), "path string, type string, nullable boolean")


def locator(text: F.Column) -> F.Column:
    """`memory` or a plain path; anything with a scheme is an error."""
    return F.when(F.trim(text) == "memory", "memory").when(text.contains("://"), F.raise_error(F.concat(F.lit("unsupported locator "), text))).otherwise(F.trim(text))


def materialise_method(capable: dict[str, F.Column], order: list[str]) -> tuple[F.Column, F.Column]:
    """The first method of the order that works, and whether it isn't the first one."""
    method = F.coalesce(*[F.when(capable[m], F.lit(m)) for m in order])
    return method, method != order[0]
