"""From raw documents to packed training sequences, as stages of the operators in lodestone.llm.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor
kept; all but the last return the columns of docs.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.decontam import mark_contamination
from lodestone.llm.linededup import drop_repeated_lines
from lodestone.llm.minhash import near_duplicate_classes
from lodestone.llm.packing import added_tokens, pack_sequences
from lodestone.llm.shared import discard, stored, told_apart
from lodestone.llm.toxicity import score_toxicity, train_toxicity

TOXIC = 0.7
HELD_OUT = 3
MIN_DOCS = 10
SHINGLE, PERCENT = 5, 80
WINDOW = 10

#: No SQL: a classifier and a byte-level BPE are among the stages.
ORACLE_SQL = None


def _folded(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns in one struct, whose names can't clash with an operator's."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest, F.lit(True).alias("_")).alias("rest"))


def _unfolded(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, with n_chars of the text as it is now."""

    def column(c: str) -> F.Column:
        if c in ("doc_id", "text"):
            return F.col(c)
        if c == "n_chars":
            return F.length("text").cast(docs.schema[c].dataType).alias(c)
        return F.col("rest").getField(c).alias(c)

    return df.select(*map(column, docs.columns))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the limit; the model learns from the labelled documents among docs."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % HELD_OUT != 1)
    model = train_toxicity(docs, labels)
    return _unfolded(score_toxicity(_folded(docs), model).filter(F.col("_score") < TOXIC), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that at least MIN_DOCS of them share."""
    return _unfolded(drop_repeated_lines(_folded(docs), min_docs=MIN_DOCS), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of the smallest doc_id; of rows that repeat it and its text, one."""
    held = told_apart(_folded(docs))
    kept = near_duplicate_classes(held.select(F.col("_id").alias("doc_id"), "text"), shingle=SHINGLE, percent=PERCENT, apart=True).filter("kept").select("_id")
    return _unfolded(held.join(kept, "_id", "left_semi").dropDuplicates(["_id"]), docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _unfolded(mark_contamination(_folded(docs), items, window=WINDOW).filter(F.col("_n_hit") == 0), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids, packed into sequences: a row per piece."""
    specials = added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return pack_sequences(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, special_tokens=specials)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        read, docs = docs, stored(stage(spark, docs, sf_dir), name)
        discard(read)
    return STAGES[-1][1](spark, docs, sf_dir)
