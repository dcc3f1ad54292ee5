"""Line dedup with a once-seen and a twice-seen Bloom filter.

Every line's key is hashed into two bit planes: positions hit by at least one
document and positions hit by at least two.  The planes are built per task,
shipped as short position lists, and merged per segment (once OR once, twice OR
twice OR (once AND once)), so no task holds more than a segment.  Only lines
all of whose positions are in the twice-seen plane are suspected; only those
are shuffled, where exact keys are counted by document and the first occurrence
is chosen.

The planes grow with the texts' bytes, from 8 MiB to 128 MiB (see plane_bits), which
bounds what is broadcast.  A plane that fills up lets more lines through to the exact
count and never changes the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import bloom
from lodestone.llm.shared import stored

SPACE = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()


def _keys_of(text: bytes | None, min_chars: int) -> dict[bytes, list[int]]:
    """Line numbers by key; the empty key and shorter ones than min_chars code points are left out."""
    keys: dict[bytes, list[int]] = {}
    for i, line in enumerate((text or b"").split(b"\n")):
        key = line_key(line)
        if key and (min_chars <= 1 or len(key.decode()) >= min_chars):
            keys.setdefault(key, []).append(i)
    return keys


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.large_binary()).to_pylist()


def _twice_seen(docs: DataFrame, bits: int, min_chars: int) -> np.ndarray:
    """The twice-seen plane over the lines of docs, each key once a document."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: list[int] = []
        for batch in batches:
            for text in _texts(batch):
                hashes.extend(map(xxhash.xxh3_64_intdigest, _keys_of(text, min_chars)))
                if len(hashes) >= bloom.FLUSH:
                    yield bloom.part(np.array(hashes, dtype=np.uint64), bits)
                    hashes = []
        if hashes:
            yield bloom.part(np.array(hashes, dtype=np.uint64), bits)

    return bloom.plane(docs.select("text").mapInArrow(parts, bloom.PARTS), bits, 2)


def plane_bits(text_bytes: int) -> int:
    """A power of two of about 16 bits for each 128 bytes of text, a long line, from 2**26 to 2**30."""
    return 1 << min(30, max(26, (text_bytes // 8).bit_length()))


def drop_repeated_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none", filter_bits: int | None = None) -> DataFrame:
    """Drops lines whose key is found in at least min_docs documents.

    A key is the line with `[\\x20\\x09-\\x0D]` stripped at both ends and A-Z
    lower-cased.  keep="none" drops such lines everywhere; keep="first" leaves
    the one with the smallest (doc_id, line number).

    Returns the columns of docs, with `text` rebuilt from the lines that stay,
    and `_n_lines`, `_n_dropped`.  Null and empty texts are one empty line and
    become empty texts.  Empty keys are never dropped.  Rows that repeat a
    doc_id count as one document, and each such row is returned.  A null doc_id
    is a document of its own kind, ordered before the others.  Other columns
    pass through whatever their names are, unless they begin with an underscore
    followed by one of this operator's names.  filter_bits is the size of a plane,
    by default plane_bits of all texts.
    """
    if min_docs < 2 or keep not in ("none", "first"):
        raise ValueError("min_docs must be at least 2, keep one of none, first")
    if filter_bits is None:
        filter_bits = plane_bits(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    if filter_bits & (filter_bits - 1) or not bloom.SEGMENT_BITS <= filter_bits <= 1 << 32:
        raise ValueError("filter_bits must be a power of two from 2**16 to 2**32")
    plane = docs.sparkSession.sparkContext.broadcast(_twice_seen(docs, filter_bits, min_chars))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = plane.value
        for batch in batches:
            rows, keys, lines = [], [], []
            for i, text in enumerate(_texts(batch)):
                if not (own := _keys_of(text, min_chars)):
                    continue
                hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, own), dtype=np.uint64, count=len(own))
                hit = bloom.hits(bits, hashes, filter_bits)
                if hit.any():
                    for (key, where), suspected in zip(own.items(), hit.tolist(), strict=True):
                        if suspected:
                            rows.append(i)
                            keys.append(key)
                            lines.append(where)
            at_rows = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("_id").take(at_rows), batch.column("_version").take(at_rows), pa.array(keys, pa.binary()), pa.array(lines, pa.list_(pa.int32()))], ["_id", "_version", "_key", "_at"])

    version = F.xxhash64("text")
    suspected = docs.select(F.col("doc_id").alias("_id"), version.alias("_version"), "text").mapInArrow(suspects, "_id bigint, _version bigint, _key binary, _at array<int>")
    repeated = suspected.groupBy("_key").agg(F.countDistinct(F.struct("_id")).alias("_docs"), F.min(F.struct("_id", F.col("_at")[0].alias("_line"))).alias("_first")).filter(F.col("_docs") >= min_docs)
    repeated = stored(repeated, "repeated")  # a table, so that the join below can split a line that very many documents hold
    found = suspected.join(repeated, "_key")
    if keep == "first":
        stays = F.col("_id").eqNullSafe(F.col("_first._id"))
        found = found.withColumn("_at", F.when(stays, F.filter("_at", lambda x: x != F.col("_first._line"))).otherwise(F.col("_at")))
    drops = found.groupBy("_id", "_version").agg(F.array_distinct(F.flatten(F.collect_list("_at"))).alias("_drop")).select(F.col("_id").alias("_drop_id"), F.col("_version").alias("_drop_version"), "_drop")
    keyed = docs.withColumn("_version", version)
    joined = keyed.join(drops, keyed["doc_id"].eqNullSafe(drops["_drop_id"]) & (keyed["_version"] == drops["_drop_version"]), "left").drop("_version", "_drop_id", "_drop_version")

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, dropped = [], [], []
            for text, drop in zip(_texts(batch), batch.column("_drop").to_pylist(), strict=True):
                lines = (text or b"").split(b"\n")
                gone = set(drop or ())
                total.append(len(lines))
                dropped.append(len(gone))
                texts.append(b"\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text or b"")
            columns = {n: batch.column(n) for n in batch.schema.names if n != "_drop"}
            columns["text"] = pa.array(texts, pa.binary()).cast(pa.string())
            columns |= {"_n_lines": pa.array(total, pa.int64()), "_n_dropped": pa.array(dropped, pa.int64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = docs.withColumns({"text": F.lit("").cast("string"), "_n_lines": F.lit(0).cast("long"), "_n_dropped": F.lit(0).cast("long")}).schema
    return joined.mapInArrow(rebuilt, schema)
