"""Journal segments: framed entries, one after the other, of which the last may be torn."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Position, length and checksum before each payload.
_HEAD = "<qII"
_SIZE = struct.calcsize(_HEAD)


def encoded(entries: DataFrame, segment: str) -> DataFrame:
    """One binary per segment of entries (pos, payload), in the order of positions."""
    pack = lambda own: pd.DataFrame({"segment": own["segment"].iloc[:1], "data": [b"".join(struct.pack(_HEAD, p, len(x), zlib.crc32(x)) + x for p, x in own.sort_values("pos")[["pos", "payload"]].itertuples(index=False))]})
    own = entries.select(F.col(segment).cast("long").alias("segment"), F.col("pos").cast("long").alias("pos"), F.col("payload").cast("binary").alias("payload"))
    return own.groupBy("segment").applyInPandas(pack, "segment long, data binary")


def decoded(segments: DataFrame) -> DataFrame:
    """Entries of segments (segment, data): segment, pos, payload.  A torn or damaged entry ends its segment."""

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for segment, data in zip(frame["segment"], frame["data"], strict=True):
                at = 0
                while data is not None and at + _SIZE <= len(data):
                    pos, size, check = struct.unpack_from(_HEAD, data, at)
                    payload = bytes(data[at + _SIZE : at + _SIZE + size])
                    if len(payload) < size or zlib.crc32(payload) != check:
                        break
                    rows.append((segment, pos, payload))
                    at += _SIZE + size
            yield pd.DataFrame(rows, columns=["segment", "pos", "payload"])

    return segments.select("segment", "data").mapInPandas(unpack, "segment long, pos long, payload binary")


def envelope(base_hash: F.Column, length: F.Column, payload: F.Column) -> F.Column:
    """A delta's envelope: the base's digest, the content's length in 8 bytes, the payload."""
    return F.unhex(F.concat(base_hash, F.lpad(F.hex(length), 16, "0"), F.hex(payload)))


def opened(data: F.Column) -> F.Column:
    """base_hash, length and payload of an envelope; null if it is too short."""
    text = F.hex(data)
    parts = F.struct(
        F.lower(F.substring(text, 1, 64)).alias("base_hash"),
        F.conv(F.substring(text, 65, 16), 16, 10).cast("long").alias("length"),
        F.unhex(F.substr(text, F.lit(81))).alias("payload"),
    )
    return F.when(F.octet_length(data) >= 40, parts)


#: Fixed value: the version byte of a checkpoint.
CHECKPOINT_VERSION = "01"


def checkpoint(position: F.Column) -> F.Column:
    """A checkpoint: version, position in 8 bytes, and the checksum of both in 4."""
    head = F.concat(F.lit(CHECKPOINT_VERSION), F.lpad(F.hex(position), 16, "0"))
    return F.unhex(F.concat(head, F.lpad(F.hex(F.crc32(F.unhex(head))), 8, "0")))


def checkpoint_position(data: F.Column) -> F.Column:
    """The position of a checkpoint; null for one that is torn, damaged or of another version."""
    text = F.hex(data)
    whole = (F.octet_length(data) == 13) & text.startswith(CHECKPOINT_VERSION) & (F.lpad(F.hex(F.crc32(F.unhex(F.substring(text, 1, 18)))), 8, "0") == F.substring(text, 19, 8))
    return F.when(whole, F.conv(F.substring(text, 3, 16), 16, 10).cast("long"))
