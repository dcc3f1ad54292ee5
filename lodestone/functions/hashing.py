"""Content hashes and the keys composed of them, as column expressions.

The hash is SHA-256 as lower-case hex, which sorts as its bytes do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALGORITHM = "sha256"
#: Multihash prefix for a 32-byte digest of this algorithm: code and length.
MULTIHASH_PREFIX = "1220"


def content_hash(data: Column) -> Column:
    """The hash of a string's UTF-8 bytes or of a binary."""
    return F.sha2(data.cast("binary"), 256)


def empty_hash() -> Column:
    """The hash of no bytes: an object that always exists and can't be deleted."""
    return content_hash(F.lit(""))


def composite_hash(hashes: Column) -> Column:
    """The hash of an array of hex hashes: of their raw digests, one after the other."""
    return F.sha2(F.unhex(F.array_join(hashes, "")), 256)


def hash_text(h: Column) -> Column:
    return F.concat(F.lit(f"{ALGORITHM}:"), h)


def parse_hash_text(text: Column) -> Column:
    """The hex digest of `algorithm:hex`, null if the text is anything else."""
    found = F.regexp_extract(text, f"^{ALGORITHM}:([0-9a-f]{{64}})$", 1)
    return F.when(found != "", found)


def is_digest(text: Column) -> Column:
    return text.rlike("^[0-9a-f]{64}$")


def multihash(h: Column) -> Column:
    """The 34 bytes of code, length and digest, as hex."""
    return F.concat(F.lit(MULTIHASH_PREFIX), h)


def parse_multihash(text: Column) -> Column:
    found = F.regexp_extract(text, f"^{MULTIHASH_PREFIX}([0-9a-f]{{64}})$", 1)
    return F.when(found != "", found)


def instance_key(domain: str, tool: Column, impure: Column, executed_at: Column, *inputs: Column) -> Column:
    """The key of a tool call: domain, tool, the time if impure, and arrays of input hashes in their order."""
    time = F.when(impure, F.array(content_hash(executed_at.cast("string")))).otherwise(F.array().cast("array<string>"))
    return composite_hash(F.concat(F.array(content_hash(F.lit(domain)), content_hash(tool)), time, *inputs))
