"""Merkle manifests of tables: a root over all rows, and for each row the proof that leads to it.

Rows become leaves, which are numbered within their group in order.  A superblock is
the fanout**levels leaves whose numbers share their upper digits; one applyInPandas call
takes a superblock up all its levels, so a task holds no more than that many digests.
The superblocks' roots are numbered already and are reduced in the same way, until each
group has one; the groups' roots, in order, are one more such tree.  A row's proof is its
superblock's part and, joined to it, that of the block above, and so on: only the first
of these joins has as many rows as the table, and texts never travel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import stored

#: A step up: where the node stands in its run, and the digests of the run's other nodes, from left to right.
PROOF = "array<struct<at: int, others: array<binary>>>"


def leaf(fields: list[Column]) -> Column:
    """SHA-256 of fields as lowercase hex; a field is its UTF-8 byte count, a colon and its text, or `-` for null."""

    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(part, fields)).cast("binary"), 256)


def parent(digests: list[bytes]) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def climbed(nodes: list[bytes], fanout: int, levels: int) -> tuple[list[list[tuple[int, list[bytes]]]], list[bytes]]:
    """Each node's steps up the given levels, and the nodes there."""
    proofs: list[list[tuple[int, list[bytes]]]] = [[] for _ in nodes]
    width = 1
    for _ in range(levels):
        for i, proof in enumerate(proofs):
            at = i // width
            first = at - at % fanout
            proof.append((at - first, nodes[first:at] + nodes[at + 1 : first + fanout]))
        nodes = [parent(nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        width *= fanout
    return proofs, nodes


def height(count: int, fanout: int) -> int:
    """Levels between that many nodes and a single one."""
    levels, width = 0, 1
    while width < count:
        levels, width = levels + 1, width * fanout
    return levels


def _reduced(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Steps of nodes (key, i, digest, n: nodes of the key) up to `levels` levels, as rows key, i, block, proof, root.

    root is the digest that the node's superblock has come to, and block its number.
    """
    block = fanout**levels

    def up(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("i", kind="stable")
        proofs, top = climbed(list(part["digest"]), fanout, min(levels, height(int(part["n"].iloc[0]), fanout)))
        steps = [[{"at": at, "others": others} for at, others in proof] for proof in proofs]
        return pd.DataFrame({"key": part["key"], "i": part["i"], "block": part["i"] // block, "proof": steps, "root": [top[0]] * len(part)})

    return nodes.withColumn("block", F.floor(F.col("i") / block)).groupBy("key", "block").applyInPandas(up, f"key string, i bigint, block bigint, proof {PROOF}, root binary")


def _proved(nodes: DataFrame, most: int, fanout: int, levels: int) -> tuple[DataFrame, list[DataFrame]]:
    """For nodes (key, i, digest, n), of which a key has at most `most`: key, i, proof, root of the key; and tables to discard."""
    steps = stored(_reduced(nodes, fanout, levels), "blocks")
    if most <= fanout**levels:
        return steps.select("key", "i", "proof", "root"), [steps]
    above = steps.groupBy("key", "block").agg(F.first("root").alias("digest"))
    count = nodes.select("key", F.ceil(F.col("n") / fanout**levels).alias("n")).distinct()
    upper, held = _proved(above.join(count, "key").select("key", F.col("block").alias("i"), "digest", "n"), -(-most // fanout**levels), fanout, levels)
    upper = upper.select("key", F.col("i").alias("block"), F.col("proof").alias("upper"), F.col("root").alias("top"))
    return steps.join(upper, ["key", "block"]).select("key", "i", F.concat("proof", "upper").alias("proof"), F.col("top").alias("root")), [steps, *held]


def _numbered(rows: DataFrame, order: list[Column], carried: list[str]) -> tuple[DataFrame, int]:
    """key and the carried columns with i, the place within its key in order, and n, the rows of the key; and the largest n."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.col("key").asc()
    ranged = rows.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order)
    table = stored(ranged.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"), "key", *carried), "ordered")
    runs = table.groupBy("key", "part").agg(F.min("row").alias("first"), F.count("*").alias("rows"))  # parts + keys rows at most
    by_key = Window.partitionBy("key")
    runs = stored(runs.select("key", "part", "first", F.sum("rows").over(by_key.orderBy("part")).alias("upto"), "rows", F.sum("rows").over(by_key).alias("n")), "runs")
    most = runs.agg(F.max("n").alias("n")).first().n or 0
    i = F.col("row") - F.col("first") + F.col("upto") - F.col("rows")
    return table.join(runs, ["key", "part"]).select("key", i.alias("i"), "n", *carried), most


def merkle_manifest(rows: DataFrame, leaf_of: Column, group: Column, order: list[Column], fanout: int = 2, levels: int = 10, keep: tuple[str, ...] = ()) -> DataFrame:
    """The Merkle tree of rows: a tree for each group over its leaves in order, and one over the groups' roots.

    leaf_of is a digest as 64 hex digits (see leaf()).  While a tree has several nodes on a level,
    each `fanout` consecutive ones, the last run perhaps fewer or one alone, become one:
    SHA-256 of their hex digits.  A lone leaf is its group's root, a lone group's root the root.

    Returns a row per row: the columns named in keep, `leaf`, `subroot`, `root` as hex and `proof`, a list
    of steps from the leaf to the root (see PROOF; others are 32 bytes each).  Groups are ordered by
    their text, null first, and a null group is one of its own; rows by `order`, and equal ones by their leaf,
    so that rows which repeat each other make equal digests wherever they stand.  No rows give none.
    `levels` says how many levels a task collapses at once, on fanout**levels digests at most.
    """
    if fanout < 2 or levels < 1:
        raise ValueError("fanout must be at least 2, levels at least 1")
    text = group.cast("string")
    key = F.coalesce(F.concat(F.lit("="), text), F.lit(""))  # sorts as the group does, null first
    ranks = [c.alias(f"_order{j}") for j, c in enumerate(order)]
    kept = F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(True).alias("_")).alias("kept")
    leaves = stored(rows.select(key.alias("key"), *ranks, F.unhex(leaf_of).alias("digest"), kept), "leaves")
    by = [F.col(f"_order{j}").asc_nulls_first() for j in range(len(order))]
    numbered, most = _numbered(leaves, [*by, F.col("digest").asc()], ["digest", "kept"])
    proved, _ = _proved(numbered.select("key", "i", "digest", "n"), most, fanout, levels)
    proved = stored(proved, "proofs")
    roots = stored(proved.filter("i = 0").select("key", F.col("root").alias("digest")), "subroots")
    tops, n_keys = _numbered(roots.select(F.lit("").alias("key"), F.col("key").alias("name"), "digest"), [F.col("name").asc()], ["name", "digest"])
    tops = stored(tops, "tops")
    top, _ = _proved(tops.select("key", "i", "digest", "n"), n_keys, fanout, levels)
    top = tops.join(top, "i").select(F.col("name").alias("key"), F.col("proof").alias("upper"), F.col("root").alias("top"))
    out = numbered.drop("n").join(proved, ["key", "i"]).join(top, "key")
    return out.select(
        *[F.col("kept").getField(c).alias(c) for c in keep],
        F.lower(F.hex("digest")).alias("leaf"),
        F.lower(F.hex("root")).alias("subroot"),
        F.lower(F.hex("top")).alias("root"),
        F.concat("proof", "upper").alias("proof"),
    )


def with_folded_root(rows: DataFrame, leaf_column: str, proof_column: str = "proof", name: str = "folded_root") -> DataFrame:
    """rows with the root, as hex, that a leaf (64 hex digits) and its proof lead to; null for a null leaf or proof."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = []
            for node, proof in zip(batch.column(leaf_column).to_pylist(), batch.column(proof_column).to_pylist(), strict=True):
                if node is not None and proof is not None:
                    digest = bytes.fromhex(node)
                    for step in proof:
                        digest = parent([*step["others"][: step["at"]], digest, *step["others"][step["at"] :]])
                    node = digest.hex()
                tops.append(node if proof is not None else None)
            yield batch.append_column(name, pa.array(tops, pa.string()))

    return rows.mapInArrow(fold, rows.withColumn(name, F.lit(None).cast("string")).schema)


def others_digest(proof: str = "proof") -> Column:
    """SHA-256 of all digests of a proof as hex, from the leaf up, as lowercase hex."""
    hexed: Callable[[Column], Column] = lambda d: F.lower(F.hex(d))
    return F.sha2(F.array_join(F.flatten(F.transform(F.col(proof), lambda s: F.transform(s["others"], hexed))), "").cast("binary"), 256)
