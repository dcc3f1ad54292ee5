"""A content-addressed store as tables: objects, pending changes, constraints, and the caches over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.hashing import content_hash, empty_hash
from lodestone.operators.rounds import cut

INLINE_BYTES = 1 << 20
BUDGET_SHARE = 0.1


def put(data: DataFrame, payload: str, keep: str = "first_id") -> DataFrame:
    """Distinct payloads by hash: hash, len, n_refs, tier; the smallest `keep` refers to the first one.

    Hashes are formed before the shuffle, so payloads don't travel.
    """
    own = data.select(content_hash(F.col(payload)).alias("hash"), F.octet_length(payload).cast("long").alias("len"), F.col(keep))
    return own.groupBy("hash").agg(F.first("len").alias("len"), F.count("*").alias("n_refs"), F.min(keep).alias(keep)).withColumn("tier", F.when(F.col("len") > INLINE_BYTES, "PutLarge").otherwise("Put"))


def get(objects: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted hashes with their objects' columns; the empty object is always found, with length 0."""
    found = wanted.join(objects, "hash", "left")
    return found.withColumn("len", F.when(F.col("hash") == empty_hash(), 0).otherwise(F.col("len"))).withColumn("found", F.col("len").isNotNull())


def visible(objects: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    """Objects without a tombstone."""
    return objects.join(tombstones.select(key), key, "left_anti")


def layered(base: DataFrame, pending: DataFrame, orphans: DataFrame, key: str) -> DataFrame:
    """What a read sees: a pending tombstone hides everything, then come pending, base and orphaned objects.

    base(key, len), pending(key, op, len), orphans(key, len) hold a key once each.
    Returns key, layer, len.
    """
    b, p, o = (base.select(key, F.col("len").alias("b_len")), pending.select(key, F.col("op").alias("p_op"), F.col("len").alias("p_len")), orphans.select(key, F.col("len").alias("o_len")))
    all_ = b.join(p, key, "full").join(o, key, "full")
    layer = F.when(F.col("p_op") == "delete", "tombstone").when(F.col("p_op").isNotNull(), "pending").when(F.col("b_len").isNotNull(), "base").otherwise("orphan")
    size = F.when(F.col("p_op") == "delete", None).otherwise(F.coalesce("p_len", "b_len", "o_len"))
    return all_.select(key, layer.alias("layer"), size.cast("long").alias("len"))


def effective_constraints(constraints: DataFrame, live: DataFrame) -> DataFrame:
    """Constraints (target, base) whose base is live."""
    return constraints.join(live.select(F.col("hash").alias("base")), "base", "left_semi")


def pruned_constraints(constraints: DataFrame, live: DataFrame) -> DataFrame:
    """Constraints whose target and base are both live."""
    return effective_constraints(constraints, live).join(live.select(F.col("hash").alias("target")), "target", "left_semi")


def prune_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """How many targets went; narrowing a target's bases doesn't count."""
    counted = before.select("target").distinct().withColumn("n", F.lit(1)).union(after.select("target").distinct().withColumn("n", F.lit(-1)))
    return counted.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("pruned_targets"))


def patched(bases: Column, clear: Column, add: Column, remove: Column) -> Column:
    """A constraint's bases after a patch: cleared, added to, removed from; sorted and distinct."""
    start = F.when(clear, F.array().cast("array<bigint>")).otherwise(bases)
    return F.array_sort(F.array_except(F.array_union(start, add), remove))


def best_bases(constraints: DataFrame) -> DataFrame:
    """Each target's first base in order."""
    return constraints.groupBy("target").agg(F.min("base").alias("base"))


def dependents(objects: DataFrame) -> DataFrame:
    """base_hash with the sorted hashes that are stored as deltas against it."""
    return objects.filter("base_hash is not null").groupBy("base_hash").agg(F.array_sort(F.collect_set("hash")).alias("dependents"))


def delta_savings(pairs: DataFrame, most_bytes: int = 16 << 20) -> DataFrame:
    """Of (target, base, target_len, delta_len) the deltas worth keeping: smaller than their target, which isn't too long."""
    return pairs.filter((F.col("target_len") <= most_bytes) & (F.col("delta_len") < F.col("target_len")))


def store_budget(objects: DataFrame) -> DataFrame:
    """Bytes in the store and the cache budget, a tenth of them, one at least."""
    total = F.coalesce(F.sum("len"), F.lit(0))
    return objects.agg(total.alias("store_bytes")).withColumn("budget", F.greatest(F.lit(1), F.floor(F.col("store_bytes") * BUDGET_SHARE)).cast("long"))


def cache_stats(reads: DataFrame) -> DataFrame:
    """hits, misses, entries and bytes of reads (key, hit, len)."""
    missed = ~F.col("hit")
    by_key = reads.groupBy("key").agg(F.count_if("hit").alias("hits"), F.count_if(missed).alias("misses"), F.max(F.when(missed, F.col("len"))).alias("len"))
    return by_key.agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses"), F.count_if(F.col("misses") > 0).alias("entries"), F.sum("len").cast("long").alias("bytes"))


def after_eviction(entries: DataFrame, group: str, age: list[str]) -> DataFrame:
    """Entries that stay when each group drops its older half, one at least.

    Entries are dealt out by ranges of group and age, so a large group is many tasks' work: each range
    numbers its own, and counts by range say how many of a group come before.
    """
    ranged = cut(entries.repartitionByRange(group, *age).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy(F.col(group).alias("_group"), F.col("_range").alias("_r")).agg(F.count("*").alias("_rows"))
    of_group = Window.partitionBy("_group")
    before = F.coalesce(F.sum("_rows").over(of_group.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_group", "_r", before.alias("_before"), F.sum("_rows").over(of_group).alias("_n"))
    own = F.row_number().over(Window.partitionBy("_range", group).orderBy(*age))
    placed = ranged.withColumn("_at", own).join(counts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_r")))
    return placed.filter(F.col("_before") + F.col("_at") > F.greatest(F.lit(1), F.floor(F.col("_n") / 2))).select(*[F.col(f"`{c}`") for c in entries.columns])


def admitted(entries: DataFrame, budget: int) -> DataFrame:
    """Entries a cache of that budget takes: a quarter of it at most, none of an empty one."""
    return entries.filter(F.lit(budget != 0) & (F.col("len") <= budget // 4))


def verify_on_read(reads: DataFrame, key: str, order: str, mtime: str, age: str, stale_after: int, sample: int) -> DataFrame:
    """Which reads verify: the file changed since the last read, it is stale, or the counter says so.

    The counter runs over every read of a key, whatever other reasons there are.
    """
    w = Window.partitionBy(key).orderBy(order)
    modified = F.coalesce(F.lag(mtime).over(w) != F.col(mtime), F.lit(True))
    counted = (F.row_number().over(w) - 1) % sample == 0
    return reads.withColumns({"modified": modified, "stale": F.col(age) >= stale_after, "sampled": counted}).withColumn("verifies", F.col("modified") | F.col("stale") | F.col("sampled"))
