"""What stays and what goes: garbage collection, time-to-live, throttling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def orphans(objects: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """Objects that no root refers to."""
    return objects.select(key).distinct().join(roots.select(key), key, "left_anti")


def collect_instances(instances: DataFrame, referenced: DataFrame, key: str, epoch: int, ttl: int, now: int) -> DataFrame:
    """Instances that a sweep keeps, with their time of last reference.

    A referenced one is kept and touched now; others stay while
    last_referenced_at + ttl >= epoch, where epoch is the time of the sweep before.
    """
    known = referenced.select(key).distinct().withColumn("_r", F.lit(True))
    swept = instances.join(known, key, "left")
    kept = swept.filter(F.col("_r").isNotNull() | (F.col("last_referenced_at") + ttl >= epoch))
    return kept.withColumn("last_referenced_at", F.when(F.col("_r").isNotNull(), F.lit(now)).otherwise(F.col("last_referenced_at")).cast("long")).drop("_r")


def expired_cache(index: DataFrame, now: Column | int, ttl: int) -> DataFrame:
    """Entries of an index (domain, key, hash, last_access) that expire: last access at or before now - ttl."""
    limit = (now if isinstance(now, Column) else F.lit(now)) - ttl
    return index.filter(F.col("last_access") <= limit)


def removable_payloads(index: DataFrame, expired: DataFrame) -> DataFrame:
    """Hashes of expired entries that no entry of any domain refers to any more."""
    kept = index.join(expired.select("domain", "key"), ["domain", "key"], "left_anti")
    return expired.select("hash").distinct().join(kept.select("hash"), "hash", "left_anti")


def prune_runs(calls: DataFrame, domain: str, at: str, least: int) -> DataFrame:
    """Whether each call to prune would run, `least` seconds after the call before it in its domain."""
    before = F.lag(at).over(Window.partitionBy(domain).orderBy(at, "id"))
    return calls.withColumn("runs", F.coalesce(F.col(at) - before >= least, F.lit(True)))


def touches(accesses: DataFrame, key: list[str], at: str, value: str, least: int = 300) -> DataFrame:
    """Whether each access is written: its hash changed, or `least` seconds have gone since the one before."""
    w = Window.partitionBy(*key).orderBy(at, "id")
    changed = F.lag(value).over(w) != F.col(value)
    return accesses.withColumn("written", F.coalesce(changed | (F.col(at) - F.lag(at).over(w) >= least), F.lit(True)))


def is_fresh(fetched: Column, now: Column, most: Column) -> Column:
    """A negative limit never expires."""
    return (most < 0) | (now - fetched <= most)


def within_ttl(entries: DataFrame, at: str, now: int, ttl: int = 86_400) -> DataFrame:
    return entries.filter(F.lit(now) - F.col(at) <= ttl)


def retained(entries: DataFrame, active: DataFrame, key: str) -> DataFrame:
    """Entries in the active set."""
    return entries.join(active.select(key).distinct(), key, "left_semi")


def new_rows(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """How many keys of after aren't in before."""
    return after.select(key).distinct().join(before.select(key), key, "left_anti").agg(F.count("*").alias("new_n"))
