"""Queries of the content store, its log and its retention rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import hashing
from lodestone.operators import log as wal
from lodestone.operators import chunks, objects, retention
from lodestone.plans.registry import Tables, query

_OPS = "CASE event_type WHEN 'view' THEN 'put' WHEN 'signup' THEN 'put' WHEN 'purchase' THEN 'put_large' WHEN 'click' THEN 'constraint' ELSE 'delete' END"
_LOG_SQL = f"log AS (SELECT event_id AS pos, user_id AS key, {_OPS} AS op, CAST(floor(value) AS BIGINT) AS len FROM events)"


def _log(t: Tables) -> DataFrame:
    return t.events.select(F.col("event_id").alias("pos"), F.col("user_id").alias("key"), F.expr(_OPS).alias("op"), F.floor("value").cast("long").alias("len"))


@query("SELECT sha256(text) AS hash, CAST(any_value(strlen(text)) AS BIGINT) AS len, count(*) AS n_refs, min(doc_id) AS doc_id, CASE WHEN any_value(strlen(text)) > 1048576 THEN 'PutLarge' ELSE 'Put' END AS tier FROM documents GROUP BY 1")
def cas_put_dedup(t: Tables) -> DataFrame:
    return objects.put(t.documents, "text", keep="doc_id")


@query("SELECT hash, found, len FROM (SELECT sha256(text) AS hash, true AS found, CAST(max(strlen(text)) AS BIGINT) AS len FROM documents WHERE doc_id % 7 = 0 GROUP BY 1 UNION ALL SELECT sha256(''), true, 0 UNION ALL SELECT sha256('none'), false, NULL)")
def cas_get(t: Tables) -> DataFrame:
    held = objects.put(t.documents, "text", keep="doc_id").select("hash", "len")
    wanted = t.documents.filter("doc_id % 7 = 0").select(hashing.content_hash(F.col("text")).alias("hash")).distinct()
    more = t.region.filter("r_regionkey < 2").select(F.when(F.col("r_regionkey") == 0, hashing.empty_hash()).otherwise(hashing.content_hash(F.lit("none"))).alias("hash"))
    return objects.get(held, wanted.union(more)).select("hash", "found", F.col("len").cast("long").alias("len"))


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def cas_delete_visibility(t: Tables) -> DataFrame:
    return objects.visible(t.documents.select("doc_id", "n_chars"), t.labels.filter("toxic = 1"), "doc_id")


@query(f"""WITH {_LOG_SQL}, p AS (SELECT key, arg_max(op, pos) AS op, arg_max(len, pos) AS len FROM log WHERE op <> 'constraint' GROUP BY key),
b AS (SELECT c_custkey AS key, CAST(floor(c_acctbal) AS BIGINT) AS len FROM customer WHERE c_custkey % 2 = 0),
o AS (SELECT c_custkey AS key, CAST(c_nationkey AS BIGINT) AS len FROM customer WHERE c_custkey % 3 = 0)
SELECT key, CASE WHEN p.op = 'delete' THEN 'tombstone' WHEN p.op IS NOT NULL THEN 'pending' WHEN b.len IS NOT NULL THEN 'base' ELSE 'orphan' END AS layer,
CASE WHEN p.op = 'delete' THEN NULL ELSE coalesce(p.len, b.len, o.len) END AS len FROM b FULL JOIN p USING (key) FULL JOIN o USING (key)""")
def cas_stat_layered(t: Tables) -> DataFrame:
    base = t.customer.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), F.floor("c_acctbal").cast("long").alias("len"))
    orphan = t.customer.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").cast("long").alias("len"))
    return objects.layered(base, wal.latest_state(_log(t)), orphan, "key")


_LIVE = "live AS (SELECT p_partkey AS hash FROM part WHERE p_size % 3 <> 0)"
_CONSTRAINTS = "c AS (SELECT DISTINCT l_partkey AS target, l_suppkey AS base FROM lineitem)"


def _live(t: Tables) -> DataFrame:
    return t.part.filter("p_size % 3 <> 0").select(F.col("p_partkey").alias("hash"))


def _constraints(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_partkey").alias("target"), F.col("l_suppkey").alias("base")).distinct()


@query(f"WITH {_LIVE}, {_CONSTRAINTS} SELECT target, base FROM c WHERE base IN (SELECT hash FROM live)")
def constraint_effective(t: Tables) -> DataFrame:
    return objects.effective_constraints(_constraints(t), _live(t)).select("target", "base")


@query(f"WITH {_LIVE}, {_CONSTRAINTS} SELECT target, base FROM c WHERE base IN (SELECT hash FROM live) AND target IN (SELECT hash FROM live)")
def constraint_prune(t: Tables) -> DataFrame:
    return objects.pruned_constraints(_constraints(t), _live(t)).select("target", "base")


@query(f"WITH {_LIVE}, {_CONSTRAINTS}, p AS (SELECT * FROM c WHERE base IN (SELECT hash FROM live) AND target IN (SELECT hash FROM live)) SELECT (SELECT count(DISTINCT target) FROM c) - (SELECT count(DISTINCT target) FROM p) AS pruned_targets")
def constraint_prune_report(t: Tables) -> DataFrame:
    return objects.prune_report(_constraints(t), objects.pruned_constraints(_constraints(t), _live(t)))


@query("""WITH o AS (SELECT l_orderkey AS target, list_sort(list_distinct(list(l_suppkey))) AS bases, list_distinct(list(l_partkey)) AS adds, list_distinct(list(CASE WHEN l_linenumber = 1 THEN l_suppkey END)) AS gone, l_orderkey % 5 = 0 AS clear FROM lineitem GROUP BY l_orderkey)
SELECT target, array_to_string(list_sort(list_distinct(list_filter(list_concat(CASE WHEN clear THEN [] ELSE bases END, adds), lambda x: NOT list_contains(gone, x)))), ',') AS bases FROM o""")
def constraint_patch(t: Tables) -> DataFrame:
    own = t.lineitem.groupBy(F.col("l_orderkey").alias("target")).agg(
        F.collect_set("l_suppkey").alias("bases"), F.collect_set("l_partkey").alias("adds"), F.collect_set(F.when(F.col("l_linenumber") == 1, F.col("l_suppkey"))).alias("gone")
    )
    return own.select("target", F.array_join(objects.patched(F.col("bases"), F.col("target") % 5 == 0, F.col("adds"), F.col("gone")).cast("array<string>"), ",").alias("bases"))


@query(f"WITH {_CONSTRAINTS} SELECT target, min(base) AS base FROM c GROUP BY target")
def best_base(t: Tables) -> DataFrame:
    return objects.best_bases(_constraints(t))


@query("SELECT CAST(p_partkey // 2 AS BIGINT) AS base_hash, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS dependents FROM part WHERE p_partkey > 0 GROUP BY 1")
def dependents(t: Tables) -> DataFrame:
    own = t.part.select(F.col("p_partkey").alias("hash"), F.when(F.col("p_partkey") > 0, F.floor(F.col("p_partkey") / 2)).cast("long").alias("base_hash"))
    return objects.dependents(own).select("base_hash", F.array_join(F.col("dependents").cast("array<string>"), ",").alias("dependents"))


@query("SELECT a.doc_id AS target, b.doc_id AS base, CAST(strlen(a.text) AS BIGINT) AS target_len, CAST(abs(strlen(a.text) - strlen(b.text)) AS BIGINT) AS delta_len FROM documents a JOIN documents b ON b.doc_id = a.doc_id - 1 WHERE strlen(a.text) <= 16777216 AND abs(strlen(a.text) - strlen(b.text)) < strlen(a.text)")
def delta_optimise(t: Tables) -> DataFrame:
    own = t.documents.select(F.col("doc_id").alias("target"), F.octet_length("text").cast("long").alias("target_len"))
    base = own.select(F.col("target").alias("base"), F.col("target_len").alias("base_len"))
    pairs = own.join(base, F.col("base") == F.col("target") - 1).select("target", "base", "target_len", F.abs(F.col("target_len") - F.col("base_len")).alias("delta_len"))
    return objects.delta_savings(pairs)


@query("WITH s AS (SELECT sum(len) AS b FROM (SELECT max(strlen(text)) AS len FROM documents GROUP BY sha256(text))) SELECT CAST(b AS BIGINT) AS store_bytes, CAST(greatest(1, floor(b * 0.1)) AS BIGINT) AS budget FROM s")
def store_budget(t: Tables) -> DataFrame:
    return objects.store_budget(objects.put(t.documents, "text", keep="doc_id"))


@query("""WITH r AS (SELECT user_id AS key, event_type = 'view' AS hit, CAST(floor(value) AS BIGINT) AS len FROM events),
e AS (SELECT key, max(len) AS len FROM r WHERE NOT hit GROUP BY key)
SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, (SELECT count(*) FROM e) AS entries, (SELECT CAST(sum(len) AS BIGINT) FROM e) AS bytes FROM r""")
def cache_stats(t: Tables) -> DataFrame:
    return objects.cache_stats(t.events.select(F.col("user_id").alias("key"), (F.col("event_type") == "view").alias("hit"), F.floor("value").cast("long").alias("len")))


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE r > greatest(1, floor(n / 2))")
def evict_oldest_half(t: Tables) -> DataFrame:
    return objects.after_eviction(t.documents.select("source", "doc_id", "n_chars"), "source", ["n_chars", "doc_id"]).select("source", "doc_id")


@query("SELECT doc_id, n_chars AS len FROM documents WHERE n_chars <= 2000")
def cache_admission(t: Tables) -> DataFrame:
    return objects.admitted(t.documents.select("doc_id", F.col("n_chars").alias("len")), 8000)


@query("""WITH r AS (SELECT event_id, user_id, CAST(floor(value / 10) AS BIGINT) AS mtime, event_id % 100 AS age FROM events),
f AS (SELECT *, coalesce(lag(mtime) OVER w <> mtime, true) AS modified, age >= 90 AS stale, (row_number() OVER w - 1) % 4 = 0 AS sampled FROM r WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, modified, stale, sampled, modified OR stale OR sampled AS verifies FROM f""")
def verify_on_read(t: Tables) -> DataFrame:
    reads = t.events.select("event_id", "user_id", F.floor(F.col("value") / 10).cast("long").alias("mtime"), (F.col("event_id") % 100).alias("age"))
    return objects.verify_on_read(reads, "user_id", "event_id", "mtime", "age", 90, 4).select("event_id", "modified", "stale", "sampled", "verifies")


@query(f"WITH {_LOG_SQL} SELECT key, arg_max(op, pos) AS op, max(pos) AS pos, arg_max(len, pos) AS len FROM log WHERE op <> 'constraint' GROUP BY key")
def wal_latest_state(t: Tables) -> DataFrame:
    return wal.latest_state(_log(t))


@query(f"WITH {_LOG_SQL} SELECT * FROM (SELECT key, arg_max(op, pos) AS op, max(pos) AS pos, arg_max(len, pos) AS len FROM log WHERE op <> 'constraint' GROUP BY key) WHERE op <> 'delete'")
def wal_rebuild(t: Tables) -> DataFrame:
    return wal.rebuilt(_log(t))


@query(f"WITH {_LOG_SQL} SELECT key, max(pos) AS pos FROM log GROUP BY key HAVING arg_max(op, pos) = 'constraint'")
def wal_pending_constraint(t: Tables) -> DataFrame:
    return wal.pending_constraints(_log(t))


@query("""WITH i AS (SELECT l_partkey AS target, list_sort(list_distinct(list(l_suppkey) FILTER (l_linenumber = 1))) AS bases FROM lineitem GROUP BY 1), p AS (SELECT l_partkey AS target, list_sort(list_distinct(list(l_orderkey))) AS bases FROM lineitem WHERE l_linenumber = 2 GROUP BY 1)
SELECT target, array_to_string(CASE WHEN len(i.bases) > 0 THEN i.bases ELSE coalesce(p.bases, []) END, ',') AS bases FROM i FULL JOIN p USING (target)""")
def constraint_read_through(t: Tables) -> DataFrame:
    index = t.lineitem.groupBy(F.col("l_partkey").alias("target")).agg(F.array_sort(F.collect_set(F.when(F.col("l_linenumber") == 1, F.col("l_suppkey")))).alias("bases"))
    pending = t.lineitem.filter("l_linenumber = 2").groupBy(F.col("l_partkey").alias("target")).agg(F.array_sort(F.collect_set("l_orderkey")).alias("bases"))
    return wal.constraint_read_through(index, pending).select("target", F.array_join(F.col("bases").cast("array<string>"), ",").alias("bases"))


@query("SELECT event_id // 64 AS segment, min(event_id) AS first_pos, max(event_id) AS last_pos, count(*) AS entries FROM events GROUP BY 1")
def wal_segment_boundaries(t: Tables) -> DataFrame:
    return wal.segment_boundaries(_log(t).withColumn("segment", F.floor(F.col("pos") / 64).cast("long")), "segment")


@query(f"WITH {_LOG_SQL} SELECT pos, key, op, len FROM log WHERE pos BETWEEN 100 AND 700")
def wal_replay_range(t: Tables) -> DataFrame:
    return wal.replay(_log(t), 100, 700)


@query(f"WITH {_LOG_SQL} SELECT pos, key, op, len FROM log WHERE pos > 500")
def wal_trim(t: Tables) -> DataFrame:
    return wal.trimmed(_log(t), 500)


@query("SELECT event_id // 64 AS segment, count(*) FILTER (event_id <= 500) AS applied, count(*) FILTER (event_id > 500) AS to_apply, max(event_id) AS advance_to FROM events GROUP BY 1")
def wal_checkpoint_split(t: Tables) -> DataFrame:
    return wal.checkpoint_split(_log(t).withColumn("segment", F.floor(F.col("pos") / 64).cast("long")), "segment", 500)


@query("""WITH RECURSIVE e AS (SELECT user_id AS part, event_id AS pos, CAST(floor(value) AS BIGINT) AS size, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
f(part, pos, n, segment, held) AS (SELECT part, pos, n, CAST(0 AS BIGINT), size FROM e WHERE n = 1 UNION ALL
SELECT e.part, e.pos, e.n, CASE WHEN f.held >= 100 THEN f.segment + 1 ELSE f.segment END, CASE WHEN f.held >= 100 THEN e.size ELSE f.held + e.size END FROM f JOIN e ON e.part = f.part AND e.n = f.n + 1)
SELECT part, pos, segment FROM f""")
def wal_segment_sealing(t: Tables) -> DataFrame:
    return wal.sealed_segments(t.events.select("user_id", F.col("event_id").alias("pos"), F.floor("value").cast("long").alias("bytes")), "user_id", "bytes", 100)


@query("""WITH s AS (SELECT user_id AS part, event_id AS id, event_id AS first_pos, event_id + CAST(floor(value) AS BIGINT) * 20 AS last_pos FROM events),
b AS (SELECT *, CASE WHEN max(last_pos) OVER (PARTITION BY part ORDER BY first_pos, last_pos, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= first_pos THEN 0 ELSE 1 END AS begins FROM s),
c AS (SELECT *, sum(begins) OVER (PARTITION BY part ORDER BY first_pos, last_pos, id) AS cluster FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY part, cluster ORDER BY last_pos - first_pos DESC, id) AS r, count(*) OVER (PARTITION BY part, cluster) AS overlapping FROM c)
SELECT part, CAST(cluster AS BIGINT) AS cluster, id, first_pos, last_pos, overlapping FROM r WHERE r = 1""")
def wal_overlap_resolution(t: Tables) -> DataFrame:
    segments = t.events.select(F.col("user_id").alias("part"), F.col("event_id").alias("id"), F.col("event_id").alias("first_pos"), (F.col("event_id") + F.floor("value").cast("long") * 20).alias("last_pos"))
    return wal.longest_of_overlapping(segments, "part")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def gc_orphans(t: Tables) -> DataFrame:
    return retention.orphans(t.part.select("p_partkey"), t.lineitem.filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


@query("""SELECT c_custkey, CASE WHEN r THEN 99999 ELSE tm END AS last_referenced_at FROM (
SELECT c_custkey, CAST(c_custkey * 7 % 1000 AS BIGINT) AS tm, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS r FROM customer) WHERE r OR tm + 200 >= 900""")
def gc_ttl(t: Tables) -> DataFrame:
    own = t.customer.select("c_custkey", (F.col("c_custkey") * 7 % 1000).alias("last_referenced_at"))
    return retention.collect_instances(own, t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", 900, 200, 99999)


_INDEX = "i AS (SELECT event_type AS domain, event_id AS key, sha256(CAST(user_id AS VARCHAR)) AS hash, CAST(floor(value * 10) AS BIGINT) AS last_access FROM events)"


@query(f"WITH {_INDEX}, x AS (SELECT * FROM i WHERE last_access <= 1000 - 300) SELECT DISTINCT hash FROM x WHERE hash NOT IN (SELECT hash FROM i WHERE last_access > 1000 - 300)")
def cache_prune_shared(t: Tables) -> DataFrame:
    index = t.events.select(F.col("event_type").alias("domain"), F.col("event_id").alias("key"), hashing.content_hash(F.col("user_id").cast("string")).alias("hash"), F.floor(F.col("value") * 10).cast("long").alias("last_access"))
    return retention.removable_payloads(index, retention.expired_cache(index, 1000, 300))


@query("SELECT event_type AS domain, count(*) AS entries, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS bytes FROM events GROUP BY 1")
def cache_status(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("event_type").alias("domain")).agg(F.count("*").alias("entries"), F.sum(F.floor("value").cast("long")).alias("bytes"))


def _seconds(c: str) -> Column:
    """A time as whole seconds, rounded half to even as the SQL's cast does; unix_timestamp() cuts."""
    return F.rint(F.unix_micros(F.col(c).cast("timestamp")) / F.lit(1e6)).cast("long")


@query("SELECT event_id AS id, coalesce(tm - lag(tm) OVER (PARTITION BY event_type ORDER BY tm, event_id) >= 3600, true) AS runs FROM (SELECT event_id, event_type, CAST(epoch(ts) AS BIGINT) AS tm FROM events)")
def cache_prune_throttle(t: Tables) -> DataFrame:
    calls = t.events.select(F.col("event_id").alias("id"), "event_type", _seconds("ts").alias("at"))
    return retention.prune_runs(calls, "event_type", "at", 3600).select("id", "runs")


@query("""SELECT event_id AS id, coalesce(lag(v) OVER w <> v OR tm - lag(tm) OVER w >= 300, true) AS written FROM (SELECT event_id, user_id, event_type AS v, CAST(epoch(ts) AS BIGINT) AS tm FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY tm, event_id)""")
def cache_touch_throttle(t: Tables) -> DataFrame:
    own = t.events.select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("v"), _seconds("ts").alias("at"))
    return retention.touches(own, ["user_id"], "at", "v").select("id", "written")


@query("SELECT event_id, (m < 0) OR (1000 - f <= m) AS fresh FROM (SELECT event_id, CAST(floor(value * 10) AS BIGINT) AS f, user_id % 800 - 100 AS m FROM events)")
def cache_freshness(t: Tables) -> DataFrame:
    return t.events.select("event_id", retention.is_fresh(F.floor(F.col("value") * 10).cast("long"), F.lit(1000), F.col("user_id") % 800 - 100).alias("fresh"))


@query("SELECT event_id FROM events WHERE 1000 - CAST(floor(value * 10) AS BIGINT) <= 400")
def metadata_ttl(t: Tables) -> DataFrame:
    return retention.within_ttl(t.events.select("event_id", F.floor(F.col("value") * 10).cast("long").alias("at")), "at", 1000, 400).select("event_id")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 1)")
def provision_retain(t: Tables) -> DataFrame:
    return retention.retained(t.supplier.select("s_suppkey", "s_name"), t.lineitem.filter("l_quantity = 1").select(F.col("l_suppkey").alias("s_suppkey")), "s_suppkey")


@query("SELECT count(DISTINCT o_custkey) AS new_n FROM orders WHERE o_orderstatus = 'O' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def new_instance_count(t: Tables) -> DataFrame:
    return retention.new_rows(t.orders.filter("o_orderstatus = 'P'"), t.orders.filter("o_orderstatus = 'O'"), "o_custkey")


@query("""WITH d AS (SELECT DISTINCT hex(encode(text)) AS x, sha256(text) AS hash, strlen(text) AS n FROM documents WHERE text IS NOT NULL),
c AS (SELECT *, greatest(k * 64, 100) AS a, least(k * 64 + 64, 250, n) AS stop FROM d, LATERAL (SELECT unnest(range(1, 4)) AS k) s)
SELECT hash, CAST(a AS BIGINT) AS "at", substr(x, CAST(2 * a + 1 AS BIGINT), CAST(2 * (stop - a) AS BIGINT)) AS part FROM c WHERE stop > a""")
def ranged_read(t: Tables) -> DataFrame:
    """150 bytes of each text from byte 100 on, from chunks of 64."""
    texts = t.documents.filter("text is not null").select("text").distinct()
    parts = chunks.chunked(texts.select(F.col("text").alias("data")), 64)
    wanted = texts.select(hashing.content_hash(F.col("text")).alias("hash"), F.lit(100).cast("long").alias("start"), F.lit(150).cast("long").alias("length"))
    return chunks.ranges(parts, wanted).select("hash", "at", F.hex("bytes").alias("part"))
