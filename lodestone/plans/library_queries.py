"""Queries of a library's configuration, its files and its registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.hashing import content_hash
from lodestone.operators import library
from lodestone.plans.registry import Tables, query


def _str(c: str) -> F.Column:
    return F.col(c).cast("string")


_AVAIL = "a AS (SELECT DISTINCT p_brand AS owner, p_type AS variant FROM part UNION SELECT DISTINCT p_brand, 'default' FROM part WHERE p_brand < 'Brand#3')"
_SEL = "s AS (SELECT DISTINCT p_brand AS owner, i AS ord, ['PROMO', '^S.*', 'nothing', 'LARGE'][i + 1] AS selector, i = 1 AS regex FROM part, range(4) r(i))"


@query(f"""WITH {_AVAIL}, {_SEL}, f AS (SELECT s.owner, ord, variant FROM s JOIN a ON a.owner = s.owner AND CASE WHEN regex THEN regexp_matches(variant, selector) ELSE variant = trim(selector) END),
d AS (SELECT s.owner, s.ord, 'default' AS variant FROM s JOIN a ON a.owner = s.owner AND a.variant = 'default' WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.owner = s.owner AND f.ord = s.ord)),
m AS (SELECT owner, variant, min(ord) AS o FROM (SELECT * FROM f UNION ALL SELECT * FROM d) GROUP BY ALL)
SELECT owner, row_number() OVER (PARTITION BY owner ORDER BY o, variant) AS ord, variant FROM m""")
def variant_select(t: Tables) -> DataFrame:
    brands = t.part.select(F.col("p_brand").alias("owner")).distinct()
    available = t.part.select(F.col("p_brand").alias("owner"), F.col("p_type").alias("variant")).distinct().union(brands.filter("owner < 'Brand#3'").select("owner", F.lit("default")))
    wanted = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(s).alias("selector"), F.lit(i == 1).alias("regex")) for i, s in enumerate(["PROMO", "^S.*", "nothing", "LARGE"])])
    selectors = brands.select("owner", F.inline(wanted))
    return library.selected_variants(selectors, available)


def _entries(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_brand").alias("playlist"), F.col("p_partkey").alias("ord"), F.concat(F.lit("a&b "), "p_name").alias("id"), F.concat_ws("/", "p_type", "p_name").alias("path"))


_XML = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"
_ENTRY = "e AS (SELECT p_brand AS playlist, p_partkey AS ord, 'a&b ' || p_name AS id, p_type || '/' || p_name AS path, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)"
_NL = "chr(10)"


def _playlist_sql(head: str, line: str, tail: str) -> str:
    return f"WITH {_ENTRY} SELECT playlist, {head} || string_agg({line}, '' ORDER BY ord) || {tail} AS content FROM e GROUP BY playlist"


@query(_playlist_sql(f"'#EXTM3U' || {_NL}", f"'#EXTINF:-1,' || id || {_NL} || path || {_NL}", "''"))
def playlist_m3u8(t: Tables) -> DataFrame:
    return library.playlists(_entries(t), "m3u8")


@query(_playlist_sql(f"'[playlist]' || {_NL} || 'NumberOfEntries=' || count(*) || {_NL}", f"'File' || n || '=' || path || {_NL} || 'Title' || n || '=' || id || {_NL} || 'Length' || n || '=-1' || {_NL}", f"'Version=2' || {_NL}"))
def playlist_pls(t: Tables) -> DataFrame:
    return library.playlists(_entries(t), "pls")


@query(_playlist_sql(f"'<?xml version=\"1.0\" encoding=\"UTF-8\"?>' || {_NL} || '<playlist version=\"1\" xmlns=\"http://xspf.org/ns/0/\">' || {_NL} || '  <trackList>' || {_NL}", f"'   <track>' || {_NL} || '    <location>' || {_XML.format('path')} || '</location>' || {_NL} || '    <title>' || {_XML.format('id')} || '</title>' || {_NL} || '   </track>' || {_NL}", f"'  </trackList>' || {_NL} || '</playlist>' || {_NL}"))
def playlist_xspf(t: Tables) -> DataFrame:
    return library.playlists(_entries(t), "xspf")


@query(_playlist_sql(f"'<?wpl version=\"1.0\"?>' || {_NL} || '<smil>' || {_NL} || '  <head>' || {_NL} || '   <meta name=\"Generator\" content=\"lodestone\"/>' || {_NL} || '  </head>' || {_NL} || '  <body>' || {_NL} || '   <seq>' || {_NL}", f"'    <media src=\"' || {_XML.format('path')} || '\"/>' || {_NL}", f"'   </seq>' || {_NL} || '  </body>' || {_NL} || '</smil>' || {_NL}"))
def playlist_wpl(t: Tables) -> DataFrame:
    return library.playlists(_entries(t), "wpl")


@query(_playlist_sql(f"'<asx version=\"3.0\">' || {_NL}", f"' <entry>' || {_NL} || '  <ref href=\"' || {_XML.format('path')} || '\"/>' || {_NL} || '  <title>' || {_XML.format('id')} || '</title>' || {_NL} || ' </entry>' || {_NL}", f"'</asx>' || {_NL}"))
def playlist_asx(t: Tables) -> DataFrame:
    return library.playlists(_entries(t), "asx")


@query("""WITH m AS (SELECT o_custkey AS id, min(o_orderpriority) AS path, count(DISTINCT o_orderpriority) > 1 AS conflict FROM orders GROUP BY 1),
n AS (SELECT l_orderkey AS playlist, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS BIGINT) AS ord, l_partkey AS id FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem))
SELECT playlist, ord, id, path, conflict FROM n JOIN m USING (id)""")
def playlist_members(t: Tables) -> DataFrame:
    nodes = t.lineitem.groupBy(F.col("l_orderkey").alias("playlist")).agg(F.array_sort(F.collect_set(F.struct("l_linenumber", "l_partkey"))).alias("s")).select("playlist", F.transform("s", lambda x: x["l_partkey"]).alias("ids"))
    return library.playlist_members(nodes, t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("path")))


@query("""WITH r AS (SELECT c_mktsegment || '/' || c_nationkey || '/' || c_name AS path FROM customer), d AS (SELECT c_mktsegment || '/' || c_nationkey AS path FROM customer WHERE c_acctbal > 8500 UNION SELECT c_mktsegment || '/' || c_nationkey || '/' || c_name FROM customer WHERE c_custkey % 10 = 0)
SELECT path FROM r WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.path = r.path OR starts_with(r.path, d.path || '/'))""")
def stale_paths(t: Tables) -> DataFrame:
    folder = F.concat_ws("/", "c_mktsegment", _str("c_nationkey"))
    path = F.concat_ws("/", folder, "c_name")
    desired = t.customer.filter("c_acctbal > 8500").select(folder.alias("path")).union(t.customer.filter("c_custkey % 10 = 0").select(path)).distinct()
    return library.stale_paths(t.customer.select(path.alias("path")), desired)


@query("""WITH e AS (SELECT o_custkey AS path, o_orderpriority AS media, o_orderkey AS ord, CASE WHEN o_orderkey % 9 = 0 THEN [] WHEN o_orderkey % 2 = 0 THEN ['a', 'b'] WHEN o_orderkey % 3 = 0 THEN ['c'] ELSE ['b', 'd'] END AS variants FROM orders)
SELECT DISTINCT x.path, x.media, x.ord FROM e x JOIN e y ON x.path = y.path AND x.media = y.media AND y.ord < x.ord WHERE len(x.variants) = 0 OR len(y.variants) = 0 OR list_has_any(x.variants, y.variants)""")
def duplicate_paths(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    variants = F.when(k % 9 == 0, arr()).when(k % 2 == 0, arr("a", "b")).when(k % 3 == 0, arr("c")).otherwise(arr("b", "d"))
    return library.duplicate_paths(t.orders.select(F.col("o_custkey").alias("path"), F.col("o_orderpriority").alias("media"), k.alias("ord"), variants.alias("variants"))).select("path", "media", "ord")


@query("""WITH w AS (SELECT c_custkey AS media, v AS variant FROM customer, (VALUES ('video'), ('audio')) x(v)),
s AS (SELECT o_custkey AS media, CASE WHEN max(o_orderkey) % 3 = 0 THEN 'default' ELSE 'video' END AS variant, sha256(CAST(max(o_orderkey) AS VARCHAR)) AS hash FROM orders GROUP BY 1),
p AS (SELECT c_custkey AS media, 'audio' AS variant, sha256(c_name) AS hash FROM customer WHERE c_custkey % 4 = 0),
l AS (SELECT sha256(CAST(o_orderkey AS VARCHAR)) AS hash FROM orders WHERE o_orderstatus <> 'P')
SELECT w.media, w.variant, coalesce(e.hash, d.hash, p.hash) AS hash FROM w LEFT JOIN (SELECT * FROM s WHERE hash IN (SELECT hash FROM l)) e ON e.media = w.media AND e.variant = w.variant
LEFT JOIN (SELECT * FROM s WHERE hash IN (SELECT hash FROM l) AND variant = 'default') d ON d.media = w.media LEFT JOIN p ON p.media = w.media AND p.variant = w.variant""")
def variant_hash(t: Tables) -> DataFrame:
    wanted = t.customer.select(F.col("c_custkey").alias("media"), F.explode(F.array(F.lit("video"), F.lit("audio"))).alias("variant"))
    last = t.orders.groupBy(F.col("o_custkey").alias("media")).agg(F.max("o_orderkey").alias("k"))
    stored = last.select("media", F.when(F.col("k") % 3 == 0, "default").otherwise("video").alias("variant"), content_hash(_str("k")).alias("hash"))
    produced = t.customer.filter("c_custkey % 4 = 0").select(F.col("c_custkey").alias("media"), F.lit("audio").alias("variant"), content_hash(F.col("c_name")).alias("hash"))
    live = t.orders.filter("o_orderstatus <> 'P'").select(content_hash(_str("o_orderkey")).alias("hash"))
    return library.resolved_variants(wanted, stored, produced, live)


@query("SELECT l_orderkey AS media, l_shipmode AS variant, CAST(max(l_linenumber) AS INTEGER) AS ord FROM (SELECT l_orderkey, l_linenumber, l_returnflag || l_linestatus AS l_shipmode FROM lineitem) GROUP BY ALL")
def variant_producer(t: Tables) -> DataFrame:
    return library.producers(t.lineitem.select(F.col("l_orderkey").alias("media"), F.concat("l_returnflag", "l_linestatus").alias("variant"), F.col("l_linenumber").alias("ord")))


@query("""WITH s AS (SELECT o_orderkey AS media, 0 AS ord, CASE o_orderstatus WHEN 'F' THEN [] WHEN 'O' THEN ['in'] ELSE ['i1', 'i2'] END AS inputs, ['o1', 'o2'] AS outputs FROM orders)
SELECT media, ord, CASE len(inputs) WHEN 0 THEN outputs[i] WHEN 1 THEN inputs[1] ELSE inputs[i] END AS input, outputs[i] AS output FROM s, range(1, 3) r(i)""")
def variant_flow(t: Tables) -> DataFrame:
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    inputs = F.when(F.col("o_orderstatus") == "F", arr()).when(F.col("o_orderstatus") == "O", arr("in")).otherwise(arr("i1", "i2"))
    return library.step_flows(t.orders.select(F.col("o_orderkey").alias("media"), F.lit(0).alias("ord"), inputs.alias("inputs"), arr("o1", "o2").alias("outputs")))


_SRC = "s AS (SELECT DISTINCT o_custkey AS media, o_orderkey AS ord, o_orderstatus = 'F' AS ingest, o_orderpriority AS i, left(o_orderpriority, 1) AS o FROM orders)"


@query(f"""WITH {_SRC}, w AS (SELECT *, row_number() OVER (PARTITION BY media ORDER BY ord) AS n FROM s),
p AS (SELECT media, ord, CASE WHEN n = 1 AND NOT ingest THEN 'first step must ingest' WHEN n > 1 AND ingest THEN 'only the first step ingests' WHEN n > 1 AND NOT EXISTS (SELECT 1 FROM s b WHERE b.media = w.media AND b.ord < w.ord AND b.o = left(w.i, 1)) THEN 'unknown input' END AS problem FROM w)
SELECT * FROM p WHERE problem IS NOT NULL""")
def source_validation(t: Tables) -> DataFrame:
    first = F.substring("o_orderpriority", 1, 1)
    return library.invalid_sources(t.orders.select(F.col("o_custkey").alias("media"), F.col("o_orderkey").alias("ord"), (F.col("o_orderstatus") == "F").alias("ingest"), F.array(first).alias("inputs"), F.array(first).alias("outputs")))


@query("""WITH n AS (SELECT o_custkey AS node_id, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 2500 END AS media, o_orderkey % 2000 AS ref FROM orders)
SELECT 'duplicate id' AS problem, node_id AS subject, count(*) AS n FROM n GROUP BY node_id HAVING count(*) > 1
UNION ALL SELECT 'unknown media', media, count(*) FROM n WHERE media IS NOT NULL AND media NOT IN (SELECT c_custkey FROM customer) GROUP BY media
UNION ALL SELECT 'dangling reference', ref, count(*) FROM n WHERE ref NOT IN (SELECT node_id FROM n) GROUP BY ref""")
def hierarchy_validation(t: Tables) -> DataFrame:
    nodes = t.orders.select(F.col("o_custkey").alias("node_id"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderkey") % 2500).alias("media"), F.array(F.col("o_orderkey") % 2000).alias("refs"))
    return library.hierarchy_problems(nodes, t.customer.select(F.col("c_custkey").alias("media")))


@query("""SELECT kind, name, count(DISTINCT body) AS definitions, arg_min(document, ord) AS document FROM (SELECT 'tool' AS kind, s_nationkey AS name, s_name AS body, s_suppkey AS ord, 's' || s_suppkey AS document FROM supplier
UNION ALL SELECT 'workflow', c_nationkey, c_mktsegment, c_custkey, 'c' || c_custkey FROM customer) GROUP BY kind, name HAVING count(DISTINCT body) > 1""")
def merge_conflicts(t: Tables) -> DataFrame:
    tools = t.supplier.select(F.lit("tool").alias("kind"), F.col("s_nationkey").alias("name"), F.col("s_name").alias("body"), F.col("s_suppkey").alias("ord"), F.concat(F.lit("s"), _str("s_suppkey")).alias("document"))
    return library.merge_conflicts(tools.union(t.customer.select(F.lit("workflow"), "c_nationkey", "c_mktsegment", "c_custkey", F.concat(F.lit("c"), _str("c_custkey")))))


@query("SELECT sha256(p_brand) AS hash, string_agg(p_name || ' ' || p_type, '; ' ORDER BY p_name || ' ' || p_type) AS uses FROM part GROUP BY 1")
def usage_tracker(t: Tables) -> DataFrame:
    return library.usage(t.part.select(content_hash(F.col("p_brand")).alias("hash"), F.concat_ws(" ", "p_name", "p_type").alias("description")))


@query("SELECT DISTINCT sha256(x) AS hash FROM (SELECT p_brand AS x FROM part UNION ALL SELECT c_mktsegment FROM customer)")
def content_hashes(t: Tables) -> DataFrame:
    return t.part.select("p_brand").union(t.customer.select("c_mktsegment")).distinct().select(content_hash(F.col("p_brand")).alias("hash"))


@query("SELECT DISTINCT sha256(CAST(l_partkey AS VARCHAR)) AS hash FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def external_data_invariant(t: Tables) -> DataFrame:
    used = t.lineitem.select("l_partkey").distinct()
    return used.join(t.part.filter("p_size > 5").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_anti").select(content_hash(_str("l_partkey")).alias("hash"))


@query("SELECT p_brand AS media, string_agg(DISTINCT v, ',' ORDER BY v) AS variants FROM (SELECT p_brand, p_type AS v FROM part UNION ALL SELECT p_brand, 's' || p_size FROM part) GROUP BY 1")
def available_variants(t: Tables) -> DataFrame:
    own = t.part.groupBy(F.col("p_brand").alias("media")).agg(F.collect_set("p_type").alias("a"), F.collect_set(F.concat(F.lit("s"), _str("p_size"))).alias("b"))
    return own.select("media", F.array_join(F.array_sort(F.array_union("a", "b")), ",").alias("variants"))


@query("SELECT o_orderpriority AS run, count(*) FILTER (o_orderstatus = 'F') AS written, count(*) FILTER (o_orderstatus = 'O') AS skipped, count(*) FILTER (o_orderstatus = 'P') AS removed FROM orders GROUP BY 1")
def materialise_report(t: Tables) -> DataFrame:
    n = lambda s, name: F.count_if(F.col("o_orderstatus") == s).alias(name)
    return t.orders.groupBy(F.col("o_orderpriority").alias("run")).agg(n("F", "written"), n("O", "skipped"), n("P", "removed"))


@query("SELECT tool, version, deployed_at, ord FROM (SELECT o_custkey AS tool, o_orderpriority AS version, CAST(floor(o_totalprice / 50000) AS BIGINT) AS deployed_at, o_orderkey AS ord, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY floor(o_totalprice / 50000) DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def registry_dedup(t: Tables) -> DataFrame:
    own = t.orders.select(F.col("o_custkey").alias("tool"), F.col("o_orderpriority").alias("version"), F.floor(F.col("o_totalprice") / 50000).cast("long").alias("deployed_at"), F.col("o_orderkey").alias("ord"))
    return library.deduplicated_registry(own, ["tool", "version"])


@query("SELECT o_custkey AS tool, string_agg(o_orderpriority, ',' ORDER BY o_orderkey) AS versions FROM orders GROUP BY 1")
def registry_index(t: Tables) -> DataFrame:
    own = t.orders.groupBy(F.col("o_custkey").alias("tool")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("e"))
    return own.select("tool", F.array_join(F.transform("e", lambda x: x["o_orderpriority"]), ",").alias("versions"))


_DESIRED = "d AS (SELECT s_suppkey AS tool, 'v' || s_nationkey AS version FROM supplier WHERE s_suppkey % 4 <> 0), a AS (SELECT s_suppkey AS tool, 'v' || (s_nationkey - CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END) AS version FROM supplier WHERE s_suppkey % 5 <> 0)"


def _desired(t: Tables) -> DataFrame:
    return t.supplier.filter("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("tool"), F.concat(F.lit("v"), _str("s_nationkey")).alias("version"))


def _actual(t: Tables) -> DataFrame:
    return t.supplier.filter("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("tool"), F.concat(F.lit("v"), (F.col("s_nationkey") - F.when(F.col("s_suppkey") % 3 == 0, 1).otherwise(0)).cast("string")).alias("version"))


@query(f"WITH {_DESIRED} SELECT tool, CASE WHEN a.version IS NULL THEN 'add' WHEN d.version IS NULL THEN 'prune' WHEN a.version <> d.version THEN 'update' ELSE 'skip' END AS action FROM d FULL JOIN a USING (tool)")
def reconcile_registry(t: Tables) -> DataFrame:
    return library.reconciled(_desired(t), _actual(t))


@query(f"""WITH {_DESIRED} SELECT s_suppkey AS tool, CASE WHEN a.version IS NULL THEN true WHEN d.version IS NULL THEN false WHEN s_suppkey % 13 = 0 THEN true ELSE d.version <> a.version OR (s_suppkey % 7 <> 0 AND s_suppkey % 6 = 0) END AS requires
FROM supplier LEFT JOIN a ON a.tool = s_suppkey LEFT JOIN d ON d.tool = s_suppkey""")
def requires_sync(t: Tables) -> DataFrame:
    tools = t.supplier.select(F.col("s_suppkey").alias("tool"), (F.col("s_suppkey") % 7 == 0).alias("builtin"))
    registry = _actual(t).withColumn("content_hash", F.when(F.col("tool") % 6 > 0, "h"))
    return library.requires_sync(tools, registry, _desired(t).withColumn("error", F.col("tool") % 13 == 0))


@query("SELECT c_name AS workflow, c_mktsegment AS body FROM customer WHERE NOT starts_with(c_name, 'Customer#00000000') UNION ALL SELECT 'Customer#00000000' || s_name, 'managed' FROM supplier")
def managed_workflow_reconcile(t: Tables) -> DataFrame:
    managed = t.supplier.select(F.concat(F.lit("Customer#00000000"), "s_name").alias("workflow"), F.lit("managed").alias("body"))
    return library.replaced_managed(t.customer.select(F.col("c_name").alias("workflow"), F.col("c_mktsegment").alias("body")), managed, "workflow", "Customer#00000000")


@query("SELECT s_suppkey AS tool, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN s_name END, n_name) AS tag, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN 'x' END, CAST(n_regionkey AS VARCHAR)) AS vcs FROM supplier LEFT JOIN nation ON n_nationkey = s_suppkey")
def resolved_backfill(t: Tables) -> DataFrame:
    entries = t.supplier.select(F.col("s_suppkey").alias("tool"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("tag"), F.when(F.col("s_suppkey") % 3 == 0, "x").alias("vcs"))
    return library.backfilled(entries, t.nation.select(F.col("n_nationkey").cast("long").alias("tool"), F.col("n_name").alias("tag"), _str("n_regionkey").alias("vcs")), ["tool"], ["tag", "vcs"])


@query("SELECT p_partkey AS tool, concat_ws('+', p_brand, d) AS version FROM part LEFT JOIN (SELECT l_partkey, string_agg(DISTINCT 's' || l_suppkey || '=' || l_returnflag, '+' ORDER BY 's' || l_suppkey || '=' || l_returnflag) AS d FROM lineitem WHERE l_quantity > 40 GROUP BY 1) ON l_partkey = p_partkey")
def composite_version(t: Tables) -> DataFrame:
    deps = t.lineitem.filter("l_quantity > 40").select(F.col("l_partkey").alias("tool"), F.concat(F.lit("s"), _str("l_suppkey")).alias("dep"), F.col("l_returnflag").alias("dep_version"))
    return library.composite_versions(t.part.select(F.col("p_partkey").alias("tool"), F.col("p_brand").alias("version")), deps)


@query("SELECT c_custkey AS tool, 'deps/n' || c_nationkey || '/' || s_name AS key, sha256(s_name) AS hash FROM customer JOIN supplier ON s_nationkey = c_nationkey WHERE s_suppkey % 3 <> 0")
def dep_inlining(t: Tables) -> DataFrame:
    deps = t.customer.select(F.col("c_custkey").alias("tool"), F.concat(F.lit("n"), _str("c_nationkey")).alias("dep"))
    content = t.supplier.select(F.concat(F.lit("n"), _str("s_nationkey")).alias("tool"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("deps/"), "s_name")).otherwise(F.col("s_name")).alias("key"), content_hash(F.col("s_name")).alias("hash"))
    return library.inlined_content(deps, content)


@query("SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type")
def adjacent_dedup(t: Tables) -> DataFrame:
    return library.without_adjacent_repeats(t.events.select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")


@query("SELECT user_id, min(CASE WHEN value > 50 THEN event_id END) AS position FROM events GROUP BY 1")
def insert_position(t: Tables) -> DataFrame:
    return library.insert_position(t.events, "user_id", "event_id", "value", F.lit(50))


@query("SELECT conv_id, arg_min(w, turn) AS name, min(turn) AS ord FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN upper(role) ELSE role END AS w FROM conversations) GROUP BY conv_id, lower(w)")
def env_names_unique(t: Tables) -> DataFrame:
    own = t.conversations.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.upper("role")).otherwise(F.col("role")).alias("w"))
    return library.first_per_name(own, "conv_id", "w", "turn")


@query("""SELECT c_custkey AS id, o.c_acctbal AS retries, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_name END, c_mktsegment) AS path FROM customer LEFT JOIN (SELECT c_custkey AS k, c_acctbal FROM customer WHERE c_custkey % 3 = 0) o ON k = c_custkey""")
def runtime_merge(t: Tables) -> DataFrame:
    base = t.customer.select(F.col("c_custkey").alias("id"), F.lit(0.0).alias("retries"), F.col("c_mktsegment").alias("path"))
    over = t.customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal")).alias("retries"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("path"))
    return library.merged_settings(base, over, "id", ["retries"], ["path"])


@query("""WITH d AS (SELECT o_orderkey AS step, 'in' || (o_orderkey % 3) AS name, o_orderpriority AS value FROM orders), f AS (SELECT o_orderkey AS step, 'in' || i AS name, CASE WHEN i = 1 THEN NULL ELSE 'def' || i END AS value FROM orders, range(2) r(i))
SELECT step, name, coalesce(d.value, f.value, '') AS value FROM d FULL JOIN f USING (step, name)""")
def step_input_merge(t: Tables) -> DataFrame:
    declared = t.orders.select(F.col("o_orderkey").alias("step"), F.concat(F.lit("in"), (F.col("o_orderkey") % 3).cast("string")).alias("name"), F.col("o_orderpriority").alias("value"))
    defaults = t.orders.select(F.col("o_orderkey").alias("step"), F.inline(F.array(F.struct(F.lit("in0").alias("name"), F.lit("def0").alias("value")), F.struct(F.lit("in1").alias("name"), F.lit(None).cast("string").alias("value")))))
    return library.step_inputs(declared, defaults)


@query("SELECT user_id, arg_max(event_id, (coalesce(CASE WHEN event_id % 4 > 0 THEN floor(value) END, 0.0), -event_id)) AS id FROM events GROUP BY 1")
def acoustid_best(t: Tables) -> DataFrame:
    own = t.events.select("user_id", F.col("event_id").alias("id"), F.col("event_id").alias("ord"), F.when(F.col("event_id") % 4 > 0, F.floor("value").cast("double")).alias("score"))
    return library.best_match(own, "user_id")


@query("SELECT url, arg_min(provider, (priority, comment)) AS provider, min(comment) FILTER (priority = m) AS comment FROM (SELECT p_brand || '/' || p_size AS url, p_type AS provider, p_partkey % 3 AS priority, p_partkey AS comment, min(p_partkey % 3) OVER (PARTITION BY p_brand, p_size) AS m FROM part) GROUP BY url")
def cover_dedup(t: Tables) -> DataFrame:
    return library.covers(t.part.select(F.concat_ws("/", "p_brand", _str("p_size")).alias("url"), F.col("p_type").alias("provider"), (F.col("p_partkey") % 3).alias("priority"), F.col("p_partkey").alias("comment")))


@query("SELECT p_brand AS release, arg_min(p_name || p_partkey, (p_size <> 7, p_partkey)) AS url, count(*) AS images FROM part GROUP BY 1")
def cover_primary(t: Tables) -> DataFrame:
    return library.primary_cover(t.part.select(F.col("p_brand").alias("release"), F.concat("p_name", _str("p_partkey")).alias("url"), (F.col("p_size") == 7).alias("front"), F.col("p_partkey").alias("ord")), "release")


@query("""WITH k AS (SELECT n_regionkey AS tool, lower(n_name) AS near FROM nation),
u AS (SELECT DISTINCT n_regionkey AS tool, CASE n_nationkey % 3 WHEN 0 THEN lower(n_name) || '_version' WHEN 1 THEN substr(lower(n_name), 2) || 'x' ELSE reverse(lower(n_name)) END AS key FROM nation),
named AS (SELECT u.tool, key, near FROM u JOIN k ON k.tool = u.tool AND key = near || '_version'),
c AS (SELECT u.tool, key, near FROM u JOIN k USING (tool) ANTI JOIN named n ON n.tool = u.tool AND n.key = u.key),
t AS (SELECT tool, key, near, list_last(list_reduce(list_transform(range(1, length(key) + 1), lambda i: [CAST(i AS BIGINT)]),
  lambda row, i: list_reduce(list_transform(range(1, length(near) + 1), lambda j: [CAST(j AS BIGINT)]),
    lambda acc, j: list_append(acc, CASE WHEN substr(key, i[1], 1) = substr(near, j[1], 1) THEN row[j[1]] + 1 ELSE greatest(row[j[1] + 1], acc[j[1]]) END), [CAST(0 AS BIGINT)]),
  list_transform(range(length(near) + 1), lambda z: CAST(0 AS BIGINT)))) AS common FROM c),
r AS (SELECT tool, key, near, row_number() OVER (PARTITION BY tool, key ORDER BY 2 * common / (length(key) + length(near)) DESC, near DESC) AS rank FROM t WHERE 20 * common >= 6 * (length(key) + length(near)))
SELECT tool, key, near, rank FROM r WHERE rank <= 3 UNION ALL SELECT tool, key, near, 1 FROM named""")
def dependency_suggestion(t: Tables) -> DataFrame:
    name, kind = F.lower("n_name"), F.col("n_nationkey") % 3
    key = F.when(kind == 0, F.concat(name, F.lit("_version"))).when(kind == 1, F.concat(F.substr(name, F.lit(2)), F.lit("x"))).otherwise(F.reverse(name))
    return library.close_keys(t.nation.select(F.col("n_regionkey").alias("tool"), key.alias("key")), t.nation.select(F.col("n_regionkey").alias("tool"), name.alias("key")))
