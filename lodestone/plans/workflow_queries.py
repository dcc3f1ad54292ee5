"""Queries of workflows, memoisation, trees and chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import hashing
from lodestone.operators import rounds, runs, tree, workflow
from lodestone.plans.registry import Tables, query


def _text(column: str) -> F.Column:
    return F.array_join(F.col(column).cast("array<string>"), ",").alias(column)


@query("""WITH RECURSIVE t(step, level) AS (SELECT p_partkey, CAST(0 AS BIGINT) FROM part WHERE p_partkey = 0 UNION ALL SELECT p.p_partkey, t.level + 1 FROM t JOIN part p ON p.p_partkey // 2 = t.step AND p.p_partkey > 0)
SELECT 0 AS wf, step, level FROM t""")
def dag_levels(t: Tables) -> DataFrame:
    steps = t.part.select(F.lit(0).alias("wf"), F.col("p_partkey").alias("step"))
    needs = t.part.filter("p_partkey > 0").select(F.lit(0).alias("wf"), F.col("p_partkey").alias("step"), F.floor(F.col("p_partkey") / 2).cast("long").alias("needs"))
    return workflow.topological_levels(steps, needs)


@query("""WITH RECURSIVE n AS (SELECT p_partkey // 10 AS wf, p_partkey % 10 AS step, CASE WHEN p_size % 7 = 0 THEN 100 + p_partkey % 10 WHEN p_size % 5 = 0 THEN (p_partkey + 3) % 10 WHEN p_partkey % 10 > 0 THEN p_partkey % 10 - 1 END AS needs FROM part),
w(wf, step, place, n) AS (SELECT wf, step, step, 0 FROM n UNION ALL SELECT w.wf, w.step, n.needs, w.n + 1 FROM w JOIN n ON n.wf = w.wf AND n.step = w.place WHERE n.needs IS NOT NULL AND w.n < 10),
r AS (SELECT w.wf, w.step, min(w.place) FILTER (w.n > 0) AS low, bool_or(w.n > 0 AND w.place = w.step) AS back, bool_or(n.step IS NOT NULL AND n.needs IS NULL) AS ends FROM w LEFT JOIN n ON n.wf = w.wf AND n.step = w.place GROUP BY 1, 2),
p AS (SELECT r.*, n.needs, n.needs IS NOT NULL AND NOT EXISTS (SELECT 1 FROM n m WHERE m.wf = n.wf AND m.step = n.needs) AS lost FROM r JOIN n USING (wf, step) WHERE NOT ends)
SELECT wf, step, CASE WHEN lost THEN 'unknown' WHEN back THEN 'cycle' ELSE 'behind' END AS problem, needs, CASE WHEN back THEN low END AS cycle FROM p""")
def dag_problems(t: Tables) -> DataFrame:
    """Workflows of ten steps, some of which need a step that doesn't exist or one after them."""
    own = F.col("p_partkey") % 10
    needs = F.when(F.col("p_size") % 7 == 0, own + 100).when(F.col("p_size") % 5 == 0, (F.col("p_partkey") + 3) % 10).when(own > 0, own - 1)
    rows = t.part.select(F.floor(F.col("p_partkey") / 10).cast("long").alias("wf"), own.alias("step"), needs.alias("needs"))
    return workflow.dependency_problems(rows.select("wf", "step"), rows)


_TEMPLATES = "tpl AS (SELECT l_orderkey AS wf, l_linenumber AS n, '${step_output.s' || (l_partkey % 5) || '.out' || (l_suppkey % 3) || CASE WHEN l_linenumber % 2 = 0 THEN ':zip(m' || (l_partkey % 4) || ')' ELSE '' END || '} and ${external_data.' || l_suppkey || '}' AS template FROM lineitem)"
_REFS = r"refs AS (SELECT wf, regexp_extract(template, '\$\{step_output\.([^.}]+)\.', 1) AS step, regexp_extract(template, '\$\{step_output\.[^.}]+\.([^}:]+)', 1) AS output, nullif(regexp_extract(template, ':zip\(([^)]+)\)', 1), '') AS member FROM tpl)"


def _templates(t: Tables) -> DataFrame:
    member = F.when(F.col("l_linenumber") % 2 == 0, F.format_string(":zip(m%d)", F.col("l_partkey") % 4)).otherwise("")
    return t.lineitem.select(F.col("l_orderkey").alias("wf"), F.format_string("${step_output.s%d.out%d%s} and ${external_data.%d}", F.col("l_partkey") % 5, F.col("l_suppkey") % 3, member, F.col("l_suppkey")).alias("template"))


def _steps(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("wf"), F.explode(F.array(*[F.lit(f"s{i}") for i in range(3)])).alias("step"))


_STEPS = "steps AS (SELECT o_orderkey AS wf, 's' || i AS step FROM orders, range(3) r(i))"


@query(f"WITH {_TEMPLATES}, {_REFS}, {_STEPS} SELECT s.wf, s.step, coalesce(string_agg(DISTINCT output, ',' ORDER BY output), '') AS outputs FROM steps s LEFT JOIN refs r ON r.wf = s.wf AND r.step = s.step GROUP BY s.wf, s.step")
def required_outputs(t: Tables) -> DataFrame:
    refs = workflow.step_references(_templates(t), "template")
    return workflow.required_outputs(_steps(t), refs).select("wf", "step", _text("outputs"))


@query(f"""WITH {_TEMPLATES}, {_REFS}, {_STEPS}, d AS (SELECT wf, step, output FROM refs UNION SELECT l_orderkey, 's0', 'declared' FROM lineitem WHERE l_linenumber = 3)
SELECT s.wf, s.step, coalesce(string_agg(DISTINCT output, ',' ORDER BY output), '') AS outputs FROM steps s LEFT JOIN d ON d.wf = s.wf AND d.step = s.step GROUP BY s.wf, s.step""")
def required_outputs_declared(t: Tables) -> DataFrame:
    refs = workflow.step_references(_templates(t), "template")
    declared = t.lineitem.filter("l_linenumber = 3").select(F.col("l_orderkey").alias("wf"), F.lit("s0").alias("step"), F.lit("declared").alias("output"))
    return workflow.required_outputs(_steps(t), refs, declared).select("wf", "step", _text("outputs"))


@query(f"WITH {_TEMPLATES}, {_REFS} SELECT wf, step, output, string_agg(DISTINCT member, ',' ORDER BY member) AS members FROM refs WHERE member IS NOT NULL GROUP BY ALL")
def required_zip_members(t: Tables) -> DataFrame:
    return workflow.required_members(workflow.step_references(_templates(t), "template")).select("wf", "step", "output", _text("members"))


@query(f"WITH {_TEMPLATES}, {_REFS} SELECT r.wf, r.step, r.output, r.member, CASE WHEN r.step = 's1' THEN sha256(r.output) END AS hash FROM refs r")
def step_output_join(t: Tables) -> DataFrame:
    refs = workflow.step_references(_templates(t), "template")
    outputs = t.orders.select(F.col("o_orderkey").alias("wf"), F.lit("s1").alias("step"), F.explode(F.array(*[F.lit(f"out{i}") for i in range(3)])).alias("output")).withColumn("hash", hashing.content_hash(F.col("output")))
    return workflow.resolved_references(refs, outputs).select("wf", "step", "output", "member", "hash")


@query("SELECT l_orderkey, l_linenumber, CAST(l_suppkey AS VARCHAR) AS ref, l_suppkey % 7 <> 0 AS declared FROM lineitem")
def external_data_join(t: Tables) -> DataFrame:
    own = t.lineitem.select("l_orderkey", "l_linenumber", F.format_string("x ${external_data.%d} y", F.col("l_suppkey")).alias("template"))
    refs = own.select("l_orderkey", "l_linenumber", F.explode(F.regexp_extract_all("template", F.lit(workflow.EXTERNAL_DATA), F.lit(1))).alias("ref"))
    declared = t.supplier.filter("s_suppkey % 7 <> 0").select(F.col("s_suppkey").cast("string").alias("ref"), F.lit(True).alias("d"))
    return refs.join(declared, "ref", "left").select("l_orderkey", "l_linenumber", "ref", F.coalesce("d", F.lit(False)).alias("declared"))


@query("""SELECT o_orderkey, sha256(unhex(sha256('tool-call') || sha256(o_orderpriority) || CASE WHEN o_orderstatus = 'O' THEN sha256(CAST(o_custkey AS VARCHAR)) ELSE '' END || coalesce(h, ''))) AS key
FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(sha256(CAST(l_partkey AS VARCHAR)), '' ORDER BY l_linenumber, sha256(CAST(l_partkey AS VARCHAR))) AS h FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def instance_key(t: Tables) -> DataFrame:
    inputs = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", hashing.content_hash(F.col("l_partkey").cast("string")).alias("h")))).alias("i"))
    own = t.orders.join(inputs, "o_orderkey", "left").withColumn("i", F.coalesce(F.transform("i", lambda x: x["h"]), F.array().cast("array<string>")))
    return own.select("o_orderkey", hashing.instance_key("tool-call", F.col("o_orderpriority"), F.col("o_orderstatus") == "O", F.col("o_custkey"), F.col("i")).alias("key"))


@query("SELECT h AS hash, 'sha256:' || h AS text, '1220' || h AS multihash, h AS parsed, h AS unpacked, true AS is_digest FROM (SELECT sha256(p_name) AS h FROM part)")
def hash_codecs(t: Tables) -> DataFrame:
    own = t.part.select(hashing.content_hash(F.col("p_name")).alias("hash"))
    own = own.withColumns({"text": hashing.hash_text(F.col("hash")), "multihash": hashing.multihash(F.col("hash"))})
    return own.withColumns({"parsed": hashing.parse_hash_text(F.col("text")), "unpacked": hashing.parse_multihash(F.col("multihash")), "is_digest": hashing.is_digest(F.col("hash"))})


@query("""WITH s AS (SELECT l_orderkey AS key, list_distinct(list(l_returnflag)) AS outputs FROM lineitem WHERE l_orderkey % 4 <> 0 GROUP BY 1)
SELECT o_orderkey AS key, coalesce(list_has_all(outputs, CASE WHEN o_orderkey % 2 = 0 THEN ['N'] ELSE ['A', 'R'] END), false) AS hit FROM orders LEFT JOIN s ON key = o_orderkey""")
def memo_probe(t: Tables) -> DataFrame:
    calls = t.orders.select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("N"))).otherwise(F.array(F.lit("A"), F.lit("R"))).alias("required"))
    instances = t.lineitem.filter("l_orderkey % 4 <> 0").groupBy(F.col("l_orderkey").alias("key")).agg(F.collect_set("l_returnflag").alias("outputs"))
    return workflow.probe_cache(calls, instances).select("key", "hit")


@query("SELECT l_orderkey AS wf, count(*) FILTER (l_returnflag = 'A') AS executed, count(*) FILTER (l_returnflag = 'N') AS cached, count(*) FILTER (l_returnflag = 'R') AS failed, count(*) AS total FROM lineitem GROUP BY 1")
def run_summary(t: Tables) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "A", "executed").when(F.col("l_returnflag") == "N", "cached").otherwise("failed")
    return workflow.run_summary(t.lineitem.select(F.col("l_orderkey").alias("wf"), status.alias("status")))


_INSTANCES = "i AS (SELECT o_custkey AS tool, sha256(CAST(o_orderkey AS VARCHAR)) AS key, o_orderstatus = 'O' AS impure, CAST(o_orderkey * 7919 % 100000 AS BIGINT) AS executed_at, CASE o_orderstatus WHEN 'F' THEN ['a'] WHEN 'O' THEN ['a', 'b'] ELSE ['a', 'b', 'c'] END AS outputs FROM orders)"


def _instances(t: Tables) -> DataFrame:
    outputs = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("a"))).when(F.col("o_orderstatus") == "O", F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(*map(F.lit, "abc")))
    return t.orders.select(F.col("o_custkey").alias("tool"), hashing.content_hash(F.col("o_orderkey").cast("string")).alias("key"), (F.col("o_orderstatus") == "O").alias("impure"), (F.col("o_orderkey") * 7919 % 100000).alias("executed_at"), outputs.alias("outputs"))


@query(f"WITH {_INSTANCES} SELECT tool, arg_max(key, (impure, CASE WHEN impure THEN executed_at ELSE 0 END, key)) AS key, count(*) AS instances FROM i GROUP BY tool")
def instance_recency(t: Tables) -> DataFrame:
    return workflow.most_recent(_instances(t), "tool")


@query(f"""WITH {_INSTANCES}, o AS (SELECT o_custkey AS c_custkey, min(o_orderkey) AS first FROM orders GROUP BY 1),
s AS (SELECT c_custkey AS step, c_custkey AS tool, sha256(CAST(CASE WHEN c_custkey % 5 = 0 THEN c_custkey ELSE first END AS VARCHAR)) AS key, CASE WHEN c_custkey % 2 = 0 THEN ['a'] ELSE ['b'] END AS required FROM customer LEFT JOIN o USING (c_custkey)),
st AS (SELECT step, s.key AS instance, 'strict' AS how FROM s JOIN i ON i.key = s.key AND i.tool = s.tool WHERE list_has_all(outputs, required))
SELECT * FROM st UNION ALL SELECT step, arg_max(i.key, (-len(outputs), executed_at, i.key)), 'relaxed' FROM s JOIN i ON i.tool = s.tool WHERE list_has_all(outputs, required) AND step NOT IN (SELECT step FROM st) GROUP BY step""")
def instance_match(t: Tables) -> DataFrame:
    """Steps with the key of their customer's first order, or, every fifth, that of an order of perhaps another customer, which is no match."""
    required = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("b")))
    first = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("first"))
    key = hashing.content_hash(F.when(F.col("c_custkey") % 5 == 0, F.col("c_custkey")).otherwise(F.col("first")).cast("string"))
    steps = t.customer.join(first, "c_custkey", "left").select(F.col("c_custkey").alias("step"), F.col("c_custkey").alias("tool"), key.alias("key"), required.alias("required"))
    return workflow.matched_instances(steps, _instances(t))


@query("SELECT l_orderkey AS hash, bool_and(l_quantity > 10) AS save, bool_or(l_discount > 0.08) AS force_full FROM lineitem GROUP BY 1")
def persistence_merge(t: Tables) -> DataFrame:
    own = t.lineitem.select(F.col("l_orderkey").alias("hash"), (F.col("l_quantity") > 10).alias("save"), (F.col("l_discount") > 0.08).alias("force_full"))
    return workflow.merged_persistence(own, "hash")


@query("SELECT n, CASE max(r) WHEN 3 THEN 'full' WHEN 2 THEN 'true' WHEN 1 THEN 'false' END AS mode FROM (SELECT o_custkey AS n, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN CASE WHEN o_orderkey % 2 = 0 THEN 2 END ELSE 3 END AS r FROM orders) GROUP BY n")
def save_mode_merge(t: Tables) -> DataFrame:
    mode = F.when(F.col("o_orderstatus") == "F", "false").when(F.col("o_orderstatus") == "O", F.when(F.col("o_orderkey") % 2 == 0, "true")).otherwise("full")
    return workflow.widest_save_mode(t.orders.select(F.col("o_custkey").alias("n"), mode.alias("mode")), "n")


_TOOLS = "tools AS (SELECT p_brand AS name, p_name || '-' || p_partkey AS key, p_size = 1 AS builtin, p_size % 4 = 0 AS has_content FROM part)"


def _tools(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_brand").alias("name"), F.concat_ws("-", "p_name", F.col("p_partkey").cast("string")).alias("key"), (F.col("p_size") == 1).alias("builtin"), (F.col("p_size") % 4 == 0).alias("has_content"))


@query(f"""WITH {_TOOLS}, c AS (SELECT *, CASE WHEN builtin THEN 0 WHEN has_content THEN 1 ELSE 2 END AS class FROM tools), m AS (SELECT name, min(class) AS class FROM c GROUP BY name)
SELECT name, CASE WHEN m.class = 1 THEN max(key) ELSE min(key) END AS key, m.class FROM c JOIN m USING (name, class) GROUP BY name, m.class""")
def tool_by_name(t: Tables) -> DataFrame:
    return workflow.tool_by_name(_tools(t))


@query(f"WITH {_TOOLS} SELECT name, arg_min(key, (NOT has_content, key)) AS key FROM tools GROUP BY name")
def active_tool(t: Tables) -> DataFrame:
    return workflow.active_tool(_tools(t))


@query("""WITH i AS (SELECT o_orderkey AS id, o_custkey % 20 AS tool, o_orderstatus AS hashes, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 1000 END AS synced_at FROM orders),
r AS (SELECT tool, arg_min(expected, ord) AS expected FROM (SELECT s_suppkey % 20 AS tool, s_suppkey AS ord, CASE WHEN s_suppkey % 2 = 0 THEN 'O' END AS expected, CASE WHEN s_suppkey % 5 = 0 THEN 1 END AS step_index FROM supplier WHERE s_suppkey % 20 < 12) WHERE expected IS NOT NULL AND step_index IS NULL GROUP BY tool)
SELECT id, CASE WHEN expected IS NOT NULL THEN hashes <> expected ELSE coalesce(greatest(0, 1000 - synced_at) > 300, false) END AS invalid FROM i LEFT JOIN r USING (tool)""")
def instance_invalidation(t: Tables) -> DataFrame:
    own = t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 20).alias("tool"), F.col("o_orderstatus").alias("hashes"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 1000).alias("synced_at"))
    rules = t.supplier.filter("s_suppkey % 20 < 12").select((F.col("s_suppkey") % 20).alias("tool"), F.col("s_suppkey").alias("ord"), F.when(F.col("s_suppkey") % 2 == 0, "O").alias("expected"), F.when(F.col("s_suppkey") % 5 == 0, 1).alias("step_index"))
    return workflow.invalidated(own, rules, 1000, 300).select("id", "invalid")


def _chain(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("hash"), F.when((F.col("p_partkey") > 0) & (F.col("p_size") % 7 > 0), F.floor(F.col("p_partkey") / 2)).cast("long").alias("base_hash"))


_CHAIN = "o AS (SELECT p_partkey AS hash, CASE WHEN p_partkey > 0 AND p_size % 7 > 0 THEN p_partkey // 2 END AS base_hash FROM part)"


@query(f"""WITH RECURSIVE {_CHAIN}, c(hash, at_, hops) AS (SELECT hash, hash, CAST(0 AS BIGINT) FROM o UNION ALL SELECT c.hash, o.base_hash, c.hops + 1 FROM c JOIN o ON o.hash = c.at_ WHERE o.base_hash IS NOT NULL AND c.hops < 5),
e AS (SELECT hash, arg_max(at_, hops) AS root, max(hops) AS hops FROM c GROUP BY hash)
SELECT e.hash, e.root, e.hops, o.base_hash IS NULL AS complete FROM e JOIN o ON o.hash = e.root""")
def delta_chain(t: Tables) -> DataFrame:
    return tree.delta_chains(_chain(t))


@query(f"WITH {_CHAIN}, g AS (SELECT p_partkey AS hash FROM part WHERE p_partkey % 11 = 3) SELECT hash, CASE WHEN base_hash IN (SELECT hash FROM g) THEN NULL ELSE base_hash END AS base_hash FROM o WHERE hash NOT IN (SELECT hash FROM g)")
def rematerialise_dependents(t: Tables) -> DataFrame:
    return tree.after_delete(_chain(t), t.part.filter("p_partkey % 11 = 3").select(F.col("p_partkey").alias("hash")))


_NODES = """nodes AS (SELECT 'r' || r_regionkey AS node_id, NULL AS parent_id, r_regionkey AS ord, r_name AS name, CASE WHEN r_regionkey = 1 THEN 'strict' END AS sanitize FROM region
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey, n_name, CASE WHEN n_nationkey % 5 = 0 THEN 'off' END FROM nation
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, CAST(c_custkey AS INTEGER), c_name, NULL FROM customer)"""


def _nodes(t: Tables) -> DataFrame:
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    region = t.region.select(key("r", "r_regionkey").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_regionkey").alias("ord"), F.col("r_name").alias("name"), F.when(F.col("r_regionkey") == 1, "strict").alias("sanitize"))
    nation = t.nation.select(key("n", "n_nationkey"), key("r", "n_regionkey"), "n_nationkey", "n_name", F.when(F.col("n_nationkey") % 5 == 0, "off"))
    return region.union(nation).union(t.customer.select(key("c", "c_custkey"), key("n", "c_nationkey"), F.col("c_custkey").cast("int"), "c_name", F.lit(None).cast("string")))


@query(f"""WITH RECURSIVE {_NODES}, t(node_id, path, depth, sanitize, place) AS (SELECT node_id, name, CAST(0 AS BIGINT), coalesce(sanitize, 'default'), lpad(CAST(ord AS VARCHAR), 8, '0') FROM nodes WHERE parent_id IS NULL
UNION ALL SELECT n.node_id, t.path || '/' || n.name, t.depth + 1, coalesce(n.sanitize, t.sanitize), t.place || '.' || lpad(CAST(n.ord AS VARCHAR), 8, '0') FROM t JOIN nodes n ON n.parent_id = t.node_id) SELECT * FROM t""")
def hierarchy_flatten(t: Tables) -> DataFrame:
    return tree.flattened(_nodes(t))


@query(f"""WITH RECURSIVE {_NODES}, g(node_id) AS (SELECT node_id FROM nodes WHERE ord % 6 = 4 UNION ALL SELECT n.node_id FROM g JOIN nodes n ON n.parent_id = g.node_id)
SELECT node_id, parent_id FROM nodes WHERE node_id NOT IN (SELECT node_id FROM g)""")
def hierarchy_deep_remove(t: Tables) -> DataFrame:
    return tree.removed_deep(_nodes(t), F.col("ord") % 6 == 4).select("node_id", "parent_id")


@query(f"""WITH RECURSIVE {_NODES}, g(root, node_id) AS (SELECT node_id, node_id FROM nodes WHERE parent_id IS NULL UNION ALL SELECT g.root, n.node_id FROM g JOIN nodes n ON n.parent_id = g.node_id)
SELECT DISTINCT node_id FROM g WHERE root = 'r2'""")
def hierarchy_contains(t: Tables) -> DataFrame:
    return tree.below(_nodes(t), _nodes(t).filter("node_id = 'r2'"))


@query("""WITH r AS (SELECT 't' || n_nationkey AS tool, CASE WHEN n_nationkey % 3 = 0 THEN 'inherit' ELSE n_name END AS version FROM nation WHERE n_nationkey < 20),
d AS (SELECT s_suppkey AS parent, 't' || s_nationkey AS dep, CASE WHEN s_suppkey % 2 = 0 THEN 'inherit' ELSE s_name END AS version FROM supplier)
SELECT parent, dep, CASE WHEN d.version <> 'inherit' THEN d.version WHEN r.version = 'inherit' THEN NULL ELSE r.version END AS version,
CASE WHEN d.version = 'inherit' AND r.version IS NULL THEN 'nothing to inherit' WHEN d.version = 'inherit' AND r.version = 'inherit' THEN 'inherits too' END AS error FROM d LEFT JOIN r ON r.tool = d.dep""")
def inherit_version(t: Tables) -> DataFrame:
    requirements = t.nation.filter("n_nationkey < 20").select(F.concat(F.lit("t"), F.col("n_nationkey").cast("string")).alias("tool"), F.when(F.col("n_nationkey") % 3 == 0, "inherit").otherwise(F.col("n_name")).alias("version"))
    deps = t.supplier.select(F.col("s_suppkey").alias("parent"), F.concat(F.lit("t"), F.col("s_nationkey").cast("string")).alias("dep"), F.when(F.col("s_suppkey") % 2 == 0, "inherit").otherwise(F.col("s_name")).alias("version"))
    return tree.inherited_versions(requirements, deps)


def _call(tool: str, *texts: str) -> str:
    return f"sha256(unhex(sha256('workflow') || sha256('{tool}') || {' || '.join(f'sha256({x})' for x in texts)}))"


_OLD, _RUN = "o_orderdate < DATE '1998-04-01'", "o_orderkey AS wf, o_orderstatus AS st"


@query(f"""WITH o AS (SELECT {_RUN}, {_OLD} AS old, o_orderpriority || '/' || c_name AS t0 FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_nationkey <> 7) ON c_custkey = o_custkey),
t AS (SELECT *, sha256(t0 || '#' || st) AS t1 FROM o), k AS (SELECT *, {_call('echo', 't0')} AS k0, {_call('digest', "t0 || '#' || st")} AS k1, {_call('join', 't0', 't1')} AS k2, {_call('gone', 't1')} AS kx FROM t),
h AS (SELECT k0 AS key FROM k WHERE old AND t0 IS NOT NULL UNION SELECT k1 FROM k WHERE old AND t0 IS NOT NULL UNION SELECT k2 FROM k WHERE old AND t0 IS NOT NULL),
s AS (SELECT wf, 'read' AS step, 0 AS wave, k0 AS key, sha256(t0) AS hash, false AS known, false AS unknown FROM k UNION ALL SELECT wf, 'again', 1, k0, sha256(t0), true, false FROM k UNION ALL SELECT wf, 'check', 1, k1, sha256(t1), false, false FROM k
UNION ALL SELECT wf, 'last', 2, k2, sha256(t0 || t1), false, false FROM k UNION ALL SELECT wf, 'bad', 2, kx, NULL, false, true FROM k WHERE st = 'P')
SELECT wf, step, CAST(wave AS BIGINT) AS wave, CASE WHEN s.key IS NULL OR unknown THEN 'failed' WHEN known OR h.key IS NOT NULL THEN 'cached' ELSE 'executed' END AS status, s.key, CASE WHEN s.key IS NULL THEN 'input' WHEN unknown THEN 'tool' END AS problem, hash FROM s LEFT JOIN h ON h.key = s.key
UNION ALL SELECT wf, 'lost', NULL, 'blocked', NULL, 'dependency', NULL FROM o WHERE st = 'P'""")
def workflow_run(t: Tables) -> DataFrame:
    """Each order's workflow, with what a run of the older orders' workflows left; a nation's customers are missing, as are a tool and a step."""
    row = lambda step, tool, name, template: F.struct(F.lit(step).alias("step"), F.lit(tool).alias("tool"), F.lit(name).alias("name"), template.alias("template"))
    read = F.concat("o_orderpriority", F.lit("/${external_data."), F.col("o_custkey").cast("string"), F.lit("}"))
    result = lambda step: F.lit(f"${{step_output.{step}.result}}")
    every = [row("read", "echo", "text", read), row("again", "echo", "text", result("read")), row("check", "digest", "text", F.concat(result("read"), F.lit("#"), "o_orderstatus"))]
    every += [row("last", "join", "a", result("again")), row("last", "join", "b", result("check"))]
    odd = F.when(F.col("o_orderstatus") == "P", F.array(row("bad", "gone", "text", result("check")), row("lost", "echo", "text", result("nowhere"))))
    calls = t.orders.select(F.col("o_orderkey").alias("wf"), F.expr(_OLD).alias("old"), F.explode(F.concat(F.array(*every), F.coalesce(odd, F.slice(F.array(*every), 1, 0)))).alias("c")).select("wf", "old", "c.*")
    external = t.customer.filter("c_nationkey <> 7").select(F.col("c_custkey").cast("string").alias("ref"), F.col("c_name").alias("text"))
    steps = calls.select("wf", "old", "step", "tool").distinct()
    former = runs.run_workflows(steps.filter("old"), calls.filter("old"), external=external)
    rounds.removed(*former.settled)
    now = runs.run_workflows(steps, calls, former.instances, former.objects, external)
    return now.steps.select("wf", "step", "wave", "status", "key", "problem", F.explode_outer("outputs").alias("output", "hash")).drop("output")
