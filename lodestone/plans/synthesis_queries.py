"""Queries of workflow synthesis, journals and the library's smaller rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import templates, text
from lodestone.functions.hashing import content_hash
from lodestone.operators import library, synthesis
from lodestone.plans.registry import Tables, query
from lodestone.sources import journal


def _media_steps(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_custkey").alias("media"), F.col("o_orderkey").alias("ord"), F.array(F.substring("o_orderpriority", 1, 1)).alias("inputs"), F.array("o_orderstatus", F.substring("o_orderpriority", 1, 1)).alias("outputs"))


_BOUND = """s AS (SELECT o_custkey AS media, o_orderkey AS ord, left(o_orderpriority, 1) AS i, o_orderstatus AS o FROM orders),
m AS (SELECT media, ord, o AS variant FROM s UNION SELECT media, ord, i FROM s),
b AS (SELECT s.media, s.ord, s.i AS variant, max(m.ord) AS producer FROM s LEFT JOIN m ON m.media = s.media AND m.variant = s.i AND m.ord < s.ord GROUP BY ALL)"""


@query(f"WITH {_BOUND} SELECT media, ord, variant, producer FROM b")
def workflow_bindings(t: Tables) -> DataFrame:
    return synthesis.bound_inputs(_media_steps(t)).select("media", "ord", "variant", "producer")


@query(f"WITH {_BOUND} SELECT media, ord, string_agg(DISTINCT CAST(producer AS VARCHAR), ',') AS needs FROM b WHERE producer IS NOT NULL GROUP BY ALL")
def workflow_dependencies(t: Tables) -> DataFrame:
    return synthesis.dependencies(synthesis.bound_inputs(_media_steps(t))).select("media", "ord", F.array_join(F.col("needs").cast("array<string>"), ",").alias("needs"))


@query("""WITH c AS (SELECT 'import' AS tool, ['import'] AS chain UNION ALL SELECT 'media-tagger', ['metadata', 'apply'] UNION ALL SELECT 'rsgain', ['extract', 'rsgain', 'export', 'rewrite-track', 'rewrite-album', 'apply']),
m AS (SELECT o_custkey AS media, o_orderkey AS ord, CASE o_orderstatus WHEN 'F' THEN 'import' WHEN 'O' THEN 'rsgain' ELSE 'media-tagger' END AS tool, left(o_orderpriority, 1) AS variant FROM orders)
SELECT media, ord, variant, ord || '-' || variant || '-' || i || '-' || chain[i + 1] AS step, CASE WHEN i > 0 THEN ord || '-' || variant || '-' || (i - 1) || '-' || chain[i] END AS needs FROM m JOIN c USING (tool), range(6) r(i) WHERE i < len(chain)""")
def workflow_expansion(t: Tables) -> DataFrame:
    tool = F.when(F.col("o_orderstatus") == "F", "import").when(F.col("o_orderstatus") == "O", "rsgain").otherwise("media-tagger")
    return synthesis.expanded(t.orders.select(F.col("o_custkey").alias("media"), F.col("o_orderkey").alias("ord"), tool.alias("tool"), F.substring("o_orderpriority", 1, 1).alias("variant")))


@query("""SELECT l_orderkey AS media, l_linenumber AS ord, l_partkey AS variant, 'output-' || l_suppkey % 5 AS slot, CASE WHEN count(*) OVER (PARTITION BY l_orderkey, l_linenumber, l_suppkey % 5) > 1 THEN 'index taken twice' WHEN l_suppkey % 5 >= 4 THEN 'index too high' END AS problem FROM lineitem""")
def output_slots(t: Tables) -> DataFrame:
    return synthesis.slots(t.lineitem.select(F.col("l_orderkey").alias("media"), F.col("l_linenumber").alias("ord"), F.col("l_partkey").alias("variant"), (F.col("l_suppkey") % 5).alias("idx")), 4)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'A' THEN 'output-' || l_linenumber WHEN 'N' THEN 'subtitles' ELSE 'primary' END AS output, CASE WHEN l_returnflag = 'N' THEN '.en.vtt' END AS member FROM lineitem""")
def output_binding(t: Tables) -> DataFrame:
    flag = F.col("l_returnflag")
    output, member = synthesis.output_binding(F.when(flag == "N", "subtitle").otherwise("primary"), F.when(flag == "A", "ffmpeg").otherwise("yt-dlp"), F.col("l_linenumber"), F.lit("en"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", output.alias("output"), member.alias("member"))


@query("SELECT conv_id AS media, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS step_index FROM conversations QUALIFY role = 'user'")
def step_targets(t: Tables) -> DataFrame:
    tools = t.conversations.groupBy(F.col("conv_id").alias("media")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("tools"))
    return synthesis.step_targets(tools, "user")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '--max-size ' || p_size WHEN 1 THEN CASE WHEN p_size % 2 = 0 THEN '--max-size' ELSE '' END WHEN 2 THEN CASE WHEN p_size % 2 = 0 THEN '--max-size' ELSE '--no-max-size' END ELSE '' END AS tokens FROM part")
def option_tokens(t: Tables) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ["pair", "bool", "bool_pair", "none"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    value = F.when(kind == "pair", F.col("p_size").cast("string")).otherwise((F.col("p_size") % 2 == 0).cast("string"))
    return t.part.select("p_partkey", F.array_join(synthesis.option_tokens(F.lit("max_size"), value, kind), " ").alias("tokens"))


@query("SELECT o_custkey AS media, o_orderkey % 3 AS step_index, o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_custkey % 3 = o_orderkey % 3)")
def step_invalidation(t: Tables) -> DataFrame:
    own = t.orders.select(F.col("o_custkey").alias("media"), (F.col("o_orderkey") % 3).alias("step_index"), "o_orderkey")
    return synthesis.cleared(own, t.customer.select(F.col("c_custkey").alias("media"), (F.col("c_custkey") % 3).alias("step_index")))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'auto' WHEN 2 THEN 'disabled' ELSE p_name END AS recording FROM part")
def recording_override(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 4
    return t.part.select("p_partkey", synthesis.recording_override(F.when(k == 1, " AUTO ").when(k == 2, "None").when(k == 3, F.col("p_name"))).alias("recording"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'a=1,b=2' WHEN 1 THEN 'b=' || p_size || ',c=3' ELSE 'a=1,b=' || p_size || ',c=3' END AS tags FROM part")
def tag_merge(t: Tables) -> DataFrame:
    old = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    new = F.create_map(F.lit("b"), F.col("p_size").cast("string"), F.lit("c"), F.lit("3"))
    tags = synthesis.merged_tags(old, new, F.col("p_partkey") % 3 == 1, F.col("p_partkey") % 3 == 0)
    return t.part.select("p_partkey", F.array_join(F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("tags"))


@query("SELECT event_id // 64 AS segment, event_id AS pos, sha256(props) AS hash FROM events QUALIFY row_number() OVER (PARTITION BY event_id // 64 ORDER BY event_id DESC) > 1")
def journal_torn_tail(t: Tables) -> DataFrame:
    """Each segment loses its last byte, and so its last entry."""
    entries = t.events.select(F.floor(F.col("event_id") / 64).alias("segment"), F.col("event_id").alias("pos"), F.col("props").alias("payload"))
    torn = journal.encoded(entries, "segment").withColumn("data", F.expr("substring(data, 1, octet_length(data) - 1)"))
    return journal.decoded(torn).select("segment", "pos", content_hash(F.col("payload")).alias("hash"))


@query("SELECT doc_id, sha256(source) AS base_hash, n_chars AS length, sha256(text) AS payload FROM documents")
def delta_envelope(t: Tables) -> DataFrame:
    sealed = journal.envelope(content_hash(F.col("source")), F.col("n_chars"), F.col("text").cast("binary"))
    own = t.documents.select("doc_id", journal.opened(sealed).alias("e"))
    return own.select("doc_id", "e.base_hash", "e.length", content_hash(F.col("e.payload")).alias("payload"))


@query("SELECT sha256(d.text) AS hash, d.doc_id, CAST(l.quality AS VARCHAR) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def aux_column(t: Tables) -> DataFrame:
    objects = t.documents.select(F.col("doc_id").alias("hash"), "doc_id", content_hash(F.col("text")).alias("h"))
    aux = t.labels.select(F.col("doc_id").alias("hash"), F.inline(F.array(F.struct(F.lit("quality").alias("name"), F.col("quality").cast("string").alias("data")), F.struct(F.lit("toxic").alias("name"), F.col("toxic").cast("string").alias("data")))))
    return library.with_aux(objects, aux, "quality").select(F.col("h").alias("hash"), "doc_id", "quality")


@query("""WITH s AS (SELECT c_custkey AS media, 'v' AS variant, sha256(c_name) AS hash FROM customer WHERE c_custkey % 2 = 0), p AS (SELECT c_custkey AS media, 'v' AS variant, sha256(c_mktsegment) AS hash FROM customer WHERE c_custkey % 3 = 0 AND c_mktsegment <> 'BUILDING')
SELECT media, variant, coalesce(p.hash, s.hash) AS hash FROM s FULL JOIN p USING (media, variant)""")
def variant_backfill(t: Tables) -> DataFrame:
    own = lambda df, c: df.select(F.col("c_custkey").alias("media"), F.lit("v").alias("variant"), content_hash(F.col(c)).alias("hash"))
    live = t.customer.filter("c_mktsegment <> 'BUILDING'").select(content_hash(F.col("c_mktsegment")).alias("hash")).distinct()
    return library.backfilled_variants(own(t.customer.filter("c_custkey % 2 = 0"), "c_name"), own(t.customer.filter("c_custkey % 3 = 0"), "c_mktsegment"), live)


@query("""SELECT o_custkey AS repo, coalesce(arg_min(tag, o_orderkey) FILTER (latest), arg_min(tag, o_orderkey) FILTER (starts_with(tag, 'autobuild-'))) AS tag FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN 'autobuild-' ELSE 'v' END || o_orderkey AS tag, o_orderstatus = 'P' AS latest FROM orders) GROUP BY 1""")
def release_resolution(t: Tables) -> DataFrame:
    tag = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "autobuild-").otherwise("v"), F.col("o_orderkey").cast("string"))
    return library.resolved_releases(t.orders.select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("ord"), tag.alias("tag"), (F.col("o_orderstatus") == "P").alias("latest")))


@query("""WITH m AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM lineitem), k AS (SELECT l_orderkey AS release, l_partkey AS recording, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS c, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey) AS track FROM m)
SELECT release, recording, CAST(c AS BIGINT) AS medium, track FROM k WHERE recording % 2 = 0 QUALIFY row_number() OVER (PARTITION BY release, recording ORDER BY c, track) = 1""")
def track_position(t: Tables) -> DataFrame:
    side = lambda f: F.transform(F.array_sort(F.collect_set(F.when(F.col("l_returnflag") == f, F.struct("l_linenumber", "l_partkey")))), lambda x: x["l_partkey"])
    releases = t.lineitem.groupBy(F.col("l_orderkey").alias("release")).agg(F.array(side("A"), side("N"), side("R")).alias("media"))
    return library.track_positions(releases, t.part.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("recording")))


@query("""WITH i AS (SELECT event_type AS "group", user_id AS item, max(CAST(floor(value) AS BIGINT)) AS pos, max(user_id % 90) AS estimate, max(CASE WHEN event_id % 5 = 0 THEN CAST(floor(value) AS BIGINT) + 3 END) AS actual FROM events GROUP BY ALL)
SELECT "group", CAST(sum(least(pos, coalesce(actual, estimate))) AS BIGINT) AS pos, CAST(sum(coalesce(actual, estimate)) AS BIGINT) AS total FROM i GROUP BY 1""")
def byte_budgets(t: Tables) -> DataFrame:
    own = t.events.select(F.col("event_type").alias("group"), F.col("user_id").alias("item"), F.floor("value").cast("long").alias("pos"), (F.col("user_id") % 90).alias("estimate"), F.when(F.col("event_id") % 5 == 0, F.floor("value").cast("long") + 3).alias("actual"))
    return library.byte_budgets(own)


@query("""SELECT p_brand AS "group", min(p_partkey) AS ord FROM part WHERE p_size = 7 GROUP BY 1""")
def cover_embedding(t: Tables) -> DataFrame:
    return library.embedded_covers(t.part.select(F.col("p_brand").alias("group"), F.col("p_partkey").alias("ord"), (F.col("p_size") == 7).alias("front")), True).select("group", "ord")


@query("SELECT p_partkey, 'x' || chr(10) || 'Name=' || p_name || ' b' || chr(10) || 'Url=downloads/u' AS link, p_type || '/' || p_name AS member FROM part")
def sandbox_paths(t: Tables) -> DataFrame:
    link = F.concat(F.lit("x\nName=downloads/"), "p_name", F.lit("[mark]\\sb\nUrl=downloads/u"))
    member = F.concat(F.lit("downloads\\"), "p_type", F.lit("/[mark]"), "p_name")
    return t.part.select("p_partkey", text.desktop_link(link, "[mark]").alias("link"), text.sandbox_member(member, "[mark]").alias("member"))


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'w' WHEN 1 THEN 'm' ELSE 'l' END AS picked FROM nation")
def os_selector(t: Tables) -> DataFrame:
    template = text.os_selector([("windows", "w"), ("macos", "m"), ("linux", "l")])
    name = F.element_at(F.array(*map(F.lit, ["windows", "macos", "linux"])), (F.col("n_nationkey") % 3 + 1).cast("int"))
    return t.nation.select("n_nationkey", templates.rendered(F.lit(template), F.create_map(F.lit("context.os"), name)).alias("picked"))
