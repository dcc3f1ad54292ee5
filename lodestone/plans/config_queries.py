"""Queries of configuration rules, synthesis of single tools, tags, folders and the log's upkeep."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.functions import documents, text
from lodestone.functions.hashing import content_hash
from lodestone.operators import library, log, synthesis, tree, workflow
from lodestone.plans.registry import Tables, query
from lodestone.sources import archives, files, journal


def _list(column: str) -> F.Column:
    return F.array_join(F.col(column).cast("array<string>"), ",").alias(column)


def _folder(t: Tables) -> str:
    """A new folder's name in the cluster's shared folder; it goes when the driver's JVM ends."""
    base = t.spark.sparkContext.getConf().get("spark.checkpoint.dir") or f"file://{tempfile.gettempdir()}"
    name = f"{base.rstrip('/')}/lodestone/{uuid.uuid4().hex}"
    path = t.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(t.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return name


@query(r"""WITH c AS (SELECT l_orderkey, l_linenumber, '${step_output.s' || l_linenumber || '.out' || CASE l_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN ':zip(a/m' || l_suppkey || ')' WHEN 2 THEN ':zip(m):file(p' || l_suppkey || ')' ELSE ':folder(f):zip(.x):file(a b)' END || '}' AS template FROM lineitem),
r AS (SELECT *, generate_subscripts(regexp_extract_all(template, ':(zip|file|folder)\(([^)]*)\)'), 1) AS i, unnest(regexp_extract_all(template, ':(zip|file|folder)\([^)]*\)')) AS s FROM c)
SELECT l_orderkey, l_linenumber, 's' || l_linenumber AS step, i - 1 AS place, regexp_extract(s, ':(\w+)', 1) AS kind, regexp_extract(s, '\((.*)\)', 1) AS argument FROM r""")
def selector_chain(t: Tables) -> DataFrame:
    k = F.col("l_partkey") % 4
    chain = F.when(k == 0, "").when(k == 1, F.format_string(":zip(a/m%d)", "l_suppkey")).when(k == 2, F.format_string(":zip(m):file(p%d)", "l_suppkey")).otherwise(":folder(f):zip(.x):file(a b)")
    own = t.lineitem.select("l_orderkey", "l_linenumber", F.format_string("${step_output.s%d.out%s}", "l_linenumber", chain).alias("template"))
    refs = workflow.step_references(own, "template")
    each = refs.select("l_orderkey", "l_linenumber", "step", F.posexplode(workflow.selectors(F.col("chain"))).alias("place", "s"))
    return each.select("l_orderkey", "l_linenumber", "step", F.col("place").cast("long").alias("place"), "s.kind", "s.argument")


@query("""WITH s AS (SELECT o_custkey AS media, o_orderkey AS ord, left(o_orderpriority, 1) AS a, o_orderstatus AS b FROM orders),
m AS (SELECT media, ord, a AS variant FROM s UNION SELECT media, ord, b FROM s),
p AS (SELECT s.media, s.ord, max(x.ord) AS pa, max(y.ord) AS pb FROM s LEFT JOIN m x ON x.media = s.media AND x.variant = s.a AND x.ord < s.ord LEFT JOIN m y ON y.media = s.media AND y.variant = s.b AND y.ord < s.ord GROUP BY ALL),
o AS (SELECT l_orderkey AS ord, string_agg('output-' || (l_linenumber - 1) || '=' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS outputs, max(l_linenumber) - 1 AS top, count(DISTINCT l_linenumber) < count(*) AS twice FROM lineitem GROUP BY 1)
SELECT media, ord, ord || '-ffmpeg' AS step, 'input-0=' || a || ',input-1=' || b AS inputs, coalesce(outputs, '') AS outputs,
concat_ws(',', pa, CASE WHEN pb <> coalesce(pa, -1) THEN pb END) AS needs,
CASE WHEN pa IS NULL OR pb IS NULL THEN 'unknown input' WHEN top >= 5 THEN 'index too high' WHEN twice THEN 'index taken twice' END AS problem FROM s JOIN p USING (media, ord) LEFT JOIN o USING (ord)""")
def transcoding_synthesis(t: Tables) -> DataFrame:
    both = F.array(F.substring("o_orderpriority", 1, 1), "o_orderstatus")
    steps = t.orders.select(F.col("o_custkey").alias("media"), F.col("o_orderkey").alias("ord"), both.alias("inputs"), both.alias("outputs"))
    outputs = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("media"), F.col("o_orderkey").alias("ord"), F.col("l_partkey").alias("variant"), (F.col("l_linenumber") - 1).alias("idx"))
    made = synthesis.transcoding_steps(steps.drop("outputs"), synthesis.bound_inputs(steps), outputs, 2, 5)
    return made.select("media", "ord", "step", _list("inputs"), _list("outputs"), _list("needs"), "problem")


@query("""WITH v AS (SELECT l_orderkey AS media, l_linenumber AS ord, l_partkey AS i, 'v' || l_partkey AS variant, CASE l_partkey % 4 WHEN 0 THEN 'primary' WHEN 1 THEN 'subtitle' WHEN 2 THEN 'archive' ELSE 'thumbnails' END AS kind FROM lineitem),
w AS (SELECT DISTINCT media, ord % 2 AS ord, i, variant, kind FROM v), a AS (SELECT DISTINCT media, ord FROM w WHERE kind = 'archive')
SELECT w.media, w.ord, variant, w.ord || '-' || i || '-yt-dlp-' || variant AS step, CASE WHEN kind = 'subtitle' THEN 'subtitles' WHEN kind = 'primary' AND a.media IS NOT NULL THEN 'primary,archive' ELSE kind END AS outputs FROM w LEFT JOIN a ON a.media = w.media AND a.ord = w.ord WHERE kind <> 'archive'""")
def download_synthesis(t: Tables) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ["primary", "subtitle", "archive", "thumbnails"])), (F.col("l_partkey") % 4 + 1).cast("int"))
    own = t.lineitem.select(F.col("l_orderkey").alias("media"), (F.col("l_linenumber") % 2).alias("ord"), F.col("l_partkey").alias("i"), F.concat(F.lit("v"), F.col("l_partkey").cast("string")).alias("variant"), kind.alias("kind")).distinct()
    return synthesis.download_steps(own).select("media", "ord", "variant", "step", _list("outputs"))


@query("""WITH p AS (SELECT *, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_brand END AS artist, CASE WHEN p_size % 2 = 0 THEN p_type ELSE ' ' END AS status FROM part)
SELECT p_partkey, concat_ws('|', 'album=' || p_name, 'artist=' || artist, 'artistcredit=' || artist, 'asin=' || repeat('x', 4096), 'date=' || p_size, 'releasecountry=' || p_size, 'releasedate=' || p_size, CASE WHEN p_size % 2 = 0 THEN 'releasestatus=' || status END, 'title=' || p_name) AS tags FROM p""")
def recording_tags(t: Tables) -> DataFrame:
    size = F.col("p_size").cast("string")
    known = {"title": F.col("p_name"), "artist": F.when(F.col("p_size") % 3 > 0, F.col("p_brand")), "album": F.col("p_name"), "date": size, "releasecountry": size}
    flat = F.create_map(F.lit("musicbrainz_release_status"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(" "), F.lit("musicbrainz_release_country"), F.lit("late"), F.lit("musicbrainz_release_asin"), F.repeat(F.lit("x"), 5000))
    entries = F.array_sort(F.map_entries(documents.tag_map(known, flat)))
    return t.part.select("p_partkey", F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), "|").alias("tags"))


@query("SELECT event_id, 1000 + row_number() OVER (ORDER BY ts, event_id) AS pos FROM events")
def log_append(t: Tables) -> DataFrame:
    return log.appended(t.events.select("ts", "event_id"), ["ts", "event_id"], 1000).select("event_id", "pos")


@query("SELECT count(*) FILTER (event_id > 500) AS entries_consumed, greatest(max(event_id), 500) AS checkpoint, (SELECT count(*) > 0 FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)) AS maintenance_done FROM events")
def maintenance_report(t: Tables) -> DataFrame:
    orphans = t.part.select("p_partkey").join(t.lineitem.select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti")
    return log.maintenance_report(t.events.select(F.col("event_id").alias("pos")), 500, orphans)


@query("SELECT o_orderkey, 13 AS size, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey END AS position FROM orders")
def checkpoint_codec(t: Tables) -> DataFrame:
    """A third of the checkpoints lose their last byte, or have it changed."""
    made = t.orders.select("o_orderkey", journal.checkpoint(F.col("o_orderkey")).alias("data"))
    text_ = F.hex("data")
    torn = F.when(F.col("o_orderkey") % 6 == 0, F.unhex(F.substring(text_, 1, 24))).when(F.col("o_orderkey") % 3 == 0, F.unhex(F.concat(F.lit("7F"), F.substring(text_, 3, 24)))).otherwise(F.col("data"))
    return made.select("o_orderkey", F.octet_length("data").alias("size"), journal.checkpoint_position(torn).alias("position"))


@query("""WITH m AS (SELECT c_custkey AS id, trim(c_name) AS title FROM customer), l AS (SELECT p_partkey AS id, p_name AS title FROM part WHERE NOT (p_size % 2 = 0 AND p_size % 3 = 0)), f AS (SELECT s_suppkey AS id, s_name AS title FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0)
SELECT 'media' AS what, * FROM m UNION ALL SELECT 'tool', * FROM l UNION ALL SELECT 'file', * FROM f""")
def document_normalise(t: Tables) -> DataFrame:
    media = library.normalized_media(t.customer.select(F.lit("media").alias("what"), F.col("c_custkey").alias("id"), F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("title")), ["title"])
    needs = F.when(F.col("p_size") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("d")))
    tools = library.normalized_tools(t.part.select("p_partkey", "p_name", F.when(F.col("p_size") % 2 == 0, "latest").otherwise("1").alias("version"), needs.alias("dependencies")))
    own = t.supplier.select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 3 == 0, "  ").otherwise("p").alias("path"), F.lit("m").alias("media"), F.when(F.col("s_suppkey") % 5 == 0, "").otherwise("h").alias("hash"))
    return media.union(tools.select(F.lit("tool"), "p_partkey", "p_name")).union(library.normalized_files(own).select(F.lit("file"), "s_suppkey", "s_name"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'op does not accept arg ''zz''' WHEN 1 THEN 'op requires ''path''' WHEN 2 THEN 'op requires non-empty ''path''' END AS problem FROM part")
def argument_contracts(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 4
    one = lambda key, value: F.create_map(F.lit("mode"), F.lit("x"), F.lit(key), F.lit(value))
    given = F.when(k == 0, one("zz", "1")).when(k == 1, one("size", "1")).when(k == 2, one("path", " ")).otherwise(one("path", "a"))
    return t.part.select("p_partkey", text.argument_problem(given, ["mode", "path", "size"], ["mode"], ["path"], "op").alias("problem"))


@query("""WITH t AS (SELECT l_orderkey AS step, 'o' || l_linenumber AS name, min(l_shipdate) AS spec FROM lineitem WHERE l_linenumber < 5 GROUP BY ALL), s AS (SELECT l_orderkey AS step, 'o' || l_linenumber AS name, min(l_returnflag) AS spec FROM lineitem WHERE l_linenumber > 2 GROUP BY ALL)
SELECT step, name, coalesce(s.spec, 'tool') AS spec FROM t FULL JOIN s USING (step, name)""")
def output_spec_merge(t: Tables) -> DataFrame:
    name = F.concat(F.lit("o"), F.col("l_linenumber").cast("string")).alias("name")
    tools = t.lineitem.filter("l_linenumber < 5").select(F.col("l_orderkey").alias("step"), name, F.lit("tool").alias("spec")).distinct()
    steps = t.lineitem.filter("l_linenumber > 2").groupBy(F.col("l_orderkey").alias("step"), name).agg(F.min("l_returnflag").alias("spec"))
    return library.merged_outputs(tools, steps)


@query("""WITH r AS (SELECT l_orderkey AS key, l_linenumber AS output, l_partkey AS hash, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END AS member FROM lineitem)
SELECT o_orderkey AS key, coalesce(bool_and(s_hash AND (member IS NULL OR (hash % 3 = 0 AND member = 'N'))), true) AS materialisable
FROM orders LEFT JOIN (SELECT *, hash % 10 <> 1 AS s_hash FROM r) ON key = o_orderkey GROUP BY 1""")
def materialisable_instances(t: Tables) -> DataFrame:
    required = t.lineitem.select(F.col("l_orderkey").alias("key"), F.struct("l_linenumber", "l_partkey").alias("output"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).alias("member"))
    outputs = t.lineitem.select(F.col("l_orderkey").alias("key"), F.struct("l_linenumber", "l_partkey").alias("output"), F.col("l_partkey").alias("hash")).distinct()
    live = t.part.filter("p_partkey % 10 <> 1").select(F.col("p_partkey").alias("hash"))
    inside = t.part.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("hash"), F.lit("N").alias("member"))
    return workflow.materialisable(t.orders.select(F.col("o_orderkey").alias("key")), required, outputs, live, inside)


_BLOBS = "b AS (SELECT p_partkey AS hash, CAST(p_size AS BIGINT) AS len, CASE WHEN p_partkey % 16 > 0 THEN p_partkey - 1 END AS base_hash FROM part WHERE p_partkey % 50 <> 7)"


@query(f"""WITH RECURSIVE {_BLOBS}, w AS (SELECT DISTINCT base_hash AS hash FROM b WHERE hash % 4 = 1 AND base_hash IS NOT NULL),
c(hash, n) AS (SELECT hash, 1 FROM w UNION SELECT b.base_hash, n + 1 FROM c JOIN b USING (hash) WHERE hash % 9 <> 0 AND base_hash IS NOT NULL AND n < 6)
SELECT DISTINCT hash, CASE WHEN n < 6 THEN len END AS len, CASE WHEN n < 6 THEN base_hash END AS base_hash, CASE WHEN n = 6 THEN 'chain too deep' END AS error FROM c LEFT JOIN b USING (hash) WHERE hash % 9 <> 0 AND (n = 6 OR b.hash IS NOT NULL)""")
def delta_recovery(t: Tables) -> DataFrame:
    base = F.when(F.col("p_partkey") % 16 > 0, F.col("p_partkey") - 1)
    blobs = t.part.filter("p_partkey % 50 <> 7").select(F.col("p_partkey").alias("hash"), F.col("p_size").cast("long").alias("len"), base.alias("base_hash"))
    return tree.recovered_chain(blobs.filter("hash % 4 = 1"), t.part.filter("p_partkey % 9 = 0").select(F.col("p_partkey").alias("hash")), blobs)


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'memory' ELSE p_name END AS place FROM part")
def locator_parse(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", files.locator(F.when(F.col("p_size") % 3 == 0, " memory ").otherwise(F.concat("p_name", F.lit(" ")))).alias("place"))


@query("SELECT r_name AS archive, 'name=' || n_name AS folder, length(n_name) + 1 AS len, sha256(n_name || chr(10)) AS hash FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 7 <> 3")
def folder_round_trip(t: Tables) -> DataFrame:
    """Texts written as files, the folder scanned without some of them, packed as archives and read again."""
    folder = _folder(t)
    files.write_texts(t.nation.select(F.col("n_name").alias("name"), F.col("n_name").alias("text")), folder)
    skipped = [f"name={r.n_name}" for r in t.nation.filter("n_nationkey % 7 = 3").select("n_name").collect()]
    found = files.without(files.scan_folder(t.spark, folder), [*skipped, "_.*"])
    regions = t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey")).select(F.concat(F.lit("name="), "n_name").alias("folder"), "r_name")
    placed = found.withColumn("folder", F.substring_index("path", "/", 1)).join(regions, "folder")
    again = archives.acted("unpack", archives.imported(placed, F.col("r_name")))
    return again.select("archive", F.substring_index("path", "/", 1).alias("folder"), F.octet_length("bytes").alias("len"), content_hash(F.col("bytes")).alias("hash"))


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal > 0 AS impure FROM customer")
def state_round_trip(t: Tables) -> DataFrame:
    """Versioned state saved and loaded again."""
    folder, schema = _folder(t), StructType.fromDDL("version int, id bigint, name string, impure boolean")
    files.save_state(t.customer.select(F.lit(2).alias("version"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), (F.col("c_acctbal") > 0).alias("impure")), folder)
    return files.load_state(t.spark, folder, schema, 2, lines=True).filter("version = 2").select("id", "name", "impure")


@query("SELECT * FROM (VALUES ('id', 'bigint', true), ('steps', 'array<struct<tool:string,ord:int>>', true), ('steps[].tool', 'string', true), ('steps[].ord', 'int', true)) x(path, type, nullable)")
def schema_contract(t: Tables) -> DataFrame:
    return files.schema_contract(t.spark, StructType.fromDDL("id bigint, steps array<struct<tool:string,ord:int>>"))
