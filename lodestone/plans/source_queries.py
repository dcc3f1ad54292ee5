"""Queries of archives, templates and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import documents, templates
from lodestone.functions.hashing import content_hash
from lodestone.plans.registry import Tables, query
from lodestone.sources import archives, files, zips


def _members(t: Tables) -> DataFrame:
    return t.documents.select(F.col("source").alias("archive"), F.format_string("d%d/doc-%06d.txt", F.col("doc_id") % 3, "doc_id").alias("path"), F.col("text").cast("binary").alias("bytes"))


_PATH = "'d' || (doc_id % 3) || '/doc-' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || '.txt'"


@query(f"SELECT source AS archive, row_number() OVER (PARTITION BY source ORDER BY {_PATH}) - 1 AS idx, {_PATH} AS path, sha256(text) AS hash FROM documents")
def archive_round_trip(t: Tables) -> DataFrame:
    """Packed as one zip an archive, read, packed again in that order and read again."""
    once = zips.contents(zips.assembled(_members(t)))
    again = zips.contents(zips.assembled(once, order=["at"]))
    return zips.numbered(again.select("archive", "at", "path", content_hash(F.col("bytes")).alias("hash"))).select("archive", "idx", "path", "hash")


@query(f"""WITH m AS (SELECT source AS archive, {_PATH} AS path, strlen(text) AS size, 30 + strlen({_PATH}) + strlen(text) AS record FROM documents)
SELECT archive, row_number() OVER w - 1 AS idx, path, size, CAST(coalesce(sum(record) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM m WINDOW w AS (PARTITION BY archive ORDER BY path)""")
def archive_directory(t: Tables) -> DataFrame:
    """What the central directory of each archive says of its members."""
    return zips.numbered(zips.directory(zips.assembled(_members(t)))).select("archive", "idx", "path", "size", "offset")


@query(f"SELECT source AS archive, row_number() OVER (PARTITION BY source ORDER BY {_PATH}) - 1 AS idx, 'd' || (doc_id % 3) || '/item_' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || '.md' AS path FROM documents")
def archive_rename(t: Tables) -> DataFrame:
    listed = archives.members(archives.packed(_members(t)), "archive", "data", contents=False)
    return archives.renamed(archives.numbered(listed), [("^doc-", "item_"), (r"\.txt$", ".md")]).select("archive", "idx", "path")


@query(f"SELECT source AS archive, '.txt' AS name, min({_PATH}) AS path FROM documents GROUP BY source UNION ALL SELECT source, 'd1/doc-000001.txt', 'd1/doc-000001.txt' FROM documents WHERE doc_id = 1")
def archive_member(t: Tables) -> DataFrame:
    listed = archives.ordered_members(_members(t).select("archive", "path"))
    wanted = t.documents.select(F.col("source").alias("archive"), F.explode(F.array(F.lit(".txt"), F.lit("d1/doc-000001.txt"))).alias("name")).distinct()
    return archives.member_by_name(listed, wanted)


@query("SELECT source AS archive, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def export_report(t: Tables) -> DataFrame:
    return archives.export_report(_members(t))


@query("SELECT source AS archive, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def archive_estimate(t: Tables) -> DataFrame:
    return archives.estimated_sizes(archives.packed(_members(t)).withColumn("kind", F.lit("zip")), "archive", "kind", "data").groupBy("archive").agg(F.sum("bytes").alias("bytes"))


@query("SELECT source AS run, 'one' AS output, count(*) FILTER (doc_id < 20) AS n, CASE WHEN count(*) FILTER (doc_id < 20) = 1 THEN min(CASE WHEN doc_id < 20 THEN 'doc-' || doc_id END) END AS path FROM documents GROUP BY 1 UNION ALL SELECT source, 'all', count(*), NULL FROM documents GROUP BY 1 HAVING count(*) > 1")
def output_capture(t: Tables) -> DataFrame:
    own = t.documents.select(F.col("source").alias("run"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("path"))
    runs = own.select("run").distinct()
    specs = runs.select("run", F.lit("one").alias("output"), F.lit("^doc-(1?[0-9])$").alias("pattern")).union(runs.select("run", F.lit("all"), F.lit("^doc-")))
    return archives.captured(own, specs)


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'symlink' WHEN s_suppkey % 2 = 0 THEN 'hardlink' ELSE 'copy' END AS method, NOT (s_suppkey % 3 <> 0 AND s_suppkey % 2 = 0) AS notice FROM supplier")
def materialise_method(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    method, notice = files.materialise_method({"hardlink": (k % 2 == 0) & (k % 3 > 0), "symlink": k % 3 == 0, "copy": F.lit(True)}, ["hardlink", "symlink", "copy"])
    return t.supplier.select("s_suppkey", method.alias("method"), notice.alias("notice"))


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'b-' || c_name ELSE 'other' END || ' ${x} ' || CASE WHEN c_custkey % 2 = 0 THEN 'has ' || c_custkey ELSE 'none' END AS v FROM customer")
def template_render(t: Tables) -> DataFrame:
    template = '${seg == "BUILDING" ? b-${name} : other} \\${x} ${id ? has ${id} | none}'
    values = F.create_map(F.lit("seg"), "c_mktsegment", F.lit("name"), "c_name", F.lit("id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string")).otherwise(""))
    return t.customer.select("c_custkey", templates.rendered(F.lit(template), values).alias("v"))


@query("SELECT n_nationkey, 'run a b ' || n_name AS command FROM nation")
def command_parts(t: Tables) -> DataFrame:
    parts = F.array(F.lit("run"), F.lit("*list"), F.lit(""), F.lit("''"), F.lit("*none"), F.col("n_name"))
    lists = F.create_map(F.lit("list"), F.lit('["a", "b", ""]'))
    return t.nation.select("n_nationkey", F.array_join(templates.command_parts(parts, lists), " ").alias("command"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN p_brand ELSE p_type END AS title, p_brand AS artist FROM part")
def metadata_aliases(t: Tables) -> DataFrame:
    q = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    d = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit('{"format":{"tags":{"TITLE":'), q("p_name"), F.lit('}},"title":"late","uploader":'), q("p_brand"), F.lit("}")))
    d = d.when(F.col("p_size") % 3 == 1, F.concat(F.lit('{"streams":[{"x":1},{"tags":{"Title":'), q("p_brand"), F.lit('}}],"channel":'), q("p_brand"), F.lit("}")))
    d = d.otherwise(F.concat(F.lit('{"title":7,"track":'), q("p_type"), F.lit(',"Artist":'), q("p_brand"), F.lit("}")))
    return t.part.select("p_partkey", documents.metadata_value(d, "title").alias("title"), documents.metadata_value(d, "artist").alias("artist"))


@query("SELECT p_partkey, 'a_0_n=' || p_size || '|a_1=x|b=1; 2|c=' || p_name AS flat FROM part")
def json_flatten(t: Tables) -> DataFrame:
    d = F.concat(F.lit('{"c":"'), "p_name", F.lit('","b":[1,2],"a":[{"n":'), F.col("p_size").cast("string"), F.lit('},"x"],"z":null}'))
    return t.part.select("p_partkey", F.array_join(F.transform(documents.flattened(d), lambda e: F.concat_ws("=", e["key"], e["value"])), "|").alias("flat"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_name WHEN p_size % 4 = 1 THEN p_brand ELSE 'literal' END AS v FROM part")
def metadata_fallback(t: Tables) -> DataFrame:
    k = F.col("p_size") % 4
    return t.part.select("p_partkey", documents.resolved_value([F.when(k == 0, F.col("p_name")).otherwise(" "), F.when(k == 1, F.col("p_brand")), F.lit("literal")]).alias("v"))
