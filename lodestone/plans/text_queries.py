"""Queries of string, path, template and metadata scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.functions.hashing import content_hash
from lodestone.plans.registry import Tables, query


@query("SELECT conv_id, array_to_string(list_distinct_ordered, '; ') AS joined FROM (SELECT conv_id, list(r ORDER BY f) AS list_distinct_ordered FROM (SELECT conv_id, trim(role) AS r, min(turn) AS f FROM conversations WHERE trim(role) <> '' GROUP BY ALL) GROUP BY conv_id)")
def join_unique(t: Tables) -> DataFrame:
    own = t.conversations.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit(" "), "role", F.lit(" ")).alias("r")))), lambda x: x["r"]).alias("v"))
    return own.select("conv_id", text.join_unique(F.col("v")).alias("joined"))


@query("SELECT conv_id, nullif(trim(string_agg(role || ' & ', '' ORDER BY turn)), '') AS credit FROM conversations GROUP BY 1")
def artist_credit(t: Tables) -> DataFrame:
    own = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("name"), F.lit(" & ").alias("phrase")))).alias("v"))
    return own.select("conv_id", text.credit_text(F.col("v")).alias("credit"))


@query("SELECT event_id, coalesce(nullif(trim(json_extract_string(props, '$.missing')), ''), nullif(trim(json_extract_string(props, '$.k')), '')) AS v FROM events")
def metadata_first_non_empty(t: Tables) -> DataFrame:
    return t.events.select("event_id", text.first_non_empty(F.get_json_object("props", "$.missing"), F.get_json_object("props", "$.k")).alias("v"))


@query("SELECT page_id, regexp_replace(url, '[0-9]+', '#', 'g') AS v FROM pages")
def metadata_transform(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.regexp_replace("url", "[0-9]+", "#").alias("v"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 > 0 THEN 'media/' || p_partkey || '/' || p_name || '.' || p_brand END AS path FROM part")
def path_interpolate(t: Tables) -> DataFrame:
    template = F.lit("media/${media.id}/${media.metadata.title}.${media.metadata.ext}")
    values = {"media.id": F.col("p_partkey").cast("string"), "media.metadata.title": F.when(F.col("p_size") % 5 > 0, F.col("p_name")), "media.metadata.ext": F.col("p_brand")}
    return t.part.select("p_partkey", text.interpolated(template, values).alias("path"))


@query("SELECT p_partkey, 'artist,title' AS keys FROM part")
def placeholder_keys(t: Tables) -> DataFrame:
    template = F.concat(F.lit("${media.metadata.title}/"), "p_name", F.lit("${media.metadata.artist}${media.metadata.title}"))
    return t.part.select("p_partkey", F.array_join(text.placeholder_keys(template), ",").alias("keys"))


@query(r"""SELECT page_id, translate(url, '<>:"/\|?*', '_________') AS safe, translate(url, '<>:"/\|?*', '__-______') AS own, regexp_full_match(url, '[^<>:"/\\|?*]+') AS valid FROM pages""")
def sanitize_path(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.sanitized(F.col("url")).alias("safe"), text.sanitized(F.col("url"), {":": "-"}).alias("own"), text.valid_component(F.col("url")).alias("valid"))


@query(r"""SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '_', 'g') AS a, translate('t/' || p_type, '<>:"/\|?*', '_________') AS b,
CASE WHEN k = '' THEN 'metadata' WHEN regexp_matches(k, '^[0-9]') THEN 'meta_' || k ELSE k END AS c FROM (SELECT *, regexp_replace(regexp_replace(lower(regexp_replace(CASE WHEN p_size % 3 = 0 THEN '  ' ELSE p_size || ' ' || p_name || '!!' END, '[^A-Za-z0-9]', '_', 'g')), '_+', '_', 'g'), '^_|_$', '', 'g') AS k FROM part)""")
def identifiers(t: Tables) -> DataFrame:
    raw = F.when(F.col("p_size") % 3 == 0, "  ").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(" "), "p_name", F.lit("!!")))
    return t.part.select("p_partkey", text.identifier(F.col("p_name")).alias("a"), text.tool_identifier(F.concat(F.lit("t/"), "p_type")).alias("b"), text.metadata_key(raw).alias("c"))


@query("SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS x FROM documents")
def xml_escape(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.escape_xml(F.col("text")).alias("x"))


@query(r"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://www.youtube.com/watch?v=v' || page_id || CASE WHEN page_id % 4 = 0 THEN '&t=5' ELSE '' END ELSE url END AS uri FROM pages")
def uri_normalize(t: Tables) -> DataFrame:
    short = F.concat(F.lit("https://youtu.be/v"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 4 == 0, "?t=5&x=1").otherwise("?x=1"))
    return t.pages.select("page_id", text.normalized_uri(F.when(F.col("page_id") % 2 == 0, short).otherwise(F.col("url"))).alias("uri"))


@query(r"SELECT page_id, replace(regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '^(www\.)+', ''), '.', '-') || '.' || left(sha256(url), 12) AS id, true AS ok FROM pages")
def media_id(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.media_id(F.col("url"), content_hash(F.col("url"))).alias("id"), F.parse_url("url", F.lit("PROTOCOL")).isin("https", "http", "local").alias("ok"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '.mp3' ELSE '.bin' END AS ext FROM part")
def local_extension(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.extension(F.concat(F.lit("a.b/x"), F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 2 == 0, ".y.mp3").otherwise(""))).alias("ext"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_nationkey % 2 = 0 THEN 'b/' ELSE '' END || c_name WHEN c_custkey % 3 = 1 THEN '../q/' || c_name ELSE '../../z/' || c_name END AS rel FROM customer""")
def relative_path(t: Tables) -> DataFrame:
    source = F.lit("m/a/list.m3u")
    deeper = F.when(F.col("c_nationkey") % 2 == 0, "b/").otherwise("")
    target = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("m/a/"), deeper, "c_name")).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("m/q/"), "c_name")).otherwise(F.concat(F.lit("z/"), "c_name"))
    return t.customer.select("c_custkey", text.relative_path(source, target).alias("rel"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'a/' || c_name WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE 'b/c' END AS path FROM customer")
def path_normalize(t: Tables) -> DataFrame:
    k = F.col("c_custkey") % 4
    raw = F.when(k == 0, F.concat(F.lit("./a//"), "c_name")).when(k == 1, F.concat(F.lit("/"), "c_name")).when(k == 2, F.lit("a/../b")).otherwise(F.lit("b\\./c"))
    return t.customer.select("c_custkey", text.normalized_path(raw).alias("path"))


@query("SELECT c_custkey, starts_with(c_mktsegment || '/x', 'BUILDING/') AS under, c_custkey % 7 = 0 OR (c_custkey % 2 = 0 AND c_mktsegment = 'MACHINERY') AS excluded FROM customer")
def path_predicates(t: Tables) -> DataFrame:
    name = F.when(F.col("c_custkey") % 7 == 0, ".hidden").otherwise(F.col("c_mktsegment"))
    prefix = F.when(F.col("c_custkey") % 2 == 0, "").otherwise("sub")
    return t.customer.select("c_custkey", text.is_under(F.concat("c_mktsegment", F.lit("/x")), F.lit("BUILDING")).alias("under"), text.excluded_from_scan(name, prefix, ["MACHINERY"]).alias("excluded"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'zip' WHEN 1 THEN 'tar.gz' WHEN 2 THEN 'tar.xz' WHEN 3 THEN 'tar.gz' END AS format FROM part")
def archive_format(t: Tables) -> DataFrame:
    suffix = F.element_at(F.array(*map(F.lit, [".ZIP?x=1", ".tgz", ".tar.xz/", ".tar.gz", ".exe"])), (F.col("p_partkey") % 5 + 1).cast("int"))
    return t.part.select("p_partkey", text.archive_format(F.concat(F.lit("https://h.test/"), F.col("p_partkey").cast("string"), suffix)).alias("format"))


@query("""SELECT event_id, CASE WHEN s < 60 THEN s % 60 || 's' WHEN s < 3600 THEN s // 60 || 'm' || CASE WHEN s % 60 > 0 THEN s % 60 || 's' ELSE '' END
WHEN s < 86400 THEN s // 3600 || 'h' || CASE WHEN s // 60 % 60 > 0 THEN s // 60 % 60 || 'm' ELSE '' END ELSE s // 86400 || 'd' || CASE WHEN s // 3600 % 24 > 0 THEN s // 3600 % 24 || 'h' ELSE '' END END AS d FROM (SELECT event_id, event_id * event_id % 300000 AS s FROM events)""")
def duration_text(t: Tables) -> DataFrame:
    return t.events.select("event_id", text.duration_text(F.col("event_id") * F.col("event_id") % 300000).alias("d"))


@query("""SELECT event_id, CASE WHEN r >= 1e6 THEN CASE WHEN r < 1e7 THEN printf('%.1fM/s', r / 1e6) ELSE printf('%.0fM/s', r / 1e6) END WHEN r >= 1e3 THEN CASE WHEN r < 1e4 THEN printf('%.1fk/s', r / 1e3) ELSE printf('%.0fk/s', r / 1e3) END
WHEN r >= 1 THEN CASE WHEN r < 10 THEN printf('%.1f/s', r) ELSE printf('%.0f/s', r) END WHEN r * 60 >= 1 THEN printf('%.0f/m', r * 60) WHEN r * 3600 >= 1 THEN printf('%.0f/h', r * 3600) ELSE printf('%.0f/d', r * 86400) END AS rate FROM (SELECT event_id, (event_id * 37 + 0.123) / 1000 AS r FROM events)""")
def rate_text(t: Tables) -> DataFrame:
    return t.events.select("event_id", text.rate_text((F.col("event_id") * 37 + F.lit(0.123)) / 1000).alias("rate"))


@query("SELECT c_custkey, c_name AS title, CASE WHEN c_custkey % 2 = 0 THEN 'a=b' END AS note, CAST(CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n FROM customer")
def ffmetadata_parse(t: Tables) -> DataFrame:
    document = F.concat(F.lit(";FFMETADATA1\ntitle="), "c_name", F.lit("\n;x=y\n blank = \n"), F.when(F.col("c_custkey") % 2 == 0, "note=a\\=b\n").otherwise(""), F.lit("[STREAM]\nlate=1"))
    own = t.customer.select("c_custkey", text.metadata_tags(document).alias("m"))
    return own.select("c_custkey", F.col("m")["title"].alias("title"), F.col("m")["note"].alias("note"), F.size("m").cast("long").alias("n"))


@query("SELECT p_partkey, p_partkey % 5 = 4 AS deterministic FROM part")
def deterministic_parts(t: Tables) -> DataFrame:
    part = F.element_at(F.array(*map(F.lit, ["${env.HOME}", "context.os", "x:file(a)", "y:folder(b)", "plain ${inputs.a}"])), (F.col("p_partkey") % 5 + 1).cast("int"))
    return t.part.select("p_partkey", text.deterministic(part).alias("deterministic"))


@query("SELECT doc_id, sha256(CASE WHEN regexp_matches(source, '^src1[^/]*$') THEN regexp_replace(text, '[aeiou]', '.', 'g') WHEN regexp_matches(source, '^src[^/]$') THEN replace(text, 'the', 'THE') ELSE text END) AS h FROM documents")
def archive_transform(t: Tables) -> DataFrame:
    once = text.transformed(F.col("text"), F.col("source"), [("src?", "the", "THE")])
    once = F.when(F.col("source") == "src1", F.col("text")).otherwise(once)
    return t.documents.select("doc_id", content_hash(text.transformed(once, F.col("source"), [("src1*", "[aeiou]", ".")])).alias("h"))


@query("SELECT n_nationkey, n_name = 'n' AS eq, n_name < 'M' AS lt, n_name >= 'J' AS ge FROM nation")
def template_comparison(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", text.compared(F.col("n_name"), "==", F.lit("n")).alias("eq"), text.compared(F.col("n_name"), "<", F.lit("M")).alias("lt"), text.compared(F.col("n_name"), ">=", F.lit("J")).alias("ge"))


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN s_nationkey % 2 = 0 ELSE false END AS matches FROM supplier")
def version_spec_match(t: Tables) -> DataFrame:
    k = F.col("s_suppkey") % 4
    tag = F.when(k == 1, "t").when(k == 2, "t").when(k == 3, "other")
    version = F.when(k == 2, F.when(F.col("s_nationkey") % 2 == 0, "1").otherwise("2"))
    return t.supplier.select("s_suppkey", text.version_matches([tag, version], [F.lit("t"), F.lit("1")]).alias("matches"))


@query("SELECT p_partkey, CAST(CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 13 WHEN 2 THEN 17 ELSE 100 END AS INTEGER) AS priority FROM part")
def cover_priority(t: Tables) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ["front", "matrix/runout", "other", "hologram"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    return t.part.select("p_partkey", text.cover_priority(kind).cast("int").alias("priority"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'back,front' WHEN 1 THEN 'back,booklet,bottom,front,liner,matrix/runout,medium,obi,panel,poster,raw/unedited,spine,sticker,top,track,tray,watermark' ELSE 'booklet' END AS kinds, CASE p_partkey % 3 WHEN 0 THEN 'caa_release,url_relationships,caa_release_group' WHEN 1 THEN 'url_relationships,caa_release' ELSE 'local_files' END AS providers FROM part")
def cover_expressions(t: Tables) -> DataFrame:
    at = lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.col("p_partkey") % 3 + 1).cast("int"))
    kinds, providers = at(" Front, back", "all,-other", "booklet,top,!top"), at(" , ", "urlrels, caa_release,allowed_cover_art_urls", "Local Files")
    return t.part.select("p_partkey", F.array_join(text.cover_kinds(kinds), ",").alias("kinds"), F.array_join(text.cover_providers(providers), ",").alias("providers"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'u1200' WHEN 1 THEN 'full' || p_size ELSE 'u250' END AS url FROM part")
def cover_best_url(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 3
    image = F.when(k == 1, F.concat(F.lit("full"), F.col("p_size").cast("string"))).otherwise("  ")
    thumbs = F.when(k == 0, F.create_map(F.lit("1200"), F.lit("u1200"), F.lit("small"), F.lit("u"))).when(k == 1, F.create_map(F.lit("small"), F.lit(" "))).otherwise(F.create_map(F.lit("250"), F.lit("u250")))
    return t.part.select("p_partkey", text.best_cover_url(image, thumbs, [["1200", "large"]]).alias("url"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'a=' || c_name || ',b=2' WHEN 1 THEN NULL ELSE '' END AS pairs FROM customer")
def pair_parsing(t: Tables) -> DataFrame:
    k = F.col("c_custkey") % 3
    values = F.when(k == 0, F.array(F.lit(" a "), F.col("c_name"), F.lit("b"), F.lit("2"))).when(k == 1, F.array(F.lit("a"), F.lit("1"), F.lit("a"), F.lit("2"))).otherwise(F.array().cast("array<string>"))
    pairs = text.alternating_pairs(values)
    return t.customer.select("c_custkey", F.array_join(F.transform(pairs, lambda p: F.concat_ws("=", p["k"], p["v"])), ",").alias("pairs"))


@query("SELECT n_nationkey, 'APP_' || upper(n_name) || '_LINUX' || CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE '_DIR' END AS name FROM nation")
def environment_names(t: Tables) -> DataFrame:
    key = F.when(F.col("n_nationkey") % 2 == 0, "linux/bin/x").otherwise("linux/")
    return t.nation.select("n_nationkey", text.environment_name("APP", F.col("n_name"), key).alias("name"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(CASE WHEN v >= 0 AND v = floor(v) THEN v END AS BIGINT) AS n, l_linenumber = 1 OR l_linenumber % 2 = 0 AS ok FROM (SELECT *, (l_quantity - 10) / 2 AS v FROM lineitem)")
def value_predicates(t: Tables) -> DataFrame:
    allowed = F.when(F.col("l_linenumber") == 1, F.array().cast("array<int>")).otherwise(F.array(*map(F.lit, [2, 4, 6, 8])))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", text.whole_number((F.col("l_quantity") - 10) / 2).alias("n"), text.exit_ok(F.col("l_linenumber"), allowed).alias("ok"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'out' WHEN 'click' THEN 'err' ELSE 'both' END AS stream, CASE WHEN event_type <> 'click' THEN props || chr(10) END AS stdout, CASE WHEN event_type <> 'view' THEN props || chr(10) END AS stderr FROM events")
def echo(t: Tables) -> DataFrame:
    own = t.events.withColumn("stream", F.when(F.col("event_type") == "view", "out").when(F.col("event_type") == "click", "err").otherwise("both"))
    line = F.concat("props", F.lit("\n"))
    return own.select("event_id", "stream", F.when(F.col("stream").isin("out", "both"), line).alias("stdout"), F.when(F.col("stream").isin("err", "both"), line).alias("stderr"))


@query("SELECT user_id, arg_min(event_id, event_id) FILTER (event_type <> 'error') AS payload FROM events GROUP BY 1")
def candidate_fallback(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.min_by("event_id", F.when(F.col("event_type") != "error", F.col("event_id"))).alias("p"), F.max(F.col("event_type") != "error").alias("any")).select("user_id", F.when(F.col("any"), F.col("p")).alias("payload"))


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 3 THEN '..' WHEN 4 THEN c_name ELSE c_name || 'e' || chr(769) || '_' END AS safe, c_custkey % 5 IN (1, 4) AS valid FROM customer""")
def path_decomposition(t: Tables) -> DataFrame:
    """Names with an accent composed, decomposed, or beside a reserved character, `..`, and plain ones: one path for both accents."""
    kind, accent = F.col("c_custkey") % 5, F.lit("e\u0301")
    name = F.when(kind == 0, F.concat("c_name", F.lit("\u00e9_"))).when(kind == 1, F.concat("c_name", accent, F.lit("_"))).when(kind == 2, F.concat("c_name", accent, F.lit("?"))).when(kind == 3, "..").otherwise(F.col("c_name"))
    return t.customer.select("c_custkey", text.sanitized(name).alias("safe"), text.valid_component(name).alias("valid"))
