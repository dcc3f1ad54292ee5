"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.ann import nearest_neighbours
from lodestone.llm.bestfit import best_fit_pack
from lodestone.llm.decontam import mark_contamination
from lodestone.llm.divergence import divergence_audit
from lodestone.llm.langid import predict_languages, train_languages
from lodestone.llm.linededup import drop_repeated_lines
from lodestone.llm.merkle import leaf, merkle_manifest, others_digest, with_folded_root
from lodestone.llm.minhash import near_duplicate_classes
from lodestone.llm.ngramlm import language_model_scores
from lodestone.llm.packing import added_tokens, pack_sequences
from lodestone.llm.quality import score_quality, train_quality
from lodestone.llm.substring import remove_repeated_substrings
from lodestone.llm.toxicity import score_toxicity, train_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha256(column: str) -> F.Column:
    return F.sha2(F.col(column).cast("binary"), 256)


def _crc_mod(doc_id: str, n: int) -> F.Column:
    """The remainder of crc32(doc_id as text); a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % n


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicate_classes(_table(spark, sf_dir, "documents"), shingle=4, percent=80)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), "kept").alias("kept"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    filters = train_languages(docs.filter(_crc_mod("doc_id", 5) != 0), sample_by="doc_id")
    out = predict_languages(docs.select("doc_id", "text"), filters)
    return out.select("doc_id", (_crc_mod("doc_id", 5) == 0).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_lang_score").alias("score"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = language_model_scores(docs, _crc_mod("doc_id", 7) != 2)
    return out.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_substrings(_table(spark, sf_dir, "documents"), window=20)
    return out.select("doc_id", "n_words", "n_removed", _sha256("text").alias("kept_sha256"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_repeated_lines(docs, min_docs=10, min_chars=1)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), _sha256("text").alias("kept_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    specials = added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return pack_sequences(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, special_tokens=specials)


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    model = train_quality(docs, labels.filter(_crc_mod("doc_id", 3) != 1))
    out = score_quality(docs, model)
    return out.select("doc_id", (_crc_mod("doc_id", 3) == 1).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mark_contamination(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"), window=10)
    return out.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.col("_n_hit").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("_n_hit") > 0).alias("contaminated"),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    model = train_toxicity(docs, labels.filter(_crc_mod("doc_id", 3) != 1))
    out = score_toxicity(docs, model)
    return out.select("doc_id", (_crc_mod("doc_id", 3) == 1).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.7).cast("int").alias("predicted"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit(_table(spark, sf_dir, "documents"), min_docs=30, top_terms=50)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")

    def row_leaf(n_chars: F.Column) -> F.Column:
        return leaf([F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")])

    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, row_leaf(F.col("n_chars") + 1))
    rows = docs.select("doc_id", "lang", row_leaf(F.col("n_chars")).alias("own"), tampered.alias("tampered"))
    out = merkle_manifest(rows, F.col("own"), F.col("lang"), [F.col("doc_id")], fanout=2, levels=10, keep=("doc_id", "tampered"))
    folded = with_folded_root(out.withColumn("claimed", F.coalesce("tampered", "leaf")), "claimed")
    return folded.select("doc_id", "leaf", "subroot", "root", others_digest().alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    specials = added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return best_fit_pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, capacity=2048, special_tokens=specials)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_language_id": op2_language_id,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_packing": op6_packing,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_toxicity": op10_toxicity,
    "op11_source_divergence": op11_source_divergence,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_best_fit_packing": op13_best_fit_packing,
}

_ITEM_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_FIELD = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "({n})", "text"))

SQL: dict[str, str] = {
    "op1_minhash_near_dedup": rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, list_aggregate(w[s.i : s.i + 3], 'string_agg', ' ') AS k
  FROM words, LATERAL (SELECT unnest(range(1, greatest(len(w) - 2, 2))) AS i) s WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)""",
    "op4_substring_dedup": rf"""
WITH words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
windows AS (
  SELECT doc_id, s.start AS start, list_aggregate(w[s.start : s.start + 19], 'string_agg', ' ') AS k
  FROM words, LATERAL (SELECT unnest(range(1, len(w) - 18)) AS start) s),
first AS (SELECT k, min({{'d': doc_id, 's': start}}) AS f, count(*) AS n FROM windows GROUP BY k HAVING count(*) > 1),
hits AS (SELECT doc_id, unnest(range(start, start + 20)) AS i FROM windows JOIN first USING (k) WHERE (doc_id, start) <> (f.d, f.s)),
gone AS (SELECT doc_id, list(DISTINCT i) AS g FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(g, []), i)), ' '), '')) AS kept_sha256
FROM words LEFT JOIN gone USING (doc_id)""",
    "op5_line_dedup": rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
keyed AS (SELECT *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS k FROM lines),
bad AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
told AS (SELECT doc_id, i, line, k IN (SELECT k FROM bad) AS gone FROM keyed)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM told GROUP BY doc_id""",
    "op9_benchmark_decontamination": rf"""
WITH docs AS (SELECT doc_id, {_ITEM_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
items AS (SELECT item_id, {_ITEM_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[s.i : s.i + least(10, len(w)) - 1], ' ') AS k
  FROM items, LATERAL (SELECT unnest(range(1, greatest(len(w) - 8, 2))) AS i) s WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM item_windows),
doc_windows AS (
  SELECT doc_id, size, s.i AS i, array_to_string(w[s.i : s.i + size - 1], ' ') AS k
  FROM docs, sizes, LATERAL (SELECT unnest(range(1, len(w) - size + 2)) AS i) s WHERE len(w) >= size),
hits AS (SELECT doc_id, item_id, d.size, i FROM doc_windows d JOIN item_windows m ON d.k = m.k AND d.size = m.size),
covered AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS j FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(found.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op11_source_divergence": rf"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
terms AS (SELECT d, lang, source, unnest(regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM (SELECT DISTINCT d, lang, term FROM terms) GROUP BY ALL HAVING count(*) >= 30),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM terms JOIN kept USING (lang, term) GROUP BY ALL),
dense AS (SELECT g.lang, g.source, k.term, CAST(coalesce(n, 0) AS HUGEINT) AS n, CAST(count(*) OVER (PARTITION BY g.lang, g.source) AS HUGEINT) AS v FROM groups g JOIN kept k USING (lang) LEFT JOIN counts USING (lang, source, term)),
own AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM dense),
by_lang AS (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n, any_value(v) AS v FROM dense GROUP BY ALL),
whole AS (SELECT lang, term, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM by_lang),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(f, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS f FROM own x JOIN own y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, p - q FROM own JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50""",
    "op12_merkle_manifest": f"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b) ORDER BY b) AS t FROM range(256) r(b)),
rows AS (
  SELECT doc_id, lang, n_chars, source, text, doc_id IS NOT NULL AND
    xor(4294967295, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT)), lambda c, d: xor(c // 256, t[1 + xor(c, d) % 256]), 4294967295)) % 7 = 0 AS odd
  FROM documents, crc_table),
leaves AS (
  SELECT doc_id, lang, sha256({_LEAF.format(n="n_chars")}) AS leaf, CASE WHEN odd THEN sha256({_LEAF.format(n="n_chars + 1")}) END AS tampered FROM rows),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
tree AS (
  SELECT lang, 0 AS level, i, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM placed
  UNION ALL
  SELECT lang, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM tree WHERE n > 1 GROUP BY lang, level, i // 2),
tops AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i FROM tree WHERE n = 1),
upper AS (
  SELECT 0 AS level, i, h, count(*) OVER () AS n FROM tops
  UNION ALL
  SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM upper WHERE n > 1 GROUP BY level, i // 2),
climb AS (
  SELECT p.doc_id, p.lang, p.i AS row, 0 AS level, p.i, p.leaf, coalesce(p.tampered, p.leaf) AS folded, '' AS proof, t.n FROM placed p JOIN tree t ON p.lang IS NOT DISTINCT FROM t.lang AND t.level = 0 AND t.i = p.i
  UNION ALL
  SELECT c.doc_id, c.lang, c.row, c.level + 1, c.i // 2, c.leaf, sha256(CASE WHEN c.i % 2 = 1 THEN coalesce(s.h, '') || c.folded ELSE c.folded || coalesce(s.h, '') END), c.proof || coalesce(s.h, ''), (c.n + 1) // 2
  FROM climb c LEFT JOIN tree s ON c.lang IS NOT DISTINCT FROM s.lang AND s.level = c.level AND s.i = xor(c.i, 1) WHERE c.n > 1),
climb_top AS (
  SELECT c.doc_id, c.leaf, o.h AS subroot, 0 AS level, o.i, c.folded, c.proof, u.n FROM climb c JOIN tops o ON c.lang IS NOT DISTINCT FROM o.lang JOIN upper u ON u.level = 0 AND u.i = o.i WHERE c.n = 1
  UNION ALL
  SELECT c.doc_id, c.leaf, c.subroot, c.level + 1, c.i // 2, sha256(CASE WHEN c.i % 2 = 1 THEN coalesce(s.h, '') || c.folded ELSE c.folded || coalesce(s.h, '') END), c.proof || coalesce(s.h, ''), (c.n + 1) // 2
  FROM climb_top c LEFT JOIN upper s ON s.level = c.level AND s.i = xor(c.i, 1) WHERE c.n > 1)
SELECT doc_id, leaf, subroot, u.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = u.h AS verified
FROM climb_top c JOIN upper u ON u.n = 1 WHERE c.n = 1""",
}
