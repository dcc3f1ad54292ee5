"""Source divergence audit: how far the terms of each source stray from those of its language's other sources.

Terms are counted where the texts are, by DuckDB over blocks of texts, and the counts meet
in shards by a hash of language and term.  A shard is summed by DuckDB again and keeps the
terms that enough documents hold, each as one row with its counts by source.  Spark adds up
totals by source and language.  Every task of a second pass gets those totals with its
share of terms, and DuckDB makes from them partial sums for each pair of sources and the
best terms of each source; Spark merges sums and ranks.

Most terms are absent from most sources, and an absent term has the same share z in all of
a source's terms.  So a pair's sum over V terms is V |z - z'|, and, for terms that either
has, what |p - p'| differs from that: a part for each source by itself, from a histogram of its
shares, and a correction for terms that both have.  Only these last are met in a join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import stored
from lodestone.llm.textops import blocks

SHARDS = 1 << 16
#: Text of a block, and rows that a task's tables hold before they are summed and handed on.
BLOCK_BYTES = 4 << 20
ROWS = 200_000
#: The same for counts, which shrink the more, the more texts they come from.
COUNTS_HELD = 300_000
#: Texts are cut behind this many bytes at the next byte that isn't part of a term.
CUT = 1 << 16

#: p = 1 + floor(SCALE * (count + ADDED) / (total + ADDED * terms)).
SCALE, ADDED = 1_000_000_000, 5

_TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_NO_TERM = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
_COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def _database() -> duckdb.DuckDBPyConnection:
    """A database of one task; what it holds is bounded, so it needs no files."""
    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB", "temp_directory": "", "preserve_insertion_order": False})


def _batches(db: duckdb.DuckDBPyConnection, sql: str) -> Iterator[pa.RecordBatch]:
    """The rows of a query, with the plain string type that Spark reads."""
    table = db.sql(sql).to_arrow_table()
    plain = pa.schema([(f.name, pa.string() if pa.types.is_large_string(f.type) or pa.types.is_string_view(f.type) else f.type) for f in table.schema])
    yield from table.cast(plain).combine_chunks().to_batches(max_chunksize=50_000)


def _pieces(text: bytes) -> Iterator[bytes]:
    start = 0
    while len(text) - start > CUT and (cut := _NO_TERM.search(text, start + CUT)):
        yield text[start : cut.start()]
        start = cut.end()
    yield text[start:]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _COUNTS for a task's documents; several for one term where they don't fit."""
    db = _database()
    db.execute("CREATE TABLE counts (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
    summed = "SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, CAST(sum(docs) AS BIGINT) AS docs FROM counts GROUP BY ALL"
    rows = 0
    for batch, texts in blocks(batches, limit=BLOCK_BYTES):
        own, cut = [], []
        for i, text in enumerate(texts):
            for piece in _pieces((text or b"").lower()):  # bytes: A-Z only
                own.append(i)
                cut.append(piece)
        db.register("texts", pa.table({"doc": pa.array(own, pa.int32()), "text": pa.array(cut, pa.binary()).cast(pa.string())}))
        db.register("docs", pa.table({"doc": pa.array(range(len(texts)), pa.int32()), "lang": batch.column("lang"), "source": batch.column("source")}))
        rows += db.execute(f"""
            INSERT INTO counts
            WITH terms AS (SELECT doc, unnest(regexp_extract_all(text, '{_TERM}')) AS term FROM texts),
            by_doc AS (SELECT doc, term, count(*) AS n FROM terms GROUP BY ALL)
            SELECT lang, source, term, sum(n), count(*) FROM by_doc JOIN docs USING (doc) GROUP BY ALL""").fetchall()[0][0]
        if rows > 2 * COUNTS_HELD:
            db.execute(f"CREATE TABLE merged AS {summed}")
            db.execute("DROP TABLE counts")
            db.execute("ALTER TABLE merged RENAME TO counts")
            rows = db.execute("SELECT count(*) FROM counts").fetchall()[0][0]
        if rows > COUNTS_HELD:
            yield from _batches(db, "SELECT * FROM counts")
            db.execute("DELETE FROM counts")
            rows = 0
    yield from _batches(db, summed)
    db.close()


def _kept(counts: DataFrame, min_docs: int) -> DataFrame:
    """lang, term, sources, counts of the terms that at least min_docs documents of the language hold."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = _database()
        held: list[pa.RecordBatch] = []
        names = ["shard", "lang", "source", "term", "n", "docs"]

        def kept(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            db.register("counts", rows)
            yield from _batches(
                db,
                f"""WITH summed AS (SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, sum(docs) AS docs FROM counts GROUP BY ALL)
                SELECT lang, term, list(source ORDER BY source) AS sources, list(n ORDER BY source) AS counts FROM summed GROUP BY lang, term HAVING sum(docs) >= {min_docs}""",
            )

        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size > ROWS:
                rows = pa.Table.from_batches(held)
                db.register("counts", rows)
                last = rows.column("shard")[-1].as_py()
                yield from kept(db.sql(f"SELECT * FROM counts WHERE shard < {last}").to_arrow_table())
                db.register("counts", rows)
                rest = db.sql(f"SELECT shard, lang, source, term, CAST(sum(n) AS BIGINT) AS n, CAST(sum(docs) AS BIGINT) AS docs FROM counts WHERE shard = {last} GROUP BY ALL").to_arrow_table()
                held = rest.select(names).cast(batch.select(names).schema).to_batches()
                size = max(0, rest.num_rows - ROWS // 2)  # what one shard needs doesn't count
        if held:
            yield from kept(pa.Table.from_batches(held))
        db.close()

    sharded = counts.select(F.pmod(F.xxhash64("lang", "term"), F.lit(SHARDS)).cast("int").alias("shard"), "lang", "source", "term", "n", "docs")
    return sharded.repartition("shard").sortWithinPartitions("shard").mapInArrow(shards, "lang string, term string, sources array<string>, counts array<bigint>")


_AUDIT = "part string, lang string, source string, item string, value bigint"


def _audited(kept: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """Rows of _AUDIT: partial sums of pairs of sources (source < item), and each source's best terms of a task."""
    chunks = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    terms = kept.select(F.pmod(F.xxhash64("term"), F.lit(chunks)).cast("int").alias("chunk"), F.lit(1).alias("kind"), "lang", "term", "sources", "counts", *[F.lit(0).cast("long").alias(c) for c in ("total", "lang_total", "terms")])
    every = groups.select(
        F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(0).alias("kind"), "lang", F.lit("").alias("term"), F.array("source").alias("sources"), F.array(F.lit(0).cast("long")).alias("counts"), "total", "lang_total", "terms"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = _database()
        db.execute("CREATE TABLE sums (a BIGINT, b BIGINT, v BIGINT)")
        db.execute("CREATE TABLE best (g BIGINT, term VARCHAR, v BIGINT)")
        first: list[pa.RecordBatch] = []  # the totals of all sources, which come first
        begun = False
        held: list[pa.RecordBatch] = []
        size = 0

        def begin() -> None:
            db.register("totals", pa.Table.from_batches(first))
            db.execute(f"""
                CREATE TABLE groups AS SELECT *, row_number() OVER (ORDER BY lang, source) AS g, CAST(1 + {SCALE}::HUGEINT * {ADDED} // nullif(all_added, 0) AS BIGINT) AS z FROM (
                  SELECT DISTINCT lang, sources[1] AS source, total::HUGEINT + {ADDED} * terms AS all_added, lang_total::HUGEINT + {ADDED} * terms AS lang_added FROM totals)""")

        def work(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            db.register("rows", pa.Table.from_batches(rows))
            db.execute("CREATE OR REPLACE TEMP TABLE terms AS SELECT row_number() OVER () AS t, lang, term, sources, counts FROM rows")
            db.execute(f"""
                CREATE OR REPLACE TEMP TABLE shares AS
                SELECT t, g, lang, z, n, lang_added, CAST(1 + {SCALE}::HUGEINT * (n + {ADDED}) // all_added AS BIGINT) AS p
                FROM (SELECT t, lang, unnest(sources) AS source, unnest(counts) AS n FROM terms) JOIN groups USING (lang, source)""")
            db.execute("""
                INSERT INTO sums
                SELECT a.g, b.g, sum(abs(a.p - b.p) - abs(a.p - b.z) - abs(a.z - b.p) + abs(a.z - b.z)) FROM shares a JOIN shares b ON a.t = b.t AND a.g < b.g GROUP BY ALL
                UNION ALL
                SELECT least(x.g, h.g), greatest(x.g, h.g), sum(k * (abs(x.p - h.z) - abs(x.z - h.z)))
                FROM (SELECT g, lang, z, p, count(*) AS k FROM shares GROUP BY ALL) x JOIN groups h ON h.lang = x.lang AND h.g <> x.g GROUP BY ALL""")
            db.execute(f"""
                INSERT INTO best
                WITH whole AS (SELECT t, CAST(1 + {SCALE}::HUGEINT * (sum(n) + {ADDED}) // any_value(lang_added) AS BIGINT) AS q FROM shares GROUP BY t)
                SELECT g, term, p - q AS v FROM shares JOIN whole USING (t) JOIN terms USING (t) WHERE p > q
                QUALIFY row_number() OVER (PARTITION BY g ORDER BY p - q DESC, term) <= {top}""")
            if max(db.execute("SELECT (SELECT count(*) FROM sums), (SELECT count(*) FROM best)").fetchall()[0]) > ROWS:
                yield from finish()

        def finish() -> Iterator[pa.RecordBatch]:
            yield from _batches(
                db,
                f"""SELECT 'pair' AS part, x.lang, x.source, y.source AS item, v AS value FROM (SELECT a, b, CAST(sum(v) AS BIGINT) AS v FROM sums GROUP BY ALL) JOIN groups x ON a = x.g JOIN groups y ON b = y.g
                UNION ALL
                SELECT 'term', lang, source, term, v FROM (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY g ORDER BY v DESC, term) <= {top}) JOIN groups USING (g)""",
            )
            db.execute("DELETE FROM sums")
            db.execute("DELETE FROM best")

        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            n_groups = int((kinds == 0).sum())
            if n_groups:
                first.append(batch.slice(0, n_groups))
            if n_groups == batch.num_rows:
                continue
            if not begun:
                begin()
                begun = True
            held.append(batch.slice(n_groups))
            size += len(held[-1].column("sources").flatten())
            if size > ROWS:
                yield from work(held)
                held, size = [], 0
        if held:
            yield from work(held)
        if begun:
            yield from finish()
        db.close()

    return terms.unionAll(every).repartition("chunk").sortWithinPartitions("kind").mapInArrow(run, _AUDIT)


def divergence_audit(docs: DataFrame, min_docs: int = 30, top_terms: int = 50) -> DataFrame:
    """Compares the sources of each language by the shares of their terms.

    Reads `text`, `lang` and `source` of docs, null being ''; every row is a document, rows
    that repeat each other too, and other columns aren't read.  Terms are runs of letters A-Z and of characters beyond
    ASCII, with A-Z lower-cased.  A language keeps the terms that at least min_docs of its documents
    hold.  A kept term's share in a source, or in the language, is
    1 + floor(SCALE * (count + ADDED) / (total + ADDED * kept terms)), in whole numbers.

    Returns lang, source, part, item, value, rank: for part `pair` the source's distance
    to each other source of its language (item), the sum over kept terms of their shares' differences (0 without
    kept terms); for part `term` the top_terms kept terms that the source has and in which its share exceeds the language's
    most, and by how much.  rank counts from 1 by source and part, from the
    largest value on, ties by item.  A source without terms is compared like any other; an empty table gives no rows.
    """
    texts = docs.select("text", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")])
    kept = stored(_kept(texts.mapInArrow(_counted, _COUNTS), min_docs), "terms")
    by_source = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("total"))
    by_lang = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("lang_total"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "lang_total", "terms")]
    groups = stored(texts.select("lang", "source").distinct().join(by_source, ["lang", "source"], "left").join(by_lang, "lang", "left").select("lang", "source", *zero), "sources")
    audit = stored(_audited(kept, groups, top_terms), "audit")
    absent = groups.select("lang", "source", "terms", F.expr(f"CASE WHEN terms = 0 THEN 0L ELSE 1 + {SCALE * ADDED}L div (total + {ADDED} * terms) END").alias("z"))
    other = absent.select("lang", F.col("source").alias("item"), F.col("z").alias("other_z"))
    base = absent.join(other, "lang").filter(F.col("source") < F.col("item")).select("lang", "source", "item", (F.col("terms") * F.abs(F.col("z") - F.col("other_z"))).alias("value"))
    pairs = base.unionAll(audit.filter("part = 'pair'").select("lang", "source", "item", "value")).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x")
    pairs = pairs.select("lang", both, "value").select("lang", "x.source", "x.item", F.lit("pair").alias("part"), "value")
    terms = audit.filter("part = 'term'").select("lang", "source", "item", "part", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")).alias("rank")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select("*", rank).select(*columns).unionAll(terms.select("*", rank).filter(F.col("rank") <= top_terms).select(*columns))
