"""The source divergence audit against sums over all kept terms, written out plainly."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from lodestone.llm import divergence
from lodestone.llm.divergence import divergence_audit

WORD = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, min_docs, top):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = [w.decode() for w in WORD.findall((text or "").encode().lower())]
        counts[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    for lang in {g for g, _ in counts}:
        kept = {t for t, n in docs[lang].items() if n >= min_docs}
        sources = [s for g, s in counts if g == lang]

        def shares(count):
            total = sum(count[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (count[t] + 5) // total for t in kept}  # noqa: B023

        own = {s: shares(counts[lang, s]) for s in sources}
        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(-sum(abs(own[s][t] - own[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(whole[t] - own[s][t], t.encode()) for t in kept if counts[lang, s][t] and own[s][t] > whole[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


def rows_of(out):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in out.collect())


@pytest.mark.parametrize("rows_held", [divergence.ROWS, 40])
def test_against_plain_sums(spark, monkeypatch, rows_held):
    monkeypatch.setattr(divergence, "ROWS", rows_held)
    monkeypatch.setattr(divergence, "COUNTS_HELD", rows_held)
    monkeypatch.setattr(divergence, "BLOCK_BYTES", 500)
    monkeypatch.setattr(divergence, "CUT", 64)
    rng = random.Random(5)
    words = [*"the The of été Été ÉTÉ 日本 straße a I'm x1y über".split(), *(f"w{chr(97 + i)}" for i in range(26))]
    rows = []
    for i in range(300):
        source = rng.choice([None, "", "a", "b", "ü", "z", "hot", "hot", "hot"])
        text = rng.choice([None, "", "12 34 -- \x00", " ".join(rng.choices(words, weights=[100 / (j + 1 + i % 7) for j in range(len(words))], k=rng.randint(1, 60)))])
        rows.append((text, rng.choice([None, "en", "en", "de", "one"]) if source != "z" else "de", source))
    rows += [(None, "xx", "only"), ("1 2", "yy", "p"), (None, "yy", "q"), ("rare words", "yy", "r"), ("q" * 5000 + " the" * 5000, "en", "long"), *[("of the same", "en", "b")] * 9]
    df = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "'clash' AS term", "1 AS n", "2 AS docs")
    want = plain(rows, 5, 4)
    assert {r[2] for r in want} == {"pair", "term"} and any(r[5] == 4 for r in want)
    assert rows_of(divergence_audit(df.repartition(3), min_docs=5, top_terms=4)) == want


def test_no_documents(spark):
    assert divergence_audit(spark.createDataFrame([], "text string, lang string, source string")).collect() == []


def test_counts_beyond_32_bits_stay_exact(spark):
    """Shares of a term that occurs thousands of millions of times."""
    n = 9 * 10**9
    kept = spark.createDataFrame([("en", "the", ["a", "b"], [n, n // 3]), ("en", "of", ["b"], [7])], "lang string, term string, sources array<string>, counts array<bigint>")
    groups = spark.createDataFrame([("en", "a", n, n + n // 3 + 7, 2), ("en", "b", n // 3 + 7, n + n // 3 + 7, 2)], "lang string, source string, total bigint, lang_total bigint, terms bigint")
    share = lambda c, total: 1 + 10**9 * (c + 5) // (total + 10)
    out = {(r.part, r.source, r.item): r.value for r in divergence._audited(kept, groups, 5).groupBy("part", "source", "item").agg({"value": "sum"}).withColumnRenamed("sum(value)", "value").collect()}
    za, zb = share(0, n), share(0, n // 3 + 7)
    whole = abs(share(n, n) - share(n // 3, n // 3 + 7)) + abs(za - share(7, n // 3 + 7))
    assert out["pair", "a", "b"] + 2 * abs(za - zb) == whole
    assert out["term", "b", "of"] == share(7, n // 3 + 7) - share(7, n + n // 3 + 7)
