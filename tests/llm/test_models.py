"""Learned operators: by held-out accuracy, and against a model written out by hand."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm.langid import UNKNOWN, predict_languages, train_languages
from lodestone.llm.ngramlm import DISCOUNTS, EliasFano, language_model_scores
from lodestone.llm.quality import score_quality, train_quality
from lodestone.llm.toxicity import score_toxicity, train_toxicity

SYLLABLES = {"aa": "ka lo mi ren tas", "bb": "schu ver gen lich tze", "cc": "eau oux é ç tion"}


def text_in(lang, rng, n=40):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_languages(spark):
    rng = random.Random(1)
    rows = [(i, text_in(lang, rng), lang) for i, lang in enumerate(rng.choice(list(SYLLABLES)) for _ in range(240))]
    filters = train_languages(spark.createDataFrame(rows[:160] + [(998, None, "aa"), (999, "x", None)], "doc_id bigint, text string, lang string"))
    odd = [(1000, None, None), (1001, "", None), (1002, "12 .. 4", None), (1003, "\x00", None)]
    got = {r.doc_id: r for r in predict_languages(spark.createDataFrame(rows[160:] + odd, "doc_id bigint, text string, lang string"), filters).collect()}
    assert np.mean([got[i]._lang == lang for i, _, lang in rows[160:]]) > 0.97
    assert all(0 <= r._lang_score <= 1 for r in got.values())
    assert [got[i]._lang for i in range(1000, 1004)] == [UNKNOWN] * 4
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert [r._lang for r in predict_languages(spark.createDataFrame(rows[:1], empty.schema), train_languages(empty)).collect()] == [UNKNOWN]


def test_toxicity_and_quality(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(400):
        toxic, bad = rng.random() < 0.3, rng.random() < 0.4
        own = [f"w{rng.randrange(200)}" for _ in range(150)]
        if toxic:
            for _ in range(4):
                own[rng.randrange(150)] = rng.choice(["vilething", "nastything"])
        docs.append((i, " ".join(w + "%%%" if bad and n > 70 else w for n, w in enumerate(own)), "noise"))
        labels.append((i, int(not bad), int(toxic)))
    docs += [(900, None, "n"), (901, "", "n"), (902, "ok", "n"), docs[0]]
    labels += [(None, 1, 1), (3, None, None)]
    d, l = spark.createDataFrame(docs, "doc_id bigint, text string, label string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    train = l.filter("doc_id is null or doc_id % 3 <> 1")
    truth = {i: (q, t) for i, q, t in labels if q is not None}
    toxic = {r.doc_id: r._score for r in score_toxicity(d, train_toxicity(d, train, l1=3.0)).collect()}
    quality = {r.doc_id: r._score for r in score_quality(d, train_quality(d, train)).collect()}
    held = [i for i in range(400) if i % 3 == 1]
    assert np.mean([(toxic[i] >= 0.5) == bool(truth[i][1]) for i in held]) > 0.95
    assert np.mean([(quality[i] >= 0.5) == bool(truth[i][0]) for i in held]) > 0.95
    assert all(0 <= x <= 1 for x in [*toxic.values(), *quality.values()]) and {900, 901, 902} <= toxic.keys() & quality.keys()
    none = l.filter("false")
    assert {r._score for r in score_quality(d, train_quality(d, none)).collect()} == {0.5}
    assert {r._score for r in score_toxicity(d, train_toxicity(d, none)).collect()} == {0.5}
    assert score_toxicity(d.filter("false"), train_toxicity(d, train)).count() == 0


@pytest.mark.parametrize("universe", [1 << 8, 1 << 20, 1 << 63])
def test_elias_fano(universe):
    rng = np.random.default_rng(universe % 97)
    values = np.unique(rng.integers(0, universe, 300, dtype=np.uint64))
    coded = EliasFano(*EliasFano.parts(values, universe))
    assert (coded.values() == values).all()
    asked = np.concatenate([values, rng.integers(0, universe, 300, dtype=np.uint64)])
    held = {int(v): i for i, v in enumerate(values)}
    assert coded.find(asked).tolist() == [held.get(int(v), -1) for v in asked]
    assert EliasFano(*EliasFano.parts(values[:0], universe)).find(asked[:3]).tolist() == [-1, -1, -1]


def by_hand(rows, learns):
    tokens = [[*(t or "").encode().lower().split(), "end"] for _, t in rows]
    count, pairs, context = Counter(), Counter(), Counter()
    for own, l in zip(tokens, learns, strict=True):
        for before, w in zip(["begin", *own], own) if l else ():
            count[w] += 1
            pairs[before, w] += 1
            context[before] += 1
    n, v, back = sum(count.values()), len(count), defaultdict(float)
    for (before, _), c in pairs.items():
        back[before] += DISCOUNTS[min(c, 3)] / context[before]
    for own in tokens:
        base = score = 0.0
        for before, w in zip(["begin", *own], own):
            p, c = (count[w] + 1) / (n + v + 1), pairs[before, w]
            base += math.log10(p)
            score += math.log10((c - DISCOUNTS[min(c, 3)]) / context[before] * (c > 0) + back[before] * p if context[before] else p)
        yield len(own), sum(count[w] > 0 for w in own), n, base, score


@pytest.mark.parametrize("chunk", [200, 1 << 20])
def test_language_model(spark, chunk):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["the", "The", "a", *(f"w{j}" for j in range(30))]) for _ in range(rng.randrange(0, 60)))) for i in range(80)]
    rows += [(80, None), (81, ""), (82, rows[3][1]), (None, "the a the"), rows[5]]
    learns = [i is None or i % 7 != 2 for i, _ in rows]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, score string")
    got = language_model_scores(docs, F.col("doc_id").isNull() | (F.col("doc_id") % 7 != 2), chunk_bytes=chunk, shards=5).collect()
    want = sorted(((str(r[0]), str(l), *x) for r, l, x in zip(rows, learns, by_hand(rows, learns), strict=True)), key=str)
    have = sorted(((str(r.doc_id), str(r.learned), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=str)
    assert len(have) == len(want)
    for h, w in zip(have, want, strict=True):
        assert h[:5] == w[:5] and abs(h[5] - w[5]) < 1e-9 and abs(h[6] - w[6]) < 0.05 * w[2]
    assert language_model_scores(docs.filter("false"), F.lit(True)).collect() == []
    assert {r.score for r in language_model_scores(docs, F.lit(False)).collect()} == {0.0}
