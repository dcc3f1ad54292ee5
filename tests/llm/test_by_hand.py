"""Learned operators against plain re-computations, and all operators on odd tables and very long texts."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestone.llm import langid, quality, substring, toxicity
from lodestone.llm.decontam import mark_contamination
from lodestone.llm.linededup import drop_repeated_lines, plane_bits
from lodestone.llm.minhash import near_duplicate_classes
from lodestone.llm.ngramlm import language_model_scores
from lodestone.llm.packing import pack_sequences
from lodestone.llm.substring import remove_repeated_substrings
from lodestone.llm.textops import NON_SPACE, mix64, window_hashes, words_of

CLASHING = "doc_id bigint, text string, lang string, _score double, _lang string, _n_hit string, _id int, at string, label string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, l, 0.5, "x", "y", 1, "z", "w") for i, t, l in rows], CLASHING)


def grams_by_hand(text):
    folded, out = " ", []
    for b in (text or "").encode() + b" ":
        c = chr(b) if 0x61 <= b <= 0x7A or b >= 0x80 else chr(b + 32) if 0x41 <= b <= 0x5A else " "
        if c != " " or folded[-1] != " ":
            folded += c
    for i in range(len(folded) - 3):
        n = 0
        for c in folded[i : i + 4]:
            n = n << 8 | ord(c)
        out.append(n)
    return out


def slots_by_hand(gram):
    return (gram * 0x9E3779B1 & 0xFFFFFFFF) >> 12, ((gram ^ gram >> 15) * 0x85EBCA77 & 0xFFFFFFFF) >> 12


@pytest.mark.parametrize("n_languages", [3, 70])
def test_language_filters_by_hand(spark, n_languages):
    rng = random.Random(n_languages)
    letters = [chr(97 + i) for i in range(26)] + ["é", "ü", "ж", "я"]
    parts = {f"l{i:02d}": ["".join(rng.choice(letters) for _ in range(3)) for _ in range(6)] for i in range(n_languages)}
    text = lambda lang: "  ".join("".join(rng.choice(parts[lang]) for _ in range(3)).title() for _ in range(25))
    rows = [(i, text(lang), lang) for i, lang in enumerate(lang for lang in parts for _ in range(6))]
    counts = {lang: Counter(g for _, t, l in rows if l == lang for g in grams_by_hand(t)) for lang in parts}
    counts = {lang: {g: n for g, n in c.items() if n >= 2} for lang, c in counts.items()}
    share = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    best = {g: max(s.get(g, 0) for s in share.values()) for c in counts.values() for g in c}
    held = {lang: {slot for g, n in s.items() if n >= 0.4 * best[g] for slot in slots_by_hand(g)} for lang, s in share.items()}
    wrong = {lang: min((len(h) / 2**20) ** 2, 0.999) for lang, h in held.items()}
    asked = [*rows[::5], (9000, text("l00") + " " + text("l01"), None), (9000, "ABC", None), (None, "  1 ", None), (9001, None, None), rows[0]]
    got = langid.predict_languages(frame(spark, asked).select("doc_id", "text", "lang", "at"), langid.train_languages(frame(spark, rows))).collect()
    assert len(got) == len(asked)
    hand = {}
    for _, t, _ in asked:
        grams = grams_by_hand(t)
        hits = {lang: sum(a in h and b in h for a, b in map(slots_by_hand, grams)) for lang, h in held.items()}
        likely = {lang: max((n - len(grams) * wrong[lang]) / (1 - wrong[lang]), 0.0) for lang, n in hits.items()}
        top = max(sorted(likely), key=likely.get)
        known = t is not None and any(map(str.isalpha, t))
        hand[t] = ("und", 0.0) if not known else (top, likely[top] / sum(likely.values()) if likely[top] > 0 else 1 / n_languages)
    for r in got:
        assert r._lang == hand[r.text][0] and abs(r._lang_score - hand[r.text][1]) < 1e-9
    empty = langid.predict_languages(frame(spark, []), langid.train_languages(frame(spark, rows)))
    assert empty.count() == 0 and empty.schema["_lang"].dataType.simpleString() == "string"
    assert {r._lang for r in langid.predict_languages(frame(spark, rows[:2]), langid.train_languages(frame(spark, []))).collect()} == {"und"}


def test_ftrl_by_hand():
    rng = random.Random(5)
    examples = [(np.array(sorted(rng.sample(range(40), rng.randrange(1, 9))), dtype=np.int32), rng.randrange(2)) for _ in range(60)]
    alpha, beta, l1, l2, epochs = 0.7, 1.0, 0.3, 0.1, 3
    z, n, bias_z, bias_n = Counter(), Counter(), 0.0, 0.0
    weight = lambda z, n, cut: 0.0 if abs(z) <= cut else -(z - math.copysign(cut, z)) / ((beta + math.sqrt(n)) / alpha + l2)
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(examples)):
            slots, label = examples[i]
            w = {s: weight(z[s], n[s], l1) for s in slots.tolist()}
            bias = weight(bias_z, bias_n, 0.0)
            g = 1 / (1 + math.exp(-(sum(w.values()) + bias))) - label
            for s in w:
                z[s] += g - (math.sqrt(n[s] + g * g) - math.sqrt(n[s])) / alpha * w[s]
                n[s] += g * g
            bias_z += g - (math.sqrt(bias_n + g * g) - math.sqrt(bias_n)) / alpha * bias
            bias_n += g * g
    model = toxicity.ftrl(examples, alpha, beta, l1, l2, epochs)
    want = {s: w for s in sorted(z) if (w := weight(z[s], n[s], l1))}
    assert model.slots.tolist() == list(want) and 0 < len(want) < len(z)
    assert np.allclose(model.weights, list(want.values()), rtol=1e-5) and abs(model.bias - weight(bias_z, bias_n, 0.0)) < 1e-9


def test_toxicity_features_and_scores_by_hand(spark):
    text = "Bad words, bad WORDS bad; wordsmith ö12 x"
    words = ["bad", "words", "bad", "words", "bad", "wordsmith", "ö12", "x"]
    own = Counter([("word", w) for w in words] + [("stem", k, w.encode()[:k]) for w in words for k in toxicity.STEMS] + [("pair", *p) for p in zip(words, words[1:])] + [("skip", *p) for p in zip(words, words[2:])])
    _, slots = toxicity.features([text.encode()])
    assert sorted(Counter(slots.tolist()).values()) == sorted(own.values())
    leveled = toxicity.leveled(slots)
    assert [int((leveled >> toxicity.SLOT_BITS == i).sum()) for i in range(3)] == [sum(n > i for n in own.values()) for i in range(3)]
    rng = np.random.default_rng(1)
    some = np.sort(rng.choice(leveled, 12, replace=False))
    model = toxicity.Model(0.25, some, rng.normal(size=12).astype(np.float32))
    rows = [(1, text, None), (1, text, None), (2, None, None), (None, "", None), (3, "nothing known", None)]
    got = toxicity.score_toxicity(frame(spark, rows), model).collect()
    base = 1 / (1 + math.exp(-0.25))
    whole = 1 / (1 + math.exp(-(0.25 + sum(model.weights.tolist()))))
    assert [round(r._score, 6) for r in got] == [round(x, 6) for x in (whole, whole, base, base, base)]
    assert toxicity.score_toxicity(frame(spark, []), model).count() == 0


def test_attention_by_hand(spark):
    rng = np.random.default_rng(4)
    f, h, g = quality.FEATURES, quality.HIDDEN, quality.GATE
    m = quality.Model(rng.normal(0, 0.1, f), rng.uniform(0.5, 1, f), rng.normal(0, 0.3, (f, h)), rng.normal(size=h), rng.normal(size=(h, g)), rng.normal(size=(h, g)), rng.normal(size=g), rng.normal(size=h), rng.normal(size=1))
    pick = random.Random(2)
    text = " ".join(pick.choice(["Alpha", "beta", "gamma,", "ü", "alpha"]) for _ in range(150))
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    encoded, scores = [], []
    for a in range(0, 150, quality.PASSAGE_WORDS):
        words = text.split()[a : a + quality.PASSAGE_WORDS]
        own = " ".join(words).encode()
        row = [math.sqrt(own.count(b) / len(own)) for b in range(256)] + [math.log(sum(len(w.encode()) for w in words) / len(words)), (len(words) - len(set(words))) / len(words), len(words) / quality.PASSAGE_WORDS]
        x = [(v - m.mean[i]) / m.scale[i] for i, v in enumerate(row)]
        e = [math.tanh(sum(x[i] * m.w[i, j] for i in range(f)) + m.b[j]) for j in range(h)]
        encoded.append(e)
        scores.append(sum(math.tanh(sum(e[i] * m.v[i, k] for i in range(h))) * sigmoid(sum(e[i] * m.u[i, k] for i in range(h))) * m.a[k] for k in range(g)))
    weights = [math.exp(s) / sum(map(math.exp, scores)) for s in scores]
    z = [sum(w * e[j] for w, e in zip(weights, encoded)) for j in range(h)]
    want = sigmoid(sum(z[j] * m.c[j] for j in range(h)) + m.d[0])
    rows = [(1, text, None), (2, None, None), (2, " \n", None), (None, text, None), (1, text, None)]
    got = quality.score_quality(frame(spark, rows), m).collect()
    assert [round(r._score, 4) for r in got] == [round(x, 4) for x in (want, sigmoid(m.d[0]), sigmoid(m.d[0]), want, want)]
    assert quality.score_quality(frame(spark, []), m).count() == 0


def test_attention_gradient():
    """One small step of training lowers the loss by what the derivative says."""
    rng = np.random.default_rng(3)
    bags = [rng.normal(size=(n, quality.FEATURES)).astype(np.float32) for n in (1, 3, 2, 4, 1, 5)]
    labels = np.array([0, 1, 0, 1, 1, 0], dtype=np.float32)
    rows, begin = np.concatenate(bags), np.cumsum([0, 1, 3, 2, 4, 1])

    def loss(m):
        p = quality._forward(m, rows, begin)[0]
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    before, after = quality.fit(bags, labels, steps=0), quality.fit(bags, labels, steps=60)
    assert loss(after) < 0.2 < loss(before)


def test_frequent_runs_of_words_do_not_share_a_bucket(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for i in range(60):  # a phrase between varying words, text of three words only, and a passage that some share
        own = [w for _ in range(30) for w in ("a", "hot", "phrase", f"v{rng.randrange(900)}")]
        own += [rng.choice(["x", "y", "z"]) for _ in range(60)] + (["p"] * 3 + [f"q{j}" for j in range(12)] if i % 4 == 0 else [])
        rows.append((i, " ".join(own)))
    monkeypatch.setattr(substring, "SAMPLE", 1)
    monkeypatch.setattr(substring, "SORTED_WINDOWS", 50)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    deal = substring._dealt(docs.withColumn("_id", F.col("doc_id")), 8, 2, 8)
    assert len(deal.frequent)
    hashes = words_of([rows[0][1].encode()], NON_SPACE).hash
    own = deal.minimisers(hashes)
    alone = own >= 1 << 63
    assert alone.any() and not alone.all()
    assert (own[alone] == window_hashes(hashes, 8)[alone]).any()
    first, want = {}, []
    for i, t in rows:
        for s in range(len(t.split()) - 7):
            first.setdefault(tuple(t.split()[s : s + 8]), (i, s))
    for i, t in rows:
        w = t.split()
        gone = {s + d for s in range(len(w) - 7) if first[tuple(w[s : s + 8])] != (i, s) for d in range(8)}
        want.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    got = remove_repeated_substrings(docs.repartition(5), window=8, mer=2)
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.text) for r in got.collect()) == want


def test_planes_grow_with_the_texts():
    assert [plane_bits(n) for n in (0, 10**9, 10**10, 10**15)] == [1 << 26, 1 << 27, 1 << 30, 1 << 30]


LONG = 300_000


@pytest.fixture(scope="module")
def long_rows():
    """A text of 300,000 words with its copy, another with a passage of the first, and short ones."""
    rng = random.Random(6)
    own = [f"w{rng.randrange(20000)}" for _ in range(LONG)]
    other = [f"u{rng.randrange(20000)}" for _ in range(LONG)]
    other[-30:] = own[500:530]
    one, two = "\n".join([" ".join(own[:1000]), " ".join(own[1000:])]), " ".join(other)
    return [(1, one, "aa"), (2, two, "bb"), (3, one, "aa"), (4, "w1 w2", "aa"), (5, None, None)]


def test_very_long_texts_in_the_dedups(spark, long_rows):
    docs = frame(spark, long_rows)
    same = {r.doc_id: (r.component_id, r.kept) for r in near_duplicate_classes(docs).collect()}
    assert same == {1: (1, True), 2: (2, True), 3: (1, False), 4: (4, True), 5: (5, True)}
    cut = {r.doc_id: (r.n_words, r.n_removed) for r in remove_repeated_substrings(docs).collect()}
    assert cut == {1: (LONG, 0), 2: (LONG, 30), 3: (LONG, LONG), 4: (2, 0), 5: (0, 0)}
    lines = {r.doc_id: (r._n_lines, r._n_dropped) for r in drop_repeated_lines(docs, min_docs=2).collect()}
    assert lines == {1: (2, 2), 2: (1, 0), 3: (2, 2), 4: (1, 0), 5: (1, 0)}


def test_very_long_texts_in_the_scans(spark, long_rows):
    docs = frame(spark, long_rows)
    items = spark.createDataFrame([("i", " ".join(long_rows[1][1].split()[-12:])), (None, None)], "item_id string, text string")
    hits = {r.doc_id: (r._n_words, r._n_hit, r._items) for r in mark_contamination(docs.drop("_n_hit"), items).collect()}
    assert hits[2] == (LONG, 12, ["i"]) and hits[1][1] == 12 and hits[4] == (2, 0, []) and hits[5] == (0, 0, [])
    langs = {r.doc_id: r._lang for r in langid.predict_languages(docs.drop("_lang"), langid.train_languages(docs)).collect()}
    assert (langs[1], langs[2], langs[5]) == ("aa", "bb", "und")
    scored = {r.doc_id: r for r in language_model_scores(docs, F.col("doc_id") != 2).collect()}
    assert scored[1].n_tokens == scored[1].n_known == LONG + 1 and scored[1].score == scored[3].score and scored[5].n_tokens == 1
    packed = pack_sequences(docs.filter("doc_id > 1"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert all(r.n == r["all"] for r in packed) and {r.doc_id for r in packed} == {2, 3, 4, 5}


def test_very_long_texts_in_the_classifiers(spark, long_rows):
    docs = frame(spark, long_rows)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (4, 1, 0)], "doc_id bigint, quality int, toxic int")
    toxic = {r.doc_id: r._score for r in toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, labels, l1=0.1)).collect()}
    good = {r.doc_id: r._score for r in quality.score_quality(docs, quality.train_quality(docs, labels)).collect()}
    assert toxic[2] > 0.5 > toxic[1] == toxic[3] and good[1] == good[3] > 0.5 > good[2]
    few = quality.train_quality(docs, labels, train_passages=1)  # only the short text fits into the bound
    assert few is not None
    for seed in range(4):  # wherever the long text stands in the order, the others are learned from
        rows = spark.createDataFrame([(i, f"short text {seed} {i} " * (3000 if i == 4 else 1)) for i in range(5)], "doc_id bigint, text string")
        marks = spark.createDataFrame([(i, i % 2, i % 2) for i in range(5)], "doc_id bigint, quality int, toxic int")
        assert quality.train_quality(rows, marks, train_passages=8) is not None
    assert toxicity.train_toxicity(docs, labels, train_features=1) is not None


def test_mix_is_a_bijection():
    x = np.arange(1 << 16, dtype=np.uint64)
    assert len(np.unique(mix64(x))) == len(x)


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_a_bucket_in_ranges_of_hashes(ranges):
    rng = random.Random(1)
    texts = [[rng.choice("abc") for _ in range(rng.randrange(5, 40))] for _ in range(30)]
    strings, doc, start = [" ".join(t).encode() for t in texts], np.repeat(np.arange(15), 2), np.tile([0, 100], 15)
    marks = [m for i in range(ranges) for m in substring._range_marks(strings, doc, start, 5, ranges, i)]
    got = {(int(d), b) for m in marks for d, lo, hi in m for b in range(lo, hi + 1)}
    first = {}
    places = [(d, s + i, tuple(t[i : i + 5])) for t, d, s in zip(texts, doc.tolist(), start.tolist()) for i in range(len(t) - 4)]
    assert got == {(d, b) for d, b, w in places if first.setdefault(w, (d, b)) != (d, b)}
