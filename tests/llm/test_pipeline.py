"""The pipeline's stages against the same decisions taken one document at a time."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from tests.llm.test_dedup import lines_by_hand, shingles
from tests.llm.test_search_packing import check_packing, plain_words

import corpus_pipeline
from lodestone.llm.packing import Limits
from lodestone.llm.toxicity import features, leveled, train_toxicity


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(8)
    words = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    docs, labels, items = [], [], [(i, words(30)) for i in range(3)]
    for i in range(150):
        lines = [words(20) for _ in range(4)]
        if i % 5 == 0:
            lines[2] = " ".join(["vilething"] * 3 + lines[2].split())
        if i % 4 == 1:
            lines.append("A Shared footer line")
        if i % 10 == 2:
            lines[0] += " " + items[i % 3][1].upper()
        docs.append((i, "\n".join(lines), "en", "src", 0))
        labels.append((i, 1, int(i % 5 == 0)))
    for i in range(150, 170):
        own = docs[i - 147][1].split(" ")
        own[rng.randrange(len(own))] = "edit"
        docs.append((i, " ".join(own), "en", "src", 0))
    docs += [(170, None, None, None, None), (171, "", "en", "src", 0), docs[3]]
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, _score string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), [(d[0], d[1]) for d in docs], items


def test_pipeline(spark, tables):
    folder, docs, items = tables
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas()
    held_out = [zlib.crc32(str(i).encode()) % 3 == 1 for i in labels["doc_id"]]
    model = train_toxicity(frame, spark.createDataFrame(labels[~np.array(held_out)]))
    weights = dict(zip(model.slots.tolist(), model.weights.tolist(), strict=True))
    logit = lambda t: model.bias + sum(weights.get(s, 0.0) for s in leveled(features([(t or "").encode()])[1]).tolist())
    left = [(i, t) for i, t in docs if 1 / (1 + np.exp(-logit(t))) < 0.7]
    assert len(docs) - 40 < len(left) < len(docs) - 20
    left = [(i, t) for i, t, _, _ in lines_by_hand(left, 10, "none")]
    assert not any("footer" in t for _, t in left)
    root = {i: i for i, _ in left}
    sets = {i: shingles(t, 5) for i, t in left}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                root[b] = min(root[b], root[a])
    left = list({i: t for i, t in left if root[i] == i}.items())
    windows = {tuple(plain_words(t)[s : s + 10]) for _, t in items for s in range(21)}
    grams = lambda t: {tuple(plain_words(t)[s : s + 10]) for s in range(len(plain_words(t)) - 9)}
    left = [(i, t) for i, t in left if not grams(t) & windows]
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in rows} == {i for i, _ in left} and 90 < len(left) < 125
    check_packing(rows, left, Limits())


def test_stages_keep_the_columns(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, tables[0])
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert out.count() > 0 and stage(spark, docs.filter("false"), tables[0]).count() == 0
        assert {r._score for r in out.select("_score").collect()} <= {"src", None}
    assert corpus_pipeline.STAGES[-1][1](spark, docs.filter("false"), tables[0]).count() == 0


def test_near_dedup_tells_texts_of_one_id_apart(spark):
    rng = random.Random(10)
    a, b, c = (" ".join(f"w{rng.randrange(3000)}" for _ in range(60)) for _ in range(3))
    rows = [(5, a), (5, b), (5, b), (7, a + " edit"), (8, b + " edit"), (None, c), (9, c + " edit"), (3, b + " other")]
    docs = spark.createDataFrame([(i, t, "en", 0) for i, t in rows], "doc_id bigint, text string, lang string, n_chars bigint")
    got = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("5", a), ("None", c), ("3", b + " other")])
