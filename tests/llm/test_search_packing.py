"""Nearest neighbours, decontamination and packing against brute force and round trips."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lodestone.llm.ann import nearest_neighbours
from lodestone.llm.decontam import mark_contamination, remove_spans
from lodestone.llm.packing import Limits, pack_sequences
from lodestone.llm.queries import op6_packing

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def exact(vectors, query, k):
    scored = []
    for i, v in vectors.items():
        if i != query:
            s = 0.0
            for a, b in zip(v, vectors[query], strict=True):
                s += a * b
            scored.append((-s, i))
    return [(i, -s) for s, i in sorted(scored)[:k]]


@pytest.mark.parametrize("norms", [False, True])
def test_neighbours(spark, norms):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16))
    x = centres[rng.integers(0, 20, 1500)] + 0.4 * rng.normal(size=(1500, 16))
    x = (x * rng.uniform(0.2, 3, (1500, 1)) if norms else x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    x[100:400] = x[100]  # many equal vectors
    vectors = {i: v.astype(float).tolist() for i, v in enumerate(x)}
    odd = [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [1.0, None, *[1.0] * 14]), (2080, [1.0]), (2100, [float("inf")] * 16), (None, [1.0] * 16), (0, vectors[0])]
    df = spark.createDataFrame([*vectors.items(), *odd], "vec_id bigint, embedding array<float>").withColumn("rank", F.lit("x"))
    got = {}
    for r in nearest_neighbours(df, F.col("vec_id") % 20 == 0, k=20, leaf_rows=100).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 1500, 20))
    hits = 0
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21))
        want = exact(vectors, q, 20)
        hits += len({i for i, _ in want} & {r[1] for r in rows})
        assert all(s == exact({q: vectors[q], i: vectors[i]}, q, 1)[0][1] for _, i, s in rows)
        assert [(-s, i) for _, i, s in rows] == sorted((-s, i) for _, i, s in rows)
    assert hits / (20 * len(got)) >= 0.9


def test_neighbours_of_outliers_among_clusters(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    centres[-1] = -centres[:-1].sum(axis=0)
    x = np.concatenate([centres[rng.integers(0, 20, 3000)] + 0.02 * rng.normal(size=(3000, 16)), rng.normal(size=(40, 16))])
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = {}
    for r in nearest_neighbours(df, F.col("vec_id") >= 2950, k=20, leaf_rows=100).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert sorted(got) == list(range(2950, 3040))
    for q, rows in got.items():
        assert [r for r, _ in sorted(rows)] == list(range(1, 21)) and len({i for _, i in rows} - {q}) == 20


def test_neighbours_of_few_and_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [1.0, 2.0])], "vec_id bigint, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in nearest_neighbours(few, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 5.0), (0, 2, 1, 4.0)]
    again = few.union(few.filter("vec_id = 1")).union(spark.createDataFrame([(0, [0.5, 9.0]), (2, [9.0, 9.0]), (None, [9.0, 9.0])], few.schema))  # of a vec_id's vectors the first counts
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in nearest_neighbours(again, F.col("vec_id") == 1).orderBy("rank").collect()]
    assert got == [(1, 1, 0, 10.0), (1, 2, 2, 4.0)]
    assert nearest_neighbours(few.filter("false"), F.lit(True)).collect() == []
    assert nearest_neighbours(few.withColumn("embedding", F.lit(None).cast("array<float>")), F.lit(True)).collect() == []


def plain_words(text):
    keep = lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A
    data, out, at = (text or "").encode().lower(), [], None
    for i, b in enumerate([*data, 0]):
        if keep(b) and at is None:
            at = i
        elif not keep(b) and at is not None:
            out.append(data[at:i])
            at = None
    return out


@pytest.mark.parametrize("block", [3, 1 << 20])
def test_contamination(spark, block):
    rng = random.Random(5)
    item = lambda n: [f"k{rng.randrange(40)}" for _ in range(n)]
    items = [(i, " ".join(item(rng.choice([1, 3, 6, 20])))) for i in range(12)] + [(12, ""), (13, None), (None, "null item words here today"), (14, "É two!")]
    docs = []
    for i in range(60):
        own = item(rng.randrange(0, 50))
        if i % 4 == 0:
            own += (items[i % 12][1] or "").upper().split()
        docs.append((i, ", ".join(own)))
    docs += [(60, None), (61, "x É; two y null item words here today"), (None, "a"), docs[4]]
    df, bench = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id bigint, text string, n_hit int"), spark.createDataFrame(items, "item_id bigint, text string")
    got = mark_contamination(df, bench, window=5, block_windows=block)
    windows = {}
    for i, t in items:
        w = plain_words(t)
        for s in range(max(0, len(w) - min(5, len(w)) + 1) if w else 0):
            windows.setdefault(tuple(w[s : s + min(5, len(w))]), set()).add(i)
    want = []
    for i, t in docs:
        w, hit, found = plain_words(t), set(), set()
        for key, own in windows.items():
            for s in range(len(w) - len(key) + 1):
                if tuple(w[s : s + len(key)]) == key:
                    hit |= set(range(s, s + len(key)))
                    found |= own
        want.append((str(i), len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    assert sorted((str(r.doc_id), r._n_words, r._n_hit, r._items) for r in got.collect()) == sorted(want)
    cut = {r.doc_id: r.text for r in remove_spans(got).collect()}
    assert cut[60] is None and cut[61] == "x ;  y     " and all(mark is not None for i, mark in cut.items() if i != 60)
    assert mark_contamination(df, bench.filter("false")).filter("_n_hit > 0").count() == 0
    assert mark_contamination(df.filter("false"), bench).count() == 0


def check_packing(rows, docs, limits, loss=None):
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode.encode_special_tokens = True
    ids = {i: [*encode.encode(t or "", add_special_tokens=False).ids, 0] for i, t in docs}
    at = dict.fromkeys(ids, 0)
    for r in sorted(rows, key=lambda r: (str(r.doc_id), r.start)):
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == at[r.doc_id] and len(own) == r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(own, dtype="<u4").tobytes())
        at[r.doc_id] += r.length
    assert at == {i: len(x) for i, x in ids.items()}
    sequences = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert r.offset == sum(p.length for p in sequences.setdefault(r.sequence_id, []))
        sequences[r.sequence_id].append(r)
    for own in sequences.values():
        assert sum(p.length for p in own) <= limits.tokens and len(own) <= limits.segments
        if loss:
            assert sum(sum(loss[p.doc_id][p.start : p.start + p.length]) for p in own) <= limits.loss_tokens
    return sequences


def test_packing(spark):
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choice(["alpha", "Béta", "<|endoftext|>", "7,5", "\n\n", "日本"]) for _ in range(rng.choice([0, 1, 9, 40, 300])))) for i in range(120)] + [(200, None), (201, "")]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, length string").repartition(3)
    rows = pack_sequences(df, RANKS, public_tokenizers.PATTERN, Limits(128, 64, 128), open_most=8).collect()
    sequences = check_packing(rows, docs, Limits(128, 64, 128))
    padding = [0 if n & (n - 1) == 0 else 128 - n for n in (sum(p.length for p in s) for s in sequences.values())]
    assert sum(padding) == 0
    assert pack_sequences(df.filter("false"), RANKS, public_tokenizers.PATTERN).collect() == []


def test_packing_under_three_limits(spark):
    rng = random.Random(7)
    docs = [(i, " ".join("word" for _ in range(rng.randrange(1, 90)))) for i in range(80)]
    masks = {i: [rng.random() < 0.5 for _ in range(100)] for i, _ in docs}
    df = spark.createDataFrame([(i, t, masks[i]) for i, t in docs], "doc_id bigint, text string, bears array<boolean>").repartition(2)
    limits = Limits(64, 5, 24)
    rows = pack_sequences(df, RANKS, public_tokenizers.PATTERN, limits, open_most=6, loss_mask="bears").collect()
    check_packing(rows, docs, limits, masks)
    again = pack_sequences(df, RANKS, public_tokenizers.PATTERN, limits, open_most=6, with_ids=True).collect()
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 for r in again)


def test_added_tokens_in_texts_are_tokens_as_in_the_vocabulary(spark, tmp_path):
    rng = random.Random(8)
    parts = ["alpha", " ", "\n\n", "<|endoftext|>", "<|endof", "|>", "'s", "日本", "7"]
    docs = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(30)))) for i in range(60)] + [(60, "a <|endoftext|> b")]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: [*encode.encode(t, add_special_tokens=False).ids, 0] for i, t in docs}
    assert want[60] == [64, 220, 50256, 275, 0]
    for got in (op6_packing(spark, str(tmp_path)), corpus_pipeline.packing(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))):
        at = dict.fromkeys(want, 0)
        for r in got.orderBy("doc_id", "start").collect():
            assert r.start == at[r.doc_id] and r.doc_tokens == len(want[r.doc_id])
            assert r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id][r.start : r.start + r.length], dtype="<u4").tobytes())
            at[r.doc_id] += r.length
        assert at == {i: len(x) for i, x in want.items()}


def test_packing_rows_without_an_id_or_with_a_repeated_one(spark):
    rows = [(None, "a b"), (None, None), (7, "c d e"), (7, "c d e"), (7, "other")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, sequence_id string, length int")
    got = pack_sequences(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == {None: 2 + 1 + 1, 7: 2 * (3 + 1) + 1 + 1}
    assert pack_sequences(docs.filter("false"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0
