"""Best-fit packing: sweeps against a stack, whole packings against the tokenizer and sequential best-fit decreasing."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestone.llm.bestfit import best_fit_pack, place, swept
from lodestone.llm.packing import pack_sequences
from lodestone.llm.tokens import LONG_RUN, added_tokens, token_ids

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


def best_fit_decreasing(lengths, capacity):
    rooms = [0] * (capacity + 1)
    opened = 0
    for n in sorted(lengths, reverse=True):
        room = next((r for r in range(n, capacity + 1) if rooms[r]), None)
        if room is None:
            opened, room = opened + 1, capacity
        else:
            rooms[room] -= 1
        rooms[room - n] += 1
    return opened


def test_a_sweep_closes_brackets():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(0, 30))
        piece = rng.random(n) < rng.random()
        slots, pieces, missed, left = swept(np.sort(rng.integers(1, 9, n))[::-1], piece)
        stack, pairs, none = [], [], []
        for i in range(n):
            if not piece[i]:
                stack.append(i)
            elif stack:
                pairs.append((stack.pop(), i))
            else:
                none.append(i)
        assert sorted(zip(slots.tolist(), pieces.tolist(), strict=True)) == sorted(pairs)
        assert missed.tolist() == none and left.tolist() == stack


@pytest.mark.parametrize(("name", "rows"), [("mixed", 40), ("alike", 30), ("small", 1 << 18)])
def test_places_like_best_fit_decreasing(spark, name, rows):
    rng = random.Random(name)
    capacity = 256
    lengths = {
        "mixed": [min(capacity, int(rng.lognormvariate(4, 1)) + 1) for _ in range(400)],
        "alike": [85] * 200,
        "small": [rng.randint(1, 12) for _ in range(900)],
    }[name]
    items = spark.createDataFrame(list(enumerate(lengths)), "item bigint, length bigint")
    out = place(items, capacity, rows_per_range=rows).collect()
    assert sorted((r.item, r.length) for r in out) == list(enumerate(lengths))
    filled = {}
    for r in out:
        filled[r.seq] = filled.get(r.seq, 0) + r.length
    assert max(filled.values()) <= capacity
    assert len(filled) <= best_fit_decreasing(lengths, capacity) * 1.03 + 1


def test_pieces_and_ids(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["word ", "été ", "\n", " 12", "日本 "]) for _ in range(rng.choice([0, 3, 40, 400]))) for _ in range(60)]
    rows = [(i, t, -1) for i, t in enumerate(texts)] + [(0, texts[0], 5), (None, "no id", 5), (7, None, None), (99, "a <|endoftext|> b", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, length int")
    out = best_fit_pack(df, RANKS, public_tokenizers.PATTERN, capacity=64, with_ids=True, special_tokens=added_tokens(JSON)).collect()
    tokenizer = Tokenizer.from_file(JSON)
    want = sorted(((-1 if d is None else d), [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]) for d, t, _ in rows)
    docs, seqs = {}, {}
    for r in out:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length <= 64
        docs.setdefault(-1 if r.doc_id is None else r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in seqs.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 64
    got = []
    for d, own in docs.items():
        if sum(1 for w, _ in want if w == d) > 1:
            assert sum(r.length for r in own) == sum(len(ids) for w, ids in want if w == d)
            continue
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and [r.start for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
        assert all(r.length == 64 for r in own[1:])
        got.append((d, [i for r in own for i in r.ids]))
    assert sorted(got) == [w for w in want if sum(1 for d, _ in want if d == w[0]) == 1]


def test_no_documents(spark):
    assert best_fit_pack(spark.createDataFrame([], "doc_id bigint, text string"), RANKS, public_tokenizers.PATTERN).collect() == []


@pytest.mark.parametrize("text", [" " * 10**6, "\n" * 10**6, "a" + " " * 10**6 + "b  \n", "x\n" + " \n\t" * 400_000 + "'s it", "　" * LONG_RUN + "é", " " * (LONG_RUN - 1) + "7", "a" + "\n" * LONG_RUN + "<|endoftext|>" + " " * LONG_RUN + "\x1cb", " " * 10**7])
def test_long_runs_of_white_space(text):
    want = [*Tokenizer.from_file(JSON).encode(text, add_special_tokens=False).ids, 0]
    assert token_ids(RANKS, public_tokenizers.PATTERN, added_tokens(JSON))(text) == want


def test_both_packers_take_long_white_space(spark):
    df = spark.createDataFrame([(1, " " * 1_200_000), (2, "\n" * 1_000_000 + "end")], "doc_id bigint, text string")
    for pack in (pack_sequences, best_fit_pack):
        counts = {r.doc_id: r.n for r in pack(df, RANKS, public_tokenizers.PATTERN).groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
        tokenizer = Tokenizer.from_file(JSON)
        assert counts == {r.doc_id: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in df.collect()}
