"""Near-duplicate, line and substring dedup against brute force, with odd rows among the even ones."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from lodestone.llm.components import connected_components
from lodestone.llm.linededup import drop_repeated_lines
from lodestone.llm.minhash import REGISTERS, estimates, near_duplicate_classes, sketches_of
from lodestone.llm.substring import remove_repeated_substrings

SCHEMA = "doc_id bigint, text string, n_words string, kept string, _score double"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "x", "y", 0.5) for i, t in rows], schema)


def words(rng, n, vocabulary=400):
    return [f"W{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=1):
    """(id, text): copies, near copies by up to a third of their words, short, empty, null and repeated rows."""
    rng, rows, i = random.Random(seed), [], 0
    for _ in range(12):
        base = words(rng, rng.choice([3, 30, 80, 150]))
        for _ in range(rng.choice([1, 2, 6, 20])):
            own = list(base)
            for _ in range(rng.randrange(max(1, len(own) // 20 + 1))):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            rows.append((i, (" " if i % 3 else "\n").join(own)))
            i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, " \t\x0b"), (i + 3, "one"), (i + 4, "ONE"), (None, "one two three four"), (None, None)]
    rows.append(rows[0])
    rng.shuffle(rows)
    return rows


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_are_the_components_of_all_pairs(spark, k):
    rows = [r for r in corpus(k) if r[0] is not None]
    got = near_duplicate_classes(frame(spark, rows), shingle=k).collect()
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)


def test_near_duplicates_with_null_ids_and_empty_tables(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (6, "a b c d e f"), (None, "other words here now"), (7, None)]
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_duplicate_classes(frame(spark, rows), shingle=5).collect()}
    assert got == {(None, 2): (None, True), (5, 2): (None, False), (6, 2): (None, False), (None, 1): (None, True), (7, 0): (7, True)}
    assert near_duplicate_classes(frame(spark, [])).collect() == []


def test_near_duplicates_of_one_id_with_several_texts(spark):
    rng = random.Random(3)
    a, b = (" ".join(words(rng, 80, 5000)) for _ in range(2))
    rows = [(5, a), (5, b), (5, b), (7, a + " x"), (8, b + " x"), (4, b + " y"), (6, None), (6, "z"), (None, "u v"), (None, "w")]
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id, r.kept) for r in near_duplicate_classes(frame(spark, rows), shingle=5).collect()), key=str)
    n = 76
    want = [(5, n, 5, True), (5, n, 4, False), (5, n, 4, False), (7, n + 1, 5, False), (8, n + 1, 4, False), (4, n + 1, 4, True)]
    want += [(6, 0, 6, True), (6, 1, 6, True), (-1, 1, None, True), (-1, 1, None, True)]
    assert got == sorted(want, key=str)
    both = near_duplicate_classes(frame(spark, [(5, a), (5, a + " x"), (9, a + " y")]), shingle=5).collect()
    assert {r.component_id for r in both} == {5}
    assert sorted(r.kept for r in both) == [False, False, True]


def test_estimates_follow_the_similarity():
    rng = np.random.default_rng(0)
    for j in (0.5, 0.8, 0.95):
        both = rng.integers(0, 2**64, int(4000 * j), dtype=np.uint64)
        rest = rng.integers(0, 2**64, (2, (4000 - len(both)) // 2), dtype=np.uint64)
        x, y = sketches_of([np.concatenate([both, rest[0]]), np.concatenate([both, rest[1]])])
        n = np.array([float(len(both) + rest.shape[1])])
        got = estimates(np.array([(x > y).sum()]), np.array([(x < y).sum()]), n, n)[0]
        assert abs(got - j) < 5 * (j * (1 - j) / REGISTERS) ** 0.5 + 0.01


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.vertex: r.component for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)}


def lines_by_hand(rows, min_docs, keep):
    space = " \t\n\x0b\x0c\r"
    lower = lambda s: s.encode().lower().decode()
    holders, first = defaultdict(set), {}
    for i, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            k = lower(line.strip(space))
            holders[k].add(i)
            at = ((i is not None, i if i is not None else 0), n)
            first[k] = min(first.get(k, at), at)
    out = []
    for i, t in rows:
        lines, left = (t or "").split("\n"), []
        for n, line in enumerate(lines):
            k = lower(line.strip(space))
            stays = keep == "first" and first[k] == ((i is not None, i if i is not None else 0), n)
            if not k or len(holders[k]) < min_docs or stays:
                left.append(line)
        out.append((i, "\n".join(left), len(lines), len(lines) - len(left)))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("bits", [1 << 16, 1 << 20])
def test_lines(spark, keep, bits):
    rng = random.Random(3)
    pool = ["Shared LINE", " shared line\t", "é Ü", "", "  ", "rare", *(f"l{i}" for i in range(30))]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    rows += [(60, None), (61, ""), (None, "shared line\nlonely"), rows[0]]
    got = drop_repeated_lines(frame(spark, rows), min_docs=3, keep=keep, filter_bits=bits)
    assert got.columns == ["doc_id", "text", "n_words", "kept", "_score", "_n_lines", "_n_dropped"]
    assert sorted(((r.doc_id, r.text, r._n_lines, r._n_dropped) for r in got.collect()), key=str) == lines_by_hand(rows, 3, keep)
    assert drop_repeated_lines(frame(spark, []), min_docs=3).collect() == []


def substrings_by_hand(rows, k):
    own = {i: (t or "").encode().split() for i, t in rows}
    first = {}
    order = sorted(own, key=lambda i: (i is not None, i or 0))
    for i in order:
        for s in range(len(own[i]) - k + 1):
            first.setdefault(tuple(own[i][s : s + k]), (i, s))
    out = []
    for i, _ in rows:
        gone = {s + d for s in range(len(own[i]) - k + 1) if first[tuple(own[i][s : s + k])] != (i, s) for d in range(k)}
        out.append((i, b" ".join(w for n, w in enumerate(own[i]) if n not in gone).decode(), len(own[i]), len(gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("k", "mer"), [(8, 3), (5, 5), (4, 1)])
def test_substrings(spark, k, mer):
    rng = random.Random(k)
    passage = words(rng, 3 * k, 50)
    rows = []
    for i in range(40):
        own = words(rng, rng.randrange(0, 60), 5 if i % 4 == 0 else 300)
        if i % 3 == 0:
            a = rng.randrange(k)
            own[len(own) // 2 : len(own) // 2] = passage[a : a + rng.randrange(k, 3 * k)]
        rows.append((i, " \n\t"[i % 3].join(own)))
    rows += [(40, None), (41, " "), (None, " ".join(passage)), rows[3], (43, " ".join(["same"] * 50))]
    got = remove_repeated_substrings(frame(spark, rows).repartition(3), window=k, mer=mer)
    assert sorted(((r.doc_id, r.text, r.n_words, r.n_removed) for r in got.collect()), key=str) == substrings_by_hand(rows, k)
    assert remove_repeated_substrings(frame(spark, [])).collect() == []


def test_substrings_of_documents_without_an_id_or_with_a_repeated_one(spark):
    rng = random.Random(9)
    passage = words(rng, 12)
    texts = {
        0: [words(rng, 3) + passage, words(rng, 40) + passage + words(rng, 5), words(rng, 30), passage + words(rng, 2)],
        1: [words(rng, 20) + passage, words(rng, 25), words(rng, 2) + passage],
        2: [words(rng, 9) + passage],
    }
    ids = {0: None, 1: 1, 2: 2}
    rows = [(ids[i], " ".join(own)) for i, several in texts.items() for own in several]
    got = sorted(((r.doc_id, r.text, r.n_words, r.n_removed) for r in remove_repeated_substrings(frame(spark, [*rows, rows[1]]).repartition(3), window=8).collect()), key=str)
    first = [r[:3] for r in got if r[3] == 0]  # of documents that hold the passage, the one without an id that comes first keeps it
    holders = [(i, t) for i, t in rows if " ".join(passage) in t]
    kept = [(i, t) for i, t in holders if (i, t, len(t.split())) in first]
    assert len(set(kept)) == 1 and kept[0][0] is None
    want = [(i, t if (i, t) == kept[0] else t.replace(" ".join(passage), "").replace("  ", " ").strip(), len(t.split()), 12 if (i, t) in holders and (i, t) != kept[0] else 0) for i, t in [*rows, rows[1]]]
    assert got == sorted(want, key=str)
