"""Merkle manifests against a tree built plainly, of any fanout and height; proofs of changed rows fail."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lodestone.llm.merkle import climbed, height, leaf, merkle_manifest, others_digest, parent, with_folded_root
from lodestone.llm.queries import op12_merkle_manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(nodes, fanout):
    """The root, and for each node the runs on its way up, as (place, run)."""
    ways = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for way, i in zip(ways, range(len(at)), strict=True):
            first = at[i] - at[i] % fanout
            way.append((at[i] - first, nodes[first : first + fanout]))
            at[i] //= fanout
        nodes = [sha("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
    return (nodes or [None])[0], ways


def text_of(*fields):
    return "".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields)


@pytest.mark.parametrize(("fanout", "levels"), [(2, 10), (2, 2), (3, 1), (5, 2)])
def test_against_a_plain_tree(spark, fanout, levels):
    rng = random.Random(fanout * 10 + levels)
    rows = [(i, rng.choice([None, "", "en", "de", "Ä", "en"]), rng.choice([None, "", "té" * rng.randint(0, 50)]), 9) for i in rng.sample(range(-50, 500), 120)]
    rows += [(7000, "one", "x", 1), (None, "en", "no id", 1), (3, "en", "b", 1), (3, "en", "a", 1), (3, "en", "a", 2), (2**62, "en", "y" * 200_000, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, text string, leaf int")
    out = merkle_manifest(df, leaf([F.col("doc_id"), F.col("lang"), F.col("text")]), F.col("lang"), [F.col("doc_id")], fanout, levels, keep=("doc_id", "lang", "text"))
    got = with_folded_root(out, "leaf").withColumn("digest", others_digest()).collect()
    want, subroots = {}, []
    for lang in sorted({r[1] for r in rows}, key=lambda x: (x is not None, (x or "").encode())):
        own = sorted((r for r in rows if r[1] == lang), key=lambda r: (r[0] is not None, r[0] or 0, sha(text_of(*r[:3]))))
        top, ways = tree([sha(text_of(*r[:3])) for r in own], fanout)
        subroots.append(top)
        for r, way in zip(own, ways, strict=True):
            want.setdefault((r[0], r[1], r[2]), []).append((top, len(subroots) - 1, way))
    root, upper = tree(subroots, fanout)
    digests = lambda way: sha("".join(d for at, run in way for i, d in enumerate(run) if i != at))
    assert len(got) == len(rows)
    for key, entries in want.items():
        mine = [r for r in got if (r.doc_id, r.lang, r.text) == key]
        assert {r.leaf for r in mine} == {sha(text_of(*key))} and {r.root for r in mine} == {root} and {r.folded_root for r in mine} == {root}
        assert sorted((r.subroot, r.digest) for r in mine) == sorted((top, digests(way + upper[j])) for top, j, way in entries)


def test_changed_rows_do_not_verify(spark, tmp_path):
    rows = [(i, f"text {i}", None if i % 10 == 0 else "en", "s", None if i % 5 == 0 else i) for i in range(80)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    for r in op12_merkle_manifest(spark, str(tmp_path)).collect():
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0 or r.doc_id % 5 == 0)
        assert (r.folded_root == r.root) == r.verified


def test_small_tables(spark):
    one = spark.createDataFrame([(1, None)], "doc_id bigint, lang string")
    made = lambda df: merkle_manifest(df, leaf([F.col("doc_id")]), F.col("lang"), [F.col("doc_id")], keep=("doc_id",))
    (row,) = with_folded_root(made(one), "leaf").withColumn("digest", others_digest()).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root == sha("1:1") and row.proof == [] and row.digest == sha("")
    assert [r.folded_root for r in with_folded_root(made(one).withColumn("leaf", F.lit(None).cast("string")), "leaf").collect()] == [None]
    assert made(one.filter("doc_id > 1")).collect() == []
    with pytest.raises(ValueError):
        merkle_manifest(one, leaf([F.col("doc_id")]), F.col("lang"), [], fanout=1)


def test_levels():
    assert [height(n, 2) for n in (0, 1, 2, 3, 4, 5)] == [0, 0, 1, 2, 2, 3]
    a, b, c = (bytes([x]) * 32 for x in (1, 2, 3))
    proofs, top = climbed([a, b, c], 2, 2)
    assert top == [parent([parent([a, b]), parent([c])])]
    assert proofs == [[(0, [b]), (0, [parent([c])])], [(1, [a]), (0, [parent([c])])], [(0, []), (1, [parent([a, b])])]]
