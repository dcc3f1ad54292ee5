"""Deltas: round trips, composition against applying one by one, chains with problems."""

from __future__ import annotations

import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.operators import delta
from lodestone.plans import delta_queries, registry  # noqa: F401


def changed(rng, data):
    out = bytearray(data)
    for _ in range(rng.randint(0, 4)):
        at = rng.randint(0, len(out))
        kind = rng.random()
        if kind < 0.4:
            out[at:at] = rng.randbytes(rng.randint(1, 90))
        elif kind < 0.7:
            del out[at : at + rng.randint(1, 200)]
        else:
            a = rng.randint(0, len(out))
            out[at:at] = out[a : a + 500]
    return bytes(out)


def test_blocks_follow_content():
    rng = random.Random(1)
    data = rng.randbytes(20_000)
    ends = delta.block_ends(data)
    assert ends[-1] == len(data) and ends == sorted(set(ends)) and max(b - a for a, b in zip(ends, ends[1:])) <= 2048
    moved = {e - 7 for e in delta.block_ends(data[:5000] + b"7 bytes" + data[5000:])}
    assert len(moved & set(ends)) > 0.6 * len(ends)
    assert delta.block_ends(b"") == [] and delta.block_ends(b"a") == [1] and delta.block_ends(b"\0" * 5000)[-1] == 5000


def test_composition_is_one_delta():
    rng = random.Random(2)
    for _ in range(60):
        versions = [rng.randbytes(rng.choice([0, 5, 900, 4000]))]
        for _ in range(3):
            versions.append(changed(rng, versions[-1]))
        steps = []
        for base, target in zip(versions, versions[1:]):
            shared = [(i, base.find(target[i : i + 32]), min(32, len(target) - i)) for i in range(0, len(target), 32) if target[i : i + 32] in base]
            steps.append(delta.runs_between(base, target, shared))
            assert delta.applied_runs(base, steps[-1]) == target
        whole = steps[0]
        for step in steps[1:]:
            whole = delta.composed_runs(step, whole)
        assert delta.applied_runs(versions[0], whole) == versions[-1]
    with pytest.raises(ValueError):
        delta.composed_runs([(0, 5, None)], [(None, 4, b"four")])
    with pytest.raises(ValueError):
        delta.applied_runs(b"abc", [(2, 2, None)])


@pytest.fixture
def store(spark):
    rng = random.Random(3)
    first = rng.randbytes(6000)
    versions = [first]
    for _ in range(6):
        versions.append(changed(rng, versions[-1]))
    rows = [(f"v{i}", v) for i, v in enumerate(versions)] + [("other", rng.randbytes(3000)), ("empty", b""), ("null", None), ("long", b"x" * 70_000), ("same", b"x" * 70_000)]
    return versions, spark.createDataFrame(rows, "hash string, data binary")


def test_diffs_and_optimise(spark, store):
    versions, objects = store
    pairs = spark.createDataFrame([*((f"v{i + 1}", f"v{i}") for i in range(6)), ("other", "v0"), ("empty", "v0"), ("v0", "empty"), ("null", "v0"), ("v0", "gone"), ("long", "same")], "target string, base string")
    made = delta.diffs(pairs, objects)
    rows = {(r.target, r.base): r for r in made.collect()}
    assert len(rows) == 10
    data = {r.hash: r["data"] and bytes(r["data"]) for r in objects.collect()}
    assert all(r.target_len == len(data[r.target]) for r in rows.values())
    assert {(r.target, r.base): bytes(r["data"]) for r in delta.applied(made, objects).collect()} == {k: data[k[0]] for k in rows}
    kept = {(r.target, r.base) for r in delta.optimised(pairs, objects).collect()}
    assert ("v1", "v0") in kept and ("long", "same") in kept and rows["long", "same"].delta_len < 100 and not kept & {("other", "v0"), ("empty", "v0"), ("v0", "empty")}
    assert ("long", "same") not in {(r.target, r.base) for r in delta.diffs(pairs, objects, most_bytes=50_000).collect()}


def test_chains(spark, store):
    versions, objects = store
    pairs = spark.createDataFrame([(f"v{i + 1}", f"v{i}") for i in range(6)], "target string, base string")
    made = [(r.target, r.base, r.delta, None) for r in delta.diffs(pairs, objects).collect()]
    run = [(0, 4, None)]
    rows = [*made, ("v0", None, None, versions[0]), ("self", "self", run, None), ("a", "b", run, None), ("b", "a", run, None), ("lost", "nowhere", run, None), ("behind", "a", run, None), ("bad", "v0", [(5999, 2, None)], None), ("whole", None, None, b"abc")]
    got = {r.hash: r for r in delta.contents(spark.createDataFrame(rows, f"hash string, base_hash string, delta {delta.DELTA}, data binary")).collect()}
    assert {h: r.problem for h, r in got.items() if r.problem} == {"v6": "too deep", "self": "self-reference", "a": "cycle", "b": "cycle", "lost": "missing base", "behind": "cycle", "bad": "damaged"}
    for i in range(6):
        assert bytes(got[f"v{i}"]["data"]) == versions[i] and got[f"v{i}"].hops == i
    assert bytes(got["whole"]["data"]) == b"abc" and all(got[h]["data"] is None for h, r in got.items() if r.problem)


def test_chains_work_objects_out_once(spark, store):
    """each hop worked out all deltas anew."""
    versions, objects = store
    pairs = spark.createDataFrame([(f"v{i + 1}", f"v{i}") for i in range(4)], "target string, base string")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    made = delta.diffs(pairs, objects).select(F.col("target").alias("hash"), F.col("base").alias("base_hash"), "delta")
    rows = made.mapInArrow(counted, made.schema).withColumn("data", F.lit(None).cast("binary")).union(spark.createDataFrame([("v0", None, None, versions[0])], f"hash string, base_hash string, delta {delta.DELTA}, data binary"))
    got = {r.hash: bytes(r["data"]) for r in delta.contents(rows).collect()}
    assert got == {f"v{i}": versions[i] for i in range(5)} and seen.value == 4
    third = delta.contents(rows, wanted=spark.createDataFrame([("v3",)], "hash string")).collect()
    assert [(r.hash, r.hops, bytes(r["data"])) for r in third] == [("v3", 3, versions[3])]


def test_python_takes_batches_in_parts():
    """a whole batch was turned into Python's objects at once."""
    data = [b"x" * (1 << 20)] * 9 + [None, b"", b"y" * (6 << 20), b"z"]
    batch = pa.record_batch([pa.array(data, pa.binary()), pa.array(data, pa.binary())], ["own", "other"])
    parts = list(delta._parts(iter([batch]), ["own", "other"]))
    assert [v for p in parts for v in p.column("own").to_pylist()] == data
    assert all(p.num_rows == 1 or sum(len(v or b"") for c in ("own", "other") for v in p.column(c).to_pylist()) <= delta.PART_BYTES for p in parts)
    many = pa.record_batch([pa.array([b""] * 5000, pa.binary())], ["own"])
    assert [p.num_rows for p in delta._parts(iter([many]), ["own"])] == [2000, 2000, 1000]
    rows = [[(3, 4, None), (None, 2, b"ab")], None, [], [(0, 1, None)]]
    assert delta._rows(delta._deltas(rows)) == rows and delta._rows(delta._deltas(rows).slice(2)) == rows[2:]


def _worker_mb(spark):
    """The most memory that any Python worker has held so far."""
    peak = F.udf(lambda _: __import__("resource").getrusage(__import__("resource").RUSAGE_SELF).ru_maxrss, "long", useArrow=False)
    return spark.range(0, 64, 1, 16).select(peak("id").alias("kb")).agg(F.max("kb")).first()[0] / 1024


def test_python_holds_few_payloads_at_a_time(spark):
    """300 MB of payloads in one partition, far fewer rows than an Arrow batch takes."""
    before = _worker_mb(spark)
    objects = spark.range(0, 1500, 1, 1).select(F.col("id").cast("string").alias("hash"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 3200).cast("binary").alias("data"))
    cut = delta.block_index(objects).agg(F.count("*").alias("n"), F.min(F.size("blocks")).alias("least")).first()
    assert cut.n == 1500 and cut.least > 0
    assert _worker_mb(spark) - before < 200


def test_round_trip_takes_every_row(spark, tmp_path):
    """rows without a text were left out by a filter, and texts beyond 16 MiB by a limit that the query's SQL doesn't have."""
    texts = [None, None, "", "a", "a", "é" * 700, "0123456789abcdef" * ((17 << 20) // 16)]
    spark.createDataFrame([(t,) for t in texts], "text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["delta_round_trip"](spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.execute(f"SELECT target, base, target_len, restored FROM ({registry.SQL['delta_round_trip']})").fetchall()
    rows = [tuple(r) for r in got.select("target", "base", "target_len", "restored").collect()]
    assert len(rows) == 5 and set(rows) == set(want) and (None, None, None, None) in rows


def test_a_text_moves_once(spark, tmp_path):
    """all four versions of a text were shuffled, again for each table made of them."""
    letters = F.concat(*[F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"/{i}")), 512) for i in range(60)])
    spark.range(0, 600, 1, 4).select(letters.alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f.getPath(): f.length() for f in [files.apply(i) for files in [disk.getAllFiles().toSeq()] for i in range(files.size())] if f.getName().startswith("shuffle")}
    before = shuffled()
    got = registry.QUERIES["delta_content"](spark, str(tmp_path)).collect()
    assert len(got) == 600 and all(r.hash == r.restored and r.hops == 3 and r.len == 128 * 60 + 2 * (10 + 300) - 36 for r in got)
    assert sum(n for f, n in shuffled().items() if f not in before) < 1.5 * 600 * 128 * 60
