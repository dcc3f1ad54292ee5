"""Depth, cycles, archives, logs and streams on rows that the driver's tables don't hold."""

from __future__ import annotations

import hashlib
import io
import json
import lzma
import os
import random
import shutil
import tarfile
import zipfile

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions import documents, templates, text
from lodestone.operators import chunks, library, log, objects, tree, workflow
from lodestone.plans import registry, store_queries  # noqa: F401
from lodestone.sources import archives, files, journal
from lodestone.streaming import log as stream
from lodestone.streaming import store


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=str)


@pytest.mark.parametrize("rest", [0, 3, 1 << 20])
def test_levels(spark, rest):
    steps = [("w", x) for x in "abcdefgh"] + [("v", "a"), ("v", "b")]
    needs = [("w", "b", "a"), ("w", "c", "b"), ("w", "c", "a"), ("w", "d", "e"), ("w", "e", "d"), ("w", "f", "e"), ("w", "g", "missing"), ("w", "b", "a"), ("v", "b", "a")]
    got = workflow.topological_levels(spark.createDataFrame(steps, "wf string, step string"), spark.createDataFrame(needs, "wf string, step string, needs string"), rest)
    want = [("v", "a", 0), ("v", "b", 1), ("w", "a", 0), ("w", "b", 1), ("w", "c", 2), ("w", "d", None), ("w", "e", None), ("w", "f", None), ("w", "g", None), ("w", "h", 0)]
    assert rows(got, "wf", "step", "level") == sorted(want, key=str)
    empty = spark.createDataFrame([], "wf string, step string, needs string")
    assert rows(workflow.topological_levels(spark.createDataFrame(steps, "wf string, step string"), empty, rest), "level") == [(0,)] * 10


def test_a_chain_of_five_thousand_steps(spark):
    steps = spark.range(5000).select(F.lit(1).alias("wf"), F.col("id").alias("step"))
    got = workflow.topological_levels(steps, steps.filter("step > 0").withColumn("needs", F.col("step") - 1))
    assert got.filter("level = step").count() == 5000


def test_deep_trees_and_cycles(spark):
    deep = [(f"n{i}", f"n{i - 1}" if i else None, i, "x", "strict" if i == 200 else None) for i in range(500)]
    odd = [("p", "q", 0, "x", None), ("q", "p", 0, "x", None), ("r", "q", 0, "x", None), ("s", "gone", 0, "x", None), ("t", "t", 0, "x", None), ("big", "n0", 1234567890, "x", None), ("small", "n0", 99999999, "x", None)]
    nodes = spark.createDataFrame(deep + odd, "node_id string, parent_id string, ord bigint, name string, sanitize string")
    got = {r.node_id: r for r in tree.flattened(nodes).collect()}
    assert len(got) == 507 and got["n499"].depth == 499 and got["n499"].path == "/".join("x" * 500)
    assert (got["n199"].sanitize, got["n200"].sanitize, got["n499"].sanitize) == ("default", "strict", "strict")
    assert [got[x].path for x in "pqrst"] == [None] * 5
    assert got["n0"].place < got["n1"].place < got["n2"].place < got["small"].place < got["big"].place
    roots = lambda *x: spark.createDataFrame([(i,) for i in x], "node_id string")
    assert tree.below(nodes, roots("n100")).count() == 400
    assert rows(tree.below(nodes, roots("p", "elsewhere"))) == [("elsewhere",), ("p",), ("q",), ("r",)]
    assert tree.removed_deep(nodes, F.col("node_id") == "n1").count() == 8
    assert tree.flattened(nodes.filter("false")).count() == 0


def test_recovered_chain(spark):
    blobs = spark.createDataFrame([(i, i, i - 1 if i % 10 else None) for i in range(40)], "hash bigint, len bigint, base_hash bigint")
    known, wanted = spark.createDataFrame([(21,)], "hash bigint"), lambda x: spark.createDataFrame([(x,)], "base_hash bigint")
    assert rows(tree.recovered_chain(wanted(23), known, blobs)) == [(22, 22, 21, None), (23, 23, 22, None)]
    assert rows(tree.recovered_chain(wanted(3), known, blobs), "hash", "base_hash", "error") == [(0, None, None), (1, 0, None), (2, 1, None), (3, 2, None)]
    assert rows(tree.recovered_chain(wanted(9), known, blobs).filter("error is not null"), "hash") == [(4,)]
    assert tree.recovered_chain(wanted(99), known, blobs).count() == 0


def test_selector_chains(spark):
    texts = ["${step_output.a.b:zip(x/y):file(p)} ${step_output.c.d}", "${step_output.a.b:folder(f)", None]
    refs = workflow.step_references(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t")
    got = refs.select("i", "step", "output", "member", workflow.selectors(F.col("chain")).cast("string").alias("s"))
    assert rows(got) == [(0, "a", "b", "x/y", "[{zip, x/y}, {file, p}]"), (0, "c", "d", None, "[]")]


def test_archives_of_other_kinds(spark):
    def tar(mode):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode=mode) as t:
            for name, data in (("d/a", b"1"), ("../b", b"2"), ("c", b"")):
                info = tarfile.TarInfo(name)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
        return out.getvalue()

    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w") as z:
        z.writestr("x", b"y")
    data = [("gz", tar("w:gz")), ("xz", tar("w:xz")), ("zip", plain.getvalue()), ("cut", tar("w:gz")[:-30]), ("other", b"text"), ("none", None)]
    table = spark.createDataFrame(data, "archive string, data binary")
    got = archives.members(table, "archive", "data", quarantine=True)
    with pytest.raises(Exception, match="leaves its archive"):
        archives.members(table.filter("archive = 'gz'"), "archive", "data").collect()
    whole = got.filter("archive in ('gz', 'xz')").select("archive", "idx", "path", F.col("bytes").cast("string").alias("b"), "problem")
    assert rows(whole) == [(k, *r) for k in ("gz", "xz") for r in [(0, "d/a", "1", None), (1, "../b", None, "leaves its archive"), (2, "c", "", None)]]
    assert rows(got.filter("archive not in ('gz', 'xz')"), "archive", "problem")[-1] == ("zip", None)
    assert got.filter("archive = 'cut' and problem like 'broken%'").count() == 1
    assert got.filter("archive in ('other', 'none')").count() == 0
    sizes = spark.createDataFrame([("tar.xz", lzma.compress(b"a" * 99999)), ("tar.xz", b"no"), ("tar.gz", data[0][1]), ("rar", b"x")], "kind string, data binary")
    assert [r.bytes for r in archives.estimated_sizes(sizes.withColumn("k", F.lit(1)), "k", "kind", "data").collect()] == [99999, 2, 10240, 0]
    with pytest.raises(ValueError, match="unknown archive action"):
        archives.acted("melt", table)


def test_volumes_keep_all_members_in_order(spark):
    made = [("a" if i % 3 else "b", f"p{i:03d}", bytes(i)) for i in range(200)]
    packed = archives.packed(spark.createDataFrame(made, "archive string, path string, bytes binary"), volume_bytes=500).cache()
    assert packed.count() > 10
    got = archives.numbered(archives.members(packed, "archive", "data"))
    want = [(a, i, p, bytearray(b)) for a in "ab" for i, (_, p, b) in enumerate(x for x in made if x[0] == a)]
    assert rows(got, "archive", "idx", "path", "bytes") == sorted(want, key=str)


def test_captures_and_members_by_name(spark):
    found = spark.createDataFrame([("r", "a.en.vtt"), ("r", "b.vtt"), ("s", "c")], "run string, path string")
    specs = spark.createDataFrame([("r", "one", "^b"), ("r", "all", "vtt$"), ("r", "none", "^z"), ("t", "lost", "x")], "run string, output string, pattern string")
    assert rows(archives.captured(found, specs)) == sorted([("r", "one", 1, "b.vtt"), ("r", "all", 2, None), ("r", "none", 0, None), ("t", "lost", 0, None)], key=str)
    listed = spark.createDataFrame([("r", "x.y/a.en.vtt", 0), ("r", "b.vtt", 1), ("r", ".vtt", 2)], "archive string, path string, idx bigint")
    wanted = spark.createDataFrame([("r", n) for n in (".vtt", ".en.vtt", "b.vtt", "vtt", ".zip")], "archive string, name string")
    assert rows(archives.member_by_name(listed, wanted)) == [("r", ".en.vtt", "x.y/a.en.vtt"), ("r", ".vtt", ".vtt"), ("r", "b.vtt", "b.vtt")]


def test_instances_of_one_kind_compete(spark):
    instances = [("t", "k1", ["a", "b"], 5), ("t", "k2", ["b", "a"], 7), ("t", "k3", ["a"], 1), ("t", "k4", ["a", "b", "c"], 99), ("u", "k5", ["a"], 1)]
    steps = [(1, "t", "zz", ["b", "a"]), (2, "t", "zz", []), (3, "t", "k4", ["c"]), (4, "v", "zz", ["a"])]
    got = workflow.matched_instances(spark.createDataFrame(steps, "step int, tool string, key string, required array<string>"), spark.createDataFrame(instances, "tool string, key string, outputs array<string>, executed_at int"))
    assert rows(got) == [(1, "k2", "relaxed"), (2, "k3", "relaxed"), (3, "k4", "strict")]


def test_appending_and_checkpoints(spark):
    batch = spark.range(1000).withColumn("x", F.xxhash64("id")).repartition(7)
    got = log.appended(batch, ["x", "id"], 41).orderBy("x", "id").collect()
    assert [r.pos for r in got] == list(range(42, 1042))
    assert log.appended(batch.filter("false"), ["x"], 3).count() == 0
    data = spark.createDataFrame([(0,), (5,), (2**62,)], "pos bigint").select("pos", journal.checkpoint(F.col("pos")).alias("data"))
    assert rows(data.select("pos", journal.checkpoint_position(F.col("data")).alias("p"))) == [(0, 0), (2**62, 2**62), (5, 5)]
    assert data.select(journal.checkpoint_position(F.lit(b"")).alias("p")).first().p is None


def _stored(spark, where):
    """Payloads of a store, put together from their chunks."""
    parts = {}
    for r in store.stored_chunks(spark, where).orderBy("hash", "at").collect():
        assert len(parts.setdefault(r.hash, b"")) == r.at
        parts[r.hash] += bytes(r.bytes)
    assert {r.hash: r.len for r in store.manifest(spark, where).collect()} == {h: len(v) for h, v in parts.items()}
    return sorted(parts.values())


def test_a_stream_of_payloads_is_stored_once(spark, tmp_path):
    source, where, checkpoint = (str(tmp_path / x) for x in ("source", "store", "checkpoint"))
    assert _stored(spark, where) == []
    for payloads in (["a", "b", "a", "", "long" * 9], ["b", "c", None], []):
        spark.createDataFrame([(p if p is None else p.encode(),) for p in payloads], "data binary").write.mode("append").parquet(source)
        store.store_stream(spark.readStream.schema("data binary").parquet(source), where, checkpoint, chunk_bytes=10).awaitTermination()
    assert _stored(spark, where) == sorted([b"a", b"b", b"c", b"", b"long" * 9])
    assert store.manifest(spark, where).filter("chunks = 4").count() == 1
    # another checkpoint over the same store begins at batch 0, and replaces nothing
    spark.createDataFrame([(b"two",)], "data binary").write.mode("append").parquet(source)
    store.store_stream(spark.readStream.schema("data binary").parquet(source), where, str(tmp_path / "other"), chunk_bytes=10).awaitTermination()
    assert _stored(spark, where) == sorted([b"a", b"b", b"c", b"", b"long" * 9, b"two"])
    # files of a batch that broke off before its manifest aren't seen
    store.chunked(spark.createDataFrame([(b"half",)], "data binary")).write.parquet(f"{where}/chunks/run=lost/batch=0")
    assert b"half" not in _stored(spark, where)
    hash_ = hashlib.sha256(b"long" * 9).hexdigest()
    wanted = spark.createDataFrame([(hash_, 8, 15), (hash_, 34, 99), (hash_, 50, 3), (hash_, 4, 0), ("none", 0, 5)], "hash string, start bigint, length bigint")
    got = store.read_ranges(spark, where, wanted).orderBy("start", "at").collect()
    assert [(r.start, r.at, bytes(r.bytes)) for r in got] == [(8, 8, b"lo"), (8, 10, b"nglonglong"), (8, 20, b"lon"), (34, 34, b"ng")]


def test_a_batch_that_is_applied_again_replaces_itself(spark, tmp_path):
    source, where, checkpoint = (str(tmp_path / x) for x in ("source", "store", "checkpoint"))
    spark.createDataFrame([(b"x",), (b"y",)], "data binary").write.parquet(source)
    payloads = spark.readStream.schema("data binary").parquet(source)
    store.store_stream(payloads, where, checkpoint).awaitTermination()
    # as after a failure between the chunks and the manifest: the batch isn't committed and comes again
    shutil.rmtree(f"{where}/manifest")
    for name in os.listdir(f"{checkpoint}/commits"):
        os.remove(f"{checkpoint}/commits/{name}")
    assert _stored(spark, where) == []
    for _ in range(2):
        store.store_stream(payloads, where, checkpoint).awaitTermination()
        assert _stored(spark, where) == [b"x", b"y"]
    assert store.stored_chunks(spark, where).count() == 2


def test_close_keys_against_all_pairs(spark):
    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last, row = row, [0]
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        return row[-1]

    rng = random.Random(6)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9))) for _ in range(70)] + ["ffmpeg", "aaaa", "a", "日本語"]
    known = [(t, w) for t in ("x", "y") for w in words if rng.random() < 0.6] + [("x", "ffmpeg"), ("x", None)]
    unknown = [(t, w[1:] + rng.choice(["", "a", "zz"])) for t in ("x", "y", "z") for w in words if len(w) > 1] + [("x", "ffmpeg_version"), ("y", "nothing_version"), ("x", None)]
    want = set()
    for t, k in set(unknown) - {("x", None)}:
        valid = {w for o, w in known if o == t and w}
        if k.endswith("_version") and k[:-8] in valid:
            want.add((t, k, k[:-8], 1))
            continue
        near = sorted((w for w in valid if 20 * common(k, w) >= 6 * (len(k) + len(w))), reverse=True)
        near.sort(key=lambda w: -2 * common(k, w) / (len(k) + len(w)))
        want |= {(t, k, w, i + 1) for i, w in enumerate(near[:3])}
    schema = "tool string, key string"
    got = library.close_keys(spark.createDataFrame(unknown, schema), spark.createDataFrame(known, schema)).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert [library.common_length(a, b) for a, b in (("", ""), ("a", ""), ("abcbdab", "bdcaba"), ("x" * 200, "x" * 90))] == [0, 0, 4, 90]


def test_eviction_of_one_large_group(spark):
    entries = [("hot", i * 7 % 500, i) for i in range(500)] + [("one", 1, 1000), (None, 5, 1001), (None, 4, 1002), ("tie", 3, 1003), ("tie", 3, 1004), ("tie", 3, 1005)]
    got = rows(objects.after_eviction(spark.createDataFrame(entries, "cache string, age int, id int").repartition(5), "cache", ["age", "id"]))
    want = []
    for g in ("hot", "one", None, "tie"):
        own = sorted(e for e in entries if e[0] == g) if g else [entries[502], entries[501]]
        want += own[max(1, len(own) // 2) :]
    assert got == sorted(want, key=str)


def sealed(sizes, most, held=0):
    numbers, number = [], 0
    for n in sizes:
        if held >= most:
            number, held = number + 1, 0
        held += n
        numbers.append(number)
    return numbers, held


def test_seals_of_any_carry():
    rng = random.Random(8)
    for _ in range(150):
        most = rng.randint(1, 30)
        stretches = [[rng.choice([0, 1, 5, 40, rng.randint(0, 9)]) for _ in range(rng.randint(0, 12))] for _ in range(rng.randint(1, 5))]
        whole = log.joined_seals([log.seals_of(np.array(s, dtype=np.int64), most) for s in stretches], most)
        sizes = [n for s in stretches for n in s]
        for held in range(0, most + 20):
            numbers, after = sealed(sizes, most, held)
            k, h = whole.after(np.array([held]), most)
            assert (k[0], h[0]) == (numbers[-1] if numbers else 0, after)


@pytest.mark.parametrize("together", [2, 64])
def test_segments_of_one_log_over_many_ranges(spark, together):
    rng = random.Random(together)
    entries = [("hot", i, rng.choice([0, 3, 250, rng.randint(0, 60)])) for i in range(1200)] + [("one", 7, 500), (None, 1, 100), (None, 2, None), (None, 3, 100), ("b", 5, 99), ("b", 6, 1), ("b", 9, 1)]
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = rows(log.sealed_segments(spark.createDataFrame(entries, "name string, pos int, bytes int"), "name", "bytes", 100, together))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = []
    for part in ("hot", "one", "b", None):
        own = sorted(e[1:] for e in entries if e[0] == part)
        want += [(part, p, n) for (p, _), n in zip(own, sealed([s or 0 for _, s in own], 100)[0], strict=True)]
    assert got == sorted(want, key=str)
    large = spark.createDataFrame([(2**60 + 1, 1, 200), (None, 1, 5), (2**60 + 1, 2, 3)], "name bigint, pos int, bytes int")
    assert rows(log.sealed_segments(large, "name", "bytes", 100)) == [(2**60 + 1, 1, 0), (2**60 + 1, 2, 1), (None, 1, 0)]
    assert log.sealed_segments(large.filter("false"), "name", "bytes", 100).collect() == []


def test_levels_with_null_needs_and_large_ids(spark):
    base = 2**60
    steps = spark.createDataFrame([(1, base + i) for i in (1, 2, 3)], "wf int, step bigint")
    needs = spark.createDataFrame([(1, base + 2, base + 1), (1, base + 3, base + 2), (1, base + 1, None)], "wf int, step bigint, needs bigint")
    for rest in (0, 1 << 20):
        assert rows(workflow.topological_levels(steps, needs, rest), "step", "level") == [(base + i, i - 1) for i in (1, 2, 3)]


def test_strict_matches_are_of_one_tool_and_of_true_keys(spark):
    steps = spark.createDataFrame([(1, "a", "k1", ["o"]), (2, "a", "k2", ["o"]), (3, "a", "k3", ["o"])], "step int, tool string, key string, required array<string>")
    made = [("b", "k1", ["o"], 9, "k1", True), ("a", "k2", ["o"], 5, "other", True), ("a", "k3", ["o"], 1, "k3", False)]
    instances = spark.createDataFrame(made, "tool string, key string, outputs array<string>, executed_at int, made_key string, readable boolean")
    assert rows(workflow.matched_instances(steps, instances)) == [(1, "k2", "relaxed"), (2, "k2", "relaxed"), (3, "k2", "relaxed")]
    assert rows(workflow.matched_instances(steps, instances.drop("made_key", "readable"))) == [(1, "k2", "relaxed"), (2, "k2", "strict"), (3, "k3", "strict")]


def test_quarantine_of_archives_that_cannot_be_read(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("m", b"data")
    plain = buffer.getvalue()
    local, central = plain.index(b"PK\3\4"), plain.index(b"PK\1\2")

    def patched(offset, value):
        out = bytearray(plain)
        out[local + offset : local + offset + 2] = out[central + offset + 2 : central + offset + 4] = value.to_bytes(2, "little")
        return bytes(out)

    table = spark.createDataFrame([("good", plain), ("locked", patched(6, 1)), ("odd", patched(8, 77)), ("cut", plain[:40])], "archive string, data binary")
    got = {r.archive: r for r in archives.members(table, "archive", "data", quarantine=True).collect()}
    assert bytes(got["good"].bytes) == b"data" and got["good"].problem is None
    assert "RuntimeError" in got["locked"].problem and "NotImplementedError" in got["odd"].problem and "BadZipFile" in got["cut"].problem


def test_deep_documents_have_no_values():
    deep = '{"a":' * 200_000
    assert documents.find_text(deep, "a") is None and documents.flatten_json(deep) == []
    closed = "[" * 100_000 + "]" * 100_000
    assert documents.find_text(closed, "a") is None and documents.flatten_json(closed) == []


def test_reads_in_flight_wait_for_the_first(spark, tmp_path):
    source = str(tmp_path / "reads")
    reads = [("k", "2024-01-01 00:00:00", 1), ("k", "2024-01-01 00:00:01", 2), ("j", "2024-01-01 00:00:02", 3)]
    spark.createDataFrame(reads, "key string, at string, n int").select("key", F.to_timestamp("at").alias("at"), "n").coalesce(1).write.parquet(source)
    distinct = stream.distinct_reads(spark.readStream.schema("key string, at timestamp, n int").parquet(source), "key", "at", "10 seconds")
    distinct.writeStream.format("memory").queryName("reads_in_flight").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    assert rows(spark.table("reads_in_flight"), "key") == [("j",), ("k",)]


def test_folders_without_excluded_names(spark, tmp_path):
    for name in ("a/x.txt", "a/.git/y", "b/node_modules/z", "c.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("t")
    assert rows(files.without(files.scan_folder(spark, str(tmp_path)), [r"\.git", "node_modules"]), "path", "len") == [("a/x.txt", 1), ("c.txt", 1)]


def test_overlaps_and_sources_on_one_hot_key(spark):
    entries = [("p", "m", i, ["a"] if i % 2 else ["b"]) for i in range(300)] + [("q", "m", 0, ["a"]), ("q", "m", 1, []), ("q", "m", 2, ["z"]), ("q", "n", 3, ["a"])]
    got = library.duplicate_paths(spark.createDataFrame(entries, "path string, media string, ord int, variants array<string>"))
    assert got.filter("path = 'p'").count() == 298 and rows(got.filter("path = 'q'"), "ord") == [(1,), (2,)]
    steps = [("m", 0, True, [], ["a"]), ("m", 1, False, ["a"], ["b"]), ("m", 2, False, ["c"], ["c"]), ("m", 3, True, [], []), ("n", 0, False, ["a"], [])]
    got = library.invalid_sources(spark.createDataFrame(steps, "media string, ord int, ingest boolean, inputs array<string>, outputs array<string>"))
    assert rows(got) == [("m", 2, "unknown input"), ("m", 3, "only the first step ingests"), ("n", 0, "first step must ingest")]


def test_delta_chains_of_five_hops_and_on_cycles(spark):
    objects = [(i, i - 1 if i else None) for i in range(8)] + [(20, 21), (21, 20), (30, 30), (40, 41), (50, None)]
    got = tree.delta_chains(spark.createDataFrame(objects, "hash bigint, base_hash bigint"))
    want = [(i, max(0, i - 5), min(i, 5), i <= 5) for i in range(8)] + [(20, 20, 2, False), (21, 21, 2, False), (30, 30, 1, False), (40, 41, 1, True), (50, 50, 0, True)]
    assert rows(got, "hash", "root", "hops", "complete") == sorted(want, key=str)


def test_documents_of_random_shape_are_flattened(spark):
    rng = random.Random(4)

    def made(depth, path, want):
        """A random value, whose scalars are put into want by path."""
        kind = rng.choice(["text", "number", "null", "flag", "list"] + ["object", "array"] * 2 * (depth < 4))
        if kind == "object":
            return {k: made(depth + 1, f"{path}_{k}" if path else k, want) for k in rng.sample("abcdef", rng.randrange(4))}
        if kind == "array":
            return [{"k": made(depth + 1, f"{path}_{i}_k", want)} for i in range(rng.randrange(1, 3))]
        if kind == "list":
            own = [rng.choice([1, "x", None, True]) for _ in range(rng.randrange(3))]
            want.append((path, "; ".join("true" if x is True else str(x) for x in own if x is not None)))
            return own
        value = {"text": rng.choice(["", "a b", "é", "y" * 5000]), "number": rng.choice([0, -1, 2.5]), "null": None, "flag": True}[kind]
        if value is not None:
            want.append((path, value[:4096] if isinstance(value, str) else "true" if value is True else str(value)))
        return value

    cases = []
    for i in range(150):
        want: list = []
        cases.append((i, json.dumps({"root": made(0, "root", want)}), sorted(want)))
    docs = spark.createDataFrame([(i, d) for i, d, _ in cases] + [(900, "no json"), (901, None)], "i int, d string")
    got = {r.i: sorted((e.key, e.value) for e in r.f) for r in docs.select("i", documents.flattened(F.col("d")).alias("f")).collect()}
    assert got == {i: want for i, _, want in cases} | {900: [], 901: []}


def test_command_parts_of_random_lists(spark):
    rng = random.Random(7)
    cases, want = [], {}
    for i in range(120):
        lists = {n: [rng.choice(["a", "b c", "", "''", "é"]) for _ in range(rng.randrange(4))] for n in rng.sample(["x", "y", "z"], rng.randrange(4))}
        parts = [rng.choice(["run", "", "''", "*x", "*y", "*none", "-v"]) for _ in range(rng.randrange(6))]
        cases.append((i, parts, {n: json.dumps(v) for n, v in lists.items()}))
        want[i] = [p for part in parts for p in (lists.get(part[1:], []) if part.startswith("*") else [part]) if p not in ("", "''")]
    rows_ = spark.createDataFrame(cases, "i int, parts array<string>, lists map<string,string>")
    assert {r.i: r.c for r in rows_.select("i", templates.command_parts(F.col("parts"), F.col("lists")).alias("c")).collect()} == want


def test_tags_are_filled_where_absent(spark):
    known = {"title": F.col("t"), "artist": F.lit(None).cast("string"), "date": F.lit("2001")}
    flat = F.create_map(F.lit("musicbrainz_release_asin"), F.col("t"), F.lit("artist"), F.lit("from entries"), F.lit("musicbrainz_release_status"), F.lit(" "))
    row = spark.createDataFrame([("é" * 3000,), ("x",)], "t string").select(documents.tag_map(known, flat).alias("m"), documents.tag_map(known).alias("plain")).collect()
    assert row[1].m == {"title": "x", "date": "2001", "artistcredit": "from entries", "releasedate": "2001", "asin": "x"} and row[1].plain == {"title": "x", "date": "2001"}
    assert len(row[0].m["asin"]) == 3000  # longer than the bound in bytes, not in characters


def test_argument_contracts(spark):
    given = [{"mode": "x", "path": "a"}, {"mode": "x", "path": "\t"}, {"path": "a"}, {"mode": "x"}, {"b": "1", "a": "1", "mode": "x", "path": "a"}, {}]
    problem = text.argument_problem(F.col("g"), ["mode", "path"], ["mode"], ["path"], "op")
    got = [r.p for r in spark.createDataFrame([(g,) for g in given], "g map<string,string>").select(problem.alias("p")).collect()]
    assert got == [None, "op requires non-empty 'path'", "op requires 'mode'", "op requires 'path'", "op does not accept arg 'a'", "op requires 'mode'"]


def test_normalising_strips_all_white_space(spark):
    media = spark.createDataFrame([("\t a b\u00a0\n", None)], "title string, artist string")
    assert rows(library.normalized_media(media, ["title", "artist"])) == [("a b", None)]
    files_ = spark.createDataFrame([("p", "m", "h"), ("\n", "m", "h"), ("p", "", "h"), ("p", "m", None)], "path string, media string, hash string")
    assert rows(library.normalized_files(files_), "path", "media", "hash") == [("p", "m", "h")]


def test_seconds_are_rounded_as_the_sql_does(spark, tmp_path):
    """unix_timestamp() cut them, so a gap of 299 seconds counted as 300 (times of .6 and .4) or the other way round."""
    db = duckdb.connect()
    at = [0.6, 300.4, 1000.5, 1300.5, 1601.5, 1900.5, 3600.4, 4000.5, 7600.4, 11200.6]
    rows = ", ".join(f"({i}, make_timestamp(1704067200000000 + {round(x * 1e6)}), 1, 'view')" for i, x in enumerate(at))
    db.execute(f"COPY (SELECT * FROM (VALUES {rows}) t(event_id, ts, user_id, event_type)) TO '{tmp_path}/events.parquet'")
    db.execute(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet'")
    for name in ("cache_touch_throttle", "cache_prune_throttle"):
        want = db.execute(registry.SQL[name]).fetchall()
        assert sorted(tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).collect()) == sorted(want)


def test_chunks_are_handed_on_together():
    """each chunk was a batch by itself."""
    texts = [b"", b"x" * 64, bytes(range(256)) * 40, None, b"y" * 65]
    made = list(chunks.pieces(iter([pa.record_batch([pa.array(texts, pa.binary())], ["data"])]), 64))
    assert len(made) == 1
    got = made[0].to_pylist()
    for text in texts:
        if text is not None:
            own = [r for r in got if r["hash"] == hashlib.sha256(text).hexdigest()]
            assert b"".join(r["bytes"] for r in own) == text and [(r["at"], r["size"], r["whole"]) for r in own] == [(i, min(64, len(text) - i), len(text)) for i in range(0, max(1, len(text)), 64)]
    long = list(chunks.pieces(iter([pa.record_batch([pa.array([b"z" * (9 << 20)], pa.binary())], ["data"])]), 1 << 10))
    assert len(long) > 1 and sum(b.num_rows for b in long) == 9 << 10 and max(b.num_rows for b in long) <= 1 << 12


def test_inlined_content_is_written_in_blocks(spark, tmp_path, monkeypatch):
    """rows of all dependencies were mixed, so that files of them repeated every hash in full; a block holds one dependency's."""
    tools = spark.range(1800).select(F.col("id").alias("tool"), F.concat(F.lit("n"), (F.col("id") % 60).cast("string")).alias("dep"))
    content = spark.range(24000).select(F.concat(F.lit("n"), (F.col("id") % 60).cast("string")).alias("tool"), F.col("id").cast("string").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    made = library.inlined_content(tools, content.union(spark.createDataFrame([("n1", "deps/x", "h")], content.schema)))
    made.write.parquet(f"{tmp_path}/all")
    assert made.count() == made.distinct().count() == 720_000
    assert sum(f.stat().st_size for f in (tmp_path / "all").glob("*.parquet")) < 20 * 720_000
    monkeypatch.setattr(library, "BLOCK_TOOLS", 7)
    monkeypatch.setattr(library, "BLOCK_KEYS", 90)
    some = tools.filter("dep < 'n2'")
    want = some.join(content.withColumnRenamed("tool", "dep"), "dep").select("tool", F.concat(F.lit("deps/"), "dep", F.lit("/"), "key").alias("key"), "hash")
    got = library.inlined_content(some, content)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert library.inlined_content(some.filter("false"), content).isEmpty()


def test_inlined_keys_are_put_together_before_the_join(spark):
    """each of the result's rows put its key together anew."""
    tools = spark.createDataFrame([(1, "n1"), (2, "n1"), (3, "n2")], "tool int, dep string")
    content = spark.createDataFrame([("n1", "a", "h"), ("n1", "deps/b", "i"), ("n2", "c", None)], "tool string, key string, hash string")
    made = library.inlined_content(tools, content)
    assert "concat" not in made._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert sorted(map(tuple, made.collect())) == [(1, "deps/n1/a", "h"), (2, "deps/n1/a", "h"), (3, "deps/n2/c", None)]


def test_archives_are_read_and_written_a_volume_at_a_time(spark, monkeypatch):
    """F8: a task turned whole batches into Python's objects, whatever their bytes; now members are handed on by GIVEN_BYTES."""
    made = spark.range(40).select(F.lit("a").alias("archive"), F.format_string("m%03d", "id").alias("path"), F.repeat(F.col("id").cast("string"), 3000).cast("binary").alias("bytes"))
    packed = archives.packed(made, volume_bytes=10_000)
    assert "MapInArrow" in packed._jdf.queryExecution().toString() and "MapInPandas" not in archives.members(packed, "archive", "data")._jdf.queryExecution().toString()
    monkeypatch.setattr(archives, "GIVEN_BYTES", 5000)
    got = archives.numbered(archives.members(packed, "archive", "data")).collect()
    assert sorted((r.idx, r.path, bytes(r.bytes)) for r in got) == [(i, f"m{i:03}", str(i).encode() * 3000) for i in range(40)]
