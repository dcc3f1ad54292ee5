"""What tables of the driver don't hold: nulls, cycles, unsafe names, failures, streams."""

from __future__ import annotations

import gzip
import io
import time
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lodestone.functions import documents, templates, text
from lodestone.operators import library, log, objects, retention, tree, workflow
from lodestone.sources import archives, files
from lodestone.streaming import log as streaming


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=str)


def test_levels_stop_at_cycles_and_unknown_steps(spark):
    steps = spark.createDataFrame([("w", s) for s in "abcdef"] + [("v", "a")], "wf string, step string")
    needs = spark.createDataFrame([("w", "b", "a"), ("w", "c", "b"), ("w", "c", "a"), ("w", "d", "e"), ("w", "e", "d"), ("w", "f", "nowhere")], "wf string, step string, needs string")
    assert rows(workflow.topological_levels(steps, needs)) == sorted([("v", "a", 0), ("w", "a", 0), ("w", "b", 1), ("w", "c", 2), ("w", "d", None), ("w", "e", None), ("w", "f", None)], key=str)


def test_delta_chains_stop_at_cycles_and_five_hops(spark):
    chain = [("c0", None), *((f"c{i}", f"c{i - 1}") for i in range(1, 8)), ("x", "y"), ("y", "x"), ("z", "z"), ("o", "missing")]
    got = {r.hash: r for r in tree.delta_chains(spark.createDataFrame(chain, "hash string, base_hash string")).collect()}
    assert (got["c5"].root, got["c5"].hops, got["c5"].complete) == ("c0", 5, True)
    assert (got["c7"].hops, got["c7"].complete) == (5, False)
    assert not got["x"].complete and not got["z"].complete


def test_log_folds_whatever_the_order(spark):
    entries = [(3, "k", "delete", 0), (1, "k", "put", 5), (2, "k", "constraint", 0), (5, "j", "constraint", 0), (4, "j", "put", 7), (9, None, "put", 1)]
    frame = spark.createDataFrame(entries, "pos bigint, key string, op string, len bigint")
    assert rows(log.latest_state(frame), "key", "op", "pos") == sorted([("k", "delete", 3), ("j", "put", 4), (None, "put", 9)], key=str)
    assert rows(log.pending_constraints(frame)) == [("j", 5)]
    assert log.latest_state(frame.filter("false")).count() == 0


def test_stream_and_batch_agree_over_a_restart(spark, tmp_path):
    schema = "pos bigint, key string, op string, len bigint"
    entries = [(i, f"k{i % 7}", ("put", "delete", "constraint")[i % 3], i) for i in range(60)]
    state = {}

    def apply(batch, number):
        state["now"] = spark.createDataFrame(streaming.merged(state.get("now"), batch).collect(), "key string, op string, pos bigint, len bigint")

    for part in (entries[:40], entries[40:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        streaming.consume(streaming.log_stream(spark, f"{tmp_path}/log", schema), apply, f"{tmp_path}/checkpoint").awaitTermination()
    assert rows(state["now"], "key", "op", "pos") == rows(log.latest_state(spark.createDataFrame(entries, schema)), "key", "op", "pos")


def test_archives_reject_names_that_leave_them(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("../up.txt", b"x")
    bad = spark.createDataFrame([("a", bytearray(out.getvalue()))], "id string, data binary")
    with pytest.raises(Exception, match="leaves its archive"):
        archives.members(bad, "id", "data").collect()
    assert archives.members(spark.createDataFrame([("a", bytearray(b"text")), ("b", None)], "id string, data binary"), "id", "data").collect() == []


def test_sizes_told_without_unpacking(spark):
    own = [("g", "tar.gz", bytearray(gzip.compress(b"x" * 70000))), ("z", "zip", bytearray(b"broken")), ("e", "tar.gz", bytearray()), ("n", "zip", None), ("b", "binary", bytearray(b"abc"))]
    got = archives.estimated_sizes(spark.createDataFrame(own, "id string, kind string, data binary"), "id", "kind", "data")
    assert rows(got) == [("b", 0), ("e", 0), ("g", 70000), ("n", 0), ("z", 6)]


def test_texts_are_written_by_name(spark, tmp_path):
    files.write_texts(spark.createDataFrame([("a", "one"), ("b", "two")], "name string, text string"), f"{tmp_path}/out")
    assert rows(spark.read.text(f"{tmp_path}/out"), "name", "value") == [("a", "one"), ("b", "two")]


def test_sweeps_go_on_until_stopped(spark, tmp_path):
    seen = []
    query = streaming.sweeps(spark, seen.append, 1, f"{tmp_path}/sweeps")
    end = time.time() + 60
    while len(seen) < 2 and time.time() < end:
        time.sleep(0.2)
    query.stop()
    assert seen[:2] == [0, 1]


def test_folders_and_state(spark, tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/deep/a.txt").write_text("hello")
    got = files.scan_folder(spark, f"{tmp_path}/in").collect()
    assert [(r.path, r.len) for r in got] == [("deep/a.txt", 5)]
    schema = StructType([StructField("version", LongType()), StructField("name", StringType())])
    (tmp_path / "s.json").write_text('{"version": 2, "name": "x"}')
    assert files.load_state(spark, f"{tmp_path}/s.json", schema, 2).collect()[0].name == "x"
    with pytest.raises(Exception, match="unsupported version"):
        files.load_state(spark, f"{tmp_path}/s.json", schema, 3).collect()


@pytest.mark.parametrize(
    ("template", "values", "want"),
    [
        ("a ${x} b", {"x": "1"}, "a 1 b"),
        ("${missing}", {}, None),
        ("\\${x}", {"x": "1"}, "${x}"),
        ('${os == "linux" ? ${x} : ${y}}', {"os": "linux", "x": "p"}, "p"),
        ('${os != "linux" ? p : ${os >= "b" ? q : r}}', {"os": "linux"}, "q"),
        ("${x ? yes | ${y}}", {"x": "", "y": "no"}, "no"),
        ("${open", {}, None),
    ],
)
def test_templates(template, values, want):
    assert templates.render(template, values) == want


def test_documents():
    assert documents.find_text('{"format": {"Title": 3}, "title": "t"}', "title") == "t"
    assert documents.find_text('{"streams": [{}, {"tags": {"TITLE": "s"}}], "title": "t"}', "title") == "s"
    assert documents.find_text('{"channel": "c"}', "artist") == "c"
    assert documents.find_text("no json", "title") is None and documents.find_text(None, "title") is None
    assert documents.flatten_json('{"b": [1, "x"], "a": {"c": true}}') == [("a_c", "true"), ("b", "1; x")]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 5), st.lists(st.sampled_from("abc"), max_size=2)), max_size=12))
def test_duplicate_paths_are_what_pairs_say(spark, entries):
    frame = spark.createDataFrame([(p, m % 2, i, v) for i, (p, m, v) in enumerate(entries)], "path int, media int, ord int, variants array<string>")
    want = set()
    for i, (p, m, v) in enumerate(entries):
        if any(q == p and n % 2 == m % 2 and (not v or not w or set(v) & set(w)) for q, n, w in entries[:i]):
            want.add(i)
    assert {r.ord for r in library.duplicate_paths(frame).collect()} == want


def test_small_rules(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c.alias("v")).first().v
    assert pick(text.relative_path(F.lit("a.m3u"), F.lit("x/y"))) == "x/y"
    assert pick(text.relative_path(F.lit("p/q/a.m3u"), F.lit("p/q/y"))) == "y"
    assert pick(text.normalized_path(F.lit("./"))) is None
    assert pick(text.metadata_key(F.lit("--9 Lives!"))) == "meta_9_lives"
    assert pick(text.duration_text(F.lit(0))) == "0s"
    assert pick(text.cover_kinds(F.lit("-front,all"))) is not None
    assert pick(text.version_matches([F.lit(None).cast("string")], [F.lit("1")])) is False
    assert text.glob_regex("a*.t?t") == "^a[^/]*\\.t[^/]t$"


def test_retention_and_objects_with_empty_tables(spark):
    none = spark.createDataFrame([], "key string, last_referenced_at bigint")
    assert retention.collect_instances(none, none, "key", 1, 1, 1).count() == 0
    assert objects.store_budget(spark.createDataFrame([], "len bigint")).collect()[0].asDict() == {"store_bytes": 0, "budget": 1}
    assert rows(objects.get(spark.createDataFrame([], "hash string, len bigint"), spark.createDataFrame([("q",)], "hash string")), "found") == [(False,)]
