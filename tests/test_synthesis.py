"""Workflow synthesis, journals and selection rules on rows that the driver's tables don't hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import library, synthesis, workflow
from lodestone.sources import journal


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=str)


def test_inputs_are_bound_to_the_last_producer_before(spark):
    steps = [("m", 0, [], ["a"]), ("m", 1, ["a"], ["a", "b"]), ("m", 2, ["a", "b", "c"], []), ("n", 0, ["a"], ["a"])]
    bound = synthesis.bound_inputs(spark.createDataFrame(steps, "media string, ord int, inputs array<string>, outputs array<string>"))
    assert rows(bound, "media", "ord", "variant", "producer") == sorted([("m", 1, "a", 0), ("m", 2, "a", 1), ("m", 2, "b", 1), ("m", 2, "c", None), ("n", 0, "a", None)], key=str)
    assert rows(synthesis.dependencies(bound)) == [("m", 1, [0]), ("m", 2, [1])]


def test_chains(spark):
    got = synthesis.expanded(spark.createDataFrame([("m", 3, "media-tagger", "v"), ("m", 4, "unknown", "v")], "media string, ord int, tool string, variant string"))
    assert rows(got, "step", "needs") == [("3-v-0-metadata", None), ("3-v-1-apply", "3-v-0-metadata")]


def test_selectors(spark):
    available = spark.createDataFrame([("o", v) for v in ("default", "video", "audio", "aux")] + [("p", "x")], "owner string, variant string")
    wanted = [("o", 0, "^au.*", True), ("o", 1, " video ", False), ("o", 2, "missing", False), ("o", 3, "audio", False), ("p", 0, "missing", False)]
    got = library.selected_variants(spark.createDataFrame(wanted, "owner string, ord int, selector string, regex boolean"), available)
    assert rows(got) == [("o", 1, "audio"), ("o", 2, "aux"), ("o", 3, "video"), ("o", 4, "default")]


def test_stale_paths_keep_what_is_under_a_desired_one(spark):
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    assert rows(library.stale_paths(paths("a/b", "a/bc", "a", "z/1/2", "q"), paths("a/b", "z"))) == [("a",), ("a/bc",), ("q",)]


def test_journal(spark):
    entries = spark.createDataFrame([(0, 2, "b"), (0, 1, "a"), (1, 7, ""), (0, 3, "c")], "segment bigint, pos bigint, payload string")
    whole = journal.encoded(entries, "segment")
    assert rows(journal.decoded(whole), "segment", "pos", "payload") == [(0, 1, bytearray(b"a")), (0, 2, bytearray(b"b")), (0, 3, bytearray(b"c")), (1, 7, bytearray(b""))]
    damaged = whole.filter("segment = 0").withColumn("data", F.concat(F.expr("substring(data, 1, 33)"), F.lit(b"?"), F.expr("substring(data, 35)")))
    assert rows(journal.decoded(damaged), "pos") == [(1,)]
    assert journal.decoded(whole.withColumn("data", F.lit(None).cast("binary"))).count() == 0


def test_invalidation_and_option_rules(spark):
    instances = spark.createDataFrame([(1, "t", "h", 0), (2, "t", "x", 990), (3, "u", "x", 0), (4, "u", "x", None)], "id int, tool string, hashes string, synced_at bigint")
    rules = spark.createDataFrame([("t", 0, None, None), ("t", 1, "h", None), ("t", 2, "x", None), ("u", 0, "x", 5)], "tool string, ord int, expected string, step_index int")
    assert rows(workflow.invalidated(instances, rules, 1000, 300), "id", "invalid") == [(1, False), (2, True), (3, True), (4, False)]
    one = spark.range(1)
    tokens = synthesis.option_tokens(F.lit("a_b"), F.lit("false"), F.lit("bool_pair"), F.lit("--keep"))
    assert one.select(tokens.alias("t")).first().t == ["--no-keep"]
    assert text.os_selector([("windows", "w"), ("linux", "l")]) == '${context.os == "windows" ? w : l}'


def test_best_match_takes_the_first_of_equals_and_nulls_as_zero(spark):
    results = spark.createDataFrame([("g", "a", 0, None), ("g", "b", 1, 0.0), ("h", "c", 0, 0.5), ("h", "d", 1, 0.9), ("h", "e", 2, 0.9)], "group string, id string, ord int, score double")
    assert rows(library.best_match(results, "group")) == [("g", "a"), ("h", "d")]
