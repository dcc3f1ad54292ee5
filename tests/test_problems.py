"""Levels of deep graphs and the problems of those that have none, against plain re-computations."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import workflow


def levels(steps, needs):
    at, rest = {}, set(steps)
    while ready := {s for s in rest if all(n in at for n in needs.get(s, ()))}:
        at |= {s: max((at[n] + 1 for n in needs.get(s, ())), default=0) for s in ready}
        rest -= ready
    return at


def reach(starts, ways):
    seen, now = set(), list(starts)
    while now:
        for n in ways.get(now.pop(), ()):
            if n not in seen:
                seen.add(n)
                now.append(n)
    return seen


def drawn(seed, backward):
    """Workflows of chains that meet and part, with some missing steps and, if asked, edges that close cycles."""
    r, steps, needs = random.Random(seed), [], {}
    for wf in range(8):
        n = r.choice([1, 4, 10])
        steps += [(wf, i) for i in range(n)]
        for i in range(1, n):
            own = {i - 1} if r.random() < 0.8 else set()
            own |= {r.randrange(i) for _ in range(r.choice([0, 0, 0, 1, 2]))}
            if backward and r.random() < 0.06:
                own.add(r.randrange(i, n))
            if r.random() < 0.01:
                own.add(1000 + i)
            needs[wf, i] = {(wf, x) for x in own}
    return steps, needs


def tables(spark, steps, needs):
    rows = [(*s, n[1]) for s, own in needs.items() for n in own]
    return spark.createDataFrame(steps, "wf int, step bigint"), spark.createDataFrame(rows, "wf int, step bigint, needs bigint")


@pytest.mark.parametrize("seed,backward,rest", [(1, False, 0), (2, True, 0), (3, True, 60)])
def test_levels_and_problems(spark, monkeypatch, seed, backward, rest):
    monkeypatch.setattr(workflow, "PLAIN_ROUNDS", 1)
    steps, needs = drawn(seed, backward)
    own, waits = tables(spark, steps, needs)
    want = levels(steps, needs)
    got = {(r.wf, r.step): r.level for r in workflow.topological_levels(own, waits, rest).collect()}
    assert got == {s: want.get(s) for s in steps}

    told = {(r.wf, r.step): r for r in workflow.dependency_problems(own, waits).collect()}
    assert told.keys() == {s for s in steps if s not in want}
    lost = {s for s in steps if any(n not in set(steps) for n in needs.get(s, ()))}
    assert {s for s, r in told.items() if r.problem == "unknown"} == lost
    for (wf, step), r in told.items():
        assert (wf, r.needs) in needs[wf, step]
        assert (r.cycle is not None) == (r.problem == "cycle")
        if r.problem == "unknown":
            assert r.needs == min(n[1] for n in needs[wf, step] if n not in set(steps))
        if r.problem == "cycle":
            seen, at = [step], r.needs
            while at != step:
                seen.append(at)
                assert len(seen) <= len(told) and told[wf, at].problem in ("cycle", "unknown")
                at = min(n[1] for n in needs[wf, at] if told.get(n) and n in reach([n], needs) | reach_back(needs, n)) if told[wf, at].problem == "unknown" else told[wf, at].needs
            assert r.cycle == min(seen)
        if r.problem == "behind":
            assert any(told[n].problem != "behind" for n in reach([(wf, step)], needs) if n in told)
    # a cycle that waits for no other has a witness
    on = {s for s in steps if s in reach([s], needs)}
    for s in on:
        ahead = reach([s], needs)
        assert any(told[n].problem == "cycle" or n in lost for n in ahead & on)


def reach_back(needs, s):
    return {t for t in needs if s in reach([t], needs)}


def test_a_long_chain_takes_few_rounds(spark):
    n = 20000
    steps = spark.range(n).select(F.lit("w").alias("wf"), F.col("id").alias("step"))
    waits = steps.filter("step > 0").withColumn("needs", F.col("step") - 1).union(steps.filter("step > 9").withColumn("needs", F.col("step") - 10).filter("step % 100 = 0"))
    got = workflow.topological_levels(steps, waits, rest_rows=0)
    assert got.filter("level = step").count() == n


def test_long_cycles_and_what_stands_behind_them(spark):
    n = 3000
    own = spark.range(n).select(F.lit(1).alias("wf"), F.col("id").alias("step"))
    ring = own.withColumn("needs", F.pmod(F.col("step") - 1, F.lit(2000)))  # 0..1999 go round; 2000 needs 1999, the rest are a chain behind 1999 mod 2000
    told = workflow.dependency_problems(own, ring, rest_rows=0)
    assert told.groupBy("problem").count().orderBy("problem").collect() == [("behind", 1000), ("cycle", 2000)]
    assert told.filter("cycle <> 0").count() == 0
    assert workflow.dependency_problems(own.filter("false"), ring.filter("false")).collect() == []
    alone = workflow.dependency_problems(own.limit(1), own.limit(1).withColumn("needs", F.col("step"))).collect()
    assert [(r.problem, r.needs, r.cycle) for r in alone] == [("cycle", 0, 0)]


def test_levels_are_joined_without_the_driver(spark):
    """stored tables were broadcast, so all rows went through the driver."""
    steps = spark.range(2000).select(F.lit(0).alias("wf"), F.col("id").alias("step"))
    waits = steps.filter("step > 0").withColumn("needs", F.floor(F.col("step") / 2).cast("long"))
    levels = workflow.topological_levels(steps, waits)
    assert "Broadcast" not in levels._jdf.queryExecution().executedPlan().toString()
    assert {r.step: r.level for r in levels.collect()} == {i: i.bit_length() for i in range(2000)}
