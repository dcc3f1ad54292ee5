"""Workflows as tables: dependency levels, references between steps, memoised tool calls."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodestone.operators.rounds import Growing, stored

#: `${step_output.step.output:selector(argument)...}`, with the selectors zip, file and folder in any order and number.
STEP_OUTPUT = r"\$\{step_output\.[^.}]+\.[^}:]+(?::(?:zip|file|folder)\([^)]*\))*\}"
EXTERNAL_DATA = r"\$\{external_data\.([^}]+)\}"
#: Rounds that settle a level and no more, before chains are taken out too: shallow graphs are done by then.
PLAIN_ROUNDS = 4
SAVE_MODES = ("false", "true", "full")


def topological_levels(steps: DataFrame, dependencies: DataFrame, rest_rows: int = 1 << 20, whole_rows: int = 256) -> DataFrame:
    """The level of each step: 0 without dependencies, else one more than the highest of them.

    steps(wf, step), dependencies(wf, step, needs).  If no workflow has more than whole_rows (or rest_rows)
    steps and dependencies, all are settled whole, thousands at a time, without rounds.  Else, while more than rest_rows
    dependencies are open (a null one is none), a round settles a level of all workflows at once and drops
    the dependencies on it; after PLAIN_ROUNDS of them, it also takes out steps that wait for one other only, as
    functions of where their chain starts, so long chains cost as many joins as their length has bits.  The rest, which
    rest_rows bounds, is settled to the end workflow by workflow, however deep it is.  Returns wf, step, level; level is
    null for steps on a cycle or behind one, or behind a step that doesn't exist (see dependency_problems).
    """
    steps, dependencies = steps.select("wf", "step"), dependencies.select("wf", "step", "needs").filter("needs is not null")
    if not (whole_rows := min(whole_rows, rest_rows)):
        return _levels_of_large(steps, dependencies, rest_rows)
    rows = steps.withColumn("needs", F.lit(None).cast(dependencies.schema["needs"].dataType)).union(dependencies)
    large = rows.groupBy("wf").count().filter((F.col("count") > whole_rows) & F.col("wf").isNotNull())
    # not split by a join on wf: all rows of a large workflow would fall to one task
    return _levels_of_small(rows) if large.isEmpty() else _levels_of_large(steps, dependencies, rest_rows)


def _levels_of_small(rows: DataFrame) -> DataFrame:
    """topological_levels() of workflows that one row can hold: wf, step, needs, which is null in a step's own row."""
    named = F.col("wf").isNotNull() & F.col("step").isNotNull()
    loose = rows.filter(~named & F.col("needs").isNull()).select("wf", "step", F.lit(0).cast("long").alias("level"))  # nothing is known to wait for these, nor they for anything
    schema = StructType([StructField(c, rows.schema[c].dataType) for c in ("wf", "step")] + [StructField("level", LongType())])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                lengths = pc.list_value_length(part.column("own")).to_numpy()
                step, needs = part.column("own").flatten().flatten()
                row = np.repeat(np.arange(part.num_rows), lengths)
                codes = pa.concat_arrays([step, needs]).dictionary_encode()
                code, width = pc.fill_null(codes.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64), len(codes.dictionary)
                is_step = code[len(step) :] < 0
                at = row * width + code[: len(step)]
                nodes, place = np.unique(at[is_step], return_inverse=True)
                levels = _waves(nodes, at[~is_step], row[~is_step] * width + code[len(step) :][~is_step])[place]
                yield pa.RecordBatch.from_arrays([part.column("wf").take(pa.array(row[is_step])), step.filter(pa.array(is_step)), pa.array(levels, pa.int64(), mask=levels < 0)], ["wf", "step", "level"])

    own = rows.filter(named).groupBy("wf").agg(F.collect_list(F.struct("step", "needs")).alias("own"))
    return own.mapInArrow(settle, schema).union(loose)


def _waves(nodes: np.ndarray, waiting: np.ndarray, needed: np.ndarray) -> np.ndarray:
    """The level of each node (sorted, distinct), -1 where it never settles; waiting nodes need the needed ones."""
    if not len(nodes):
        return nodes

    def places(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(nodes, of), len(nodes) - 1)
        return at, nodes[at] == of

    (to, known), (source, there) = places(waiting), places(needed)
    left = np.bincount(to[known], minlength=len(nodes))
    order = np.flatnonzero(known & there)
    order = order[np.argsort(source[order], kind="stable")]
    to, first = to[order], np.searchsorted(source[order], np.arange(len(nodes) + 1))
    levels, now, level = np.full(len(nodes), -1), np.flatnonzero(left == 0), 0
    while len(now):
        levels[now] = level
        n = first[now + 1] - first[now]
        edges = np.repeat(first[now] - np.cumsum(n) + n, n) + np.arange(n.sum())
        met, times = np.unique(to[edges], return_counts=True)
        left[met] -= times
        now, level = met[left[met] == 0], level + 1
    return levels


def _levels_of_large(steps: DataFrame, dependencies: DataFrame, rest_rows: int) -> DataFrame:
    """topological_levels() by rounds."""
    open_ = steps.select("wf", "step").withColumn("base", F.lit(0).cast("long"))  # a step's level is at least its base
    waits = dependencies.select("wf", "step", "needs").filter("needs is not null").distinct().withColumn("w", F.lit(1).cast("long"))  # and at least w above that of what it needs
    settled, chained, rounds, stuck = Growing(), [], 0, False
    while waits.count() > rest_rows and not stuck:
        ready = stored(open_.join(_dealt(waits.select("wf", "step")), ["wf", "step"], "left_anti").withColumnRenamed("base", "level"))
        stuck = ready.isEmpty()
        if not stuck:
            settled.add(ready)
            met = waits.join(_dealt(ready.select("wf", F.col("step").alias("needs"), "level")), ["wf", "needs"], "left")
            open_, waits = _raised(open_.join(_dealt(ready), ["wf", "step"], "left_anti"), stored(met, waits).withColumn("least", F.col("level") + F.col("w")))
        rounds += 1
        if rounds > PLAIN_ROUNDS or stuck:
            chains = _chains(open_, waits)
            if not chains.isEmpty():
                stuck = False
                chained.append(chains)
                to_root = chains.select("wf", F.col("step").alias("needs"), "root", F.col("w").alias("_w"), "base")
                met = waits.join(_dealt(chains), ["wf", "step"], "left_anti").join(_dealt(to_root), ["wf", "needs"], "left")
                moved = met.select("wf", "step", F.coalesce("root", "needs").alias("needs"), (F.col("w") + F.coalesce("_w", F.lit(0))).alias("w"), F.lit(None).cast("long").alias("level"), (F.col("base") + F.col("w")).alias("least"))
                open_, waits = _raised(open_.join(_dealt(chains), ["wf", "step"], "left_anti"), stored(moved, waits))
    free = open_.join(_dealt(waits.select("wf", "step")), ["wf", "step"], "left_anti").withColumnRenamed("base", "level")
    behind = open_.join(_dealt(waits.select("wf", "step").distinct()), ["wf", "step"], "left_semi")
    if stuck:
        last = free.union(behind.select("wf", "step", F.lit(None).cast("long").alias("level")))
    else:
        told = waits.join(_dealt(free.select("wf", F.col("step").alias("needs"), "level")), ["wf", "needs"], "left").join(_dealt(behind.distinct()), ["wf", "step"])
        told = told.groupBy("wf").applyInPandas(_settled, StructType([steps.schema["wf"], steps.schema["step"], StructField("level", LongType())]))
        last = free.union(behind.select("wf", "step").join(_dealt(told), ["wf", "step"], "left"))
    levels = settled.union(last)
    for chains in reversed(chained):
        levels = stored(levels)
        starts = levels.select("wf", F.col("step").alias("root"), F.col("level").alias("_l")).distinct()
        level = F.when(F.col("_l").isNotNull(), F.greatest(F.col("base"), F.col("_l") + F.col("w")))
        levels = levels.union(chains.join(_dealt(starts), ["wf", "root"], "left").select("wf", "step", level.alias("level")))
    return levels


def _dealt(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the graph: its stored files may be small enough for a broadcast, which would send all its rows through the driver."""
    return df.hint("merge")


def _raised(open_: DataFrame, met: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Open steps with bases raised to what met(wf, step, needs, w, level, least) gives, and the waits that are left: those without a level, the largest of each pair."""
    least = met.filter("least is not null").groupBy("wf", "step").agg(F.max("least").alias("_least"))
    raised = open_.join(_dealt(least), ["wf", "step"], "left").select("wf", "step", F.greatest("base", "_least").alias("base"))
    return stored(raised, open_), stored(met.filter("level is null").groupBy("wf", "step", "needs").agg(F.max("w").alias("w")))


def _chains(open_: DataFrame, waits: DataFrame) -> DataFrame:
    """Steps that wait for one other only, with where their chain of such steps starts: wf, step, root, w, base, so that level = max(base, level of root + w).

    Pointers double, with the functions composed.  Chains that start nowhere, on a cycle or behind one, have no row.
    """
    one = waits.groupBy("wf", "step").agg(F.count("*").alias("n"), F.any_value("needs").alias("root"), F.any_value("w").alias("w")).filter("n = 1").drop("n")
    links = stored(one.join(_dealt(open_), ["wf", "step"]).dropDuplicates(["wf", "step"]).select("wf", "step", "root", "w", "base"))
    inside = links.select("wf", F.col("step").alias("root"), F.lit(True).alias("inside"))
    links, before = stored(links.join(_dealt(inside), ["wf", "root"], "left").select("wf", "step", "root", "w", "base", F.col("inside").isNull().alias("ended")), links), -1
    while (left := links.filter("not ended").count()) not in (0, before):  # each round fewer, unless all that is left goes round
        above = links.select("wf", F.col("step").alias("root"), F.col("root").alias("_root"), F.col("w").alias("_w"), F.col("base").alias("_base"), F.col("ended").alias("_ended"))
        met = links.filter("not ended").join(_dealt(above), ["wf", "root"])
        jumped = met.select("wf", "step", F.col("_root").alias("root"), (F.col("_w") + F.col("w")).alias("w"), F.greatest("base", F.col("_base") + F.col("w")).alias("base"), F.col("_ended").alias("ended"))
        before, links = left, stored(links.filter("ended").union(jumped), links)
    return links.filter("ended").drop("ended")


def _settled(own: pd.DataFrame) -> pd.DataFrame:
    """The levels of one workflow's waiting steps (step, needs, w, base, level of needs if it is settled); null where it never settles."""
    needed_by, left, at = defaultdict(list), Counter(own["step"]), dict(zip(own["step"], own["base"], strict=True))
    for step, needs, w in zip(own["step"], own["needs"], own["w"], strict=True):
        needed_by[needs].append((step, w))
    known = own[own["level"].notna()].drop_duplicates("needs")
    now = list(zip(known["needs"], known["level"].astype("int64"), strict=True))
    levels: dict = dict.fromkeys(left)
    while now:
        after = []
        for needs, level in now:
            for step, w in needed_by[needs]:
                at[step] = max(at[step], level + w)
                left[step] -= 1
                if not left[step]:
                    levels[step] = at[step]
                    after.append((step, at[step]))
        now = after
    return pd.DataFrame({"wf": own["wf"].iloc[0], "step": list(levels), "level": pd.array(list(levels.values()), dtype="Int64")})


def dependency_problems(steps: DataFrame, dependencies: DataFrame, rest_rows: int = 1 << 20) -> DataFrame:
    """Why steps have no level: wf, step, problem, needs, cycle.

    problem is `unknown` for a step that needs one that doesn't exist (needs: the first of them), `cycle` for one on a
    witness cycle (needs: the step before it on the cycle; cycle: its smallest step), and `behind` for one that waits, at
    whatever distance, for such steps (needs: one that it waits for).  Each cycle that waits for no other has a
    witness in its component, and what shares the component with the witness or waits for it is behind.
    Cycles are found by doubling: in a table where each step points to one that it waits for, as many jumps as
    there are steps end on a cycle.  A step that occurs twice, or needs something twice, counts once.
    """
    known, named = steps.select("wf", "step").distinct(), dependencies.select("wf", "step", "needs").filter("needs is not null").distinct()
    lost = named.join(known.withColumnRenamed("step", "needs"), ["wf", "needs"], "left_anti").groupBy("wf", "step").agg(F.min("needs").alias("lost"))
    open_ = stored(topological_levels(known, named, rest_rows).filter("level is null").select("wf", "step"))
    inner = stored(named.join(open_, ["wf", "step"], "left_semi").join(open_.withColumnRenamed("step", "needs"), ["wf", "needs"], "left_semi").select("wf", "step", "needs"))
    tangled = stored(topological_levels(open_, inner, rest_rows).filter("level is null").select("wf", "step"))
    ways = inner.join(tangled, ["wf", "step"], "left_semi").join(tangled.withColumnRenamed("step", "needs"), ["wf", "needs"], "left_semi")
    first = stored(ways.groupBy("wf", "step").agg(F.min("needs").alias("needs")))
    jump = first.select("wf", "step", F.col("needs").alias("to"), F.col("needs").alias("least"))
    longest, reach = first.groupBy("wf").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("n")).first().n, 1
    while reach < longest:
        above = jump.select("wf", F.col("step").alias("to"), F.col("to").alias("_to"), F.col("least").alias("_least"))
        jump, reach = stored(jump.join(above, ["wf", "to"]).select("wf", "step", F.col("_to").alias("to"), F.least("least", "_least").alias("least")), jump), 2 * reach
    round_ = jump.select("wf", F.col("to").alias("step")).distinct().join(jump.select("wf", "step", F.col("least").alias("cycle")), ["wf", "step"])
    waits_for = inner.groupBy("wf", "step").agg(F.min("needs").alias("ahead"))
    told = open_.join(lost, ["wf", "step"], "left").join(first, ["wf", "step"], "left").join(round_, ["wf", "step"], "left").join(waits_for, ["wf", "step"], "left")
    problem = F.when(F.col("lost").isNotNull(), "unknown").when(F.col("cycle").isNotNull(), "cycle").otherwise("behind")
    return told.select("wf", "step", problem.alias("problem"), F.coalesce("lost", "needs", "ahead").alias("needs"), F.when(problem == "cycle", F.col("cycle")).alias("cycle"))


def selectors(chain: Column) -> Column:
    """The selectors of a text such as `:zip(m):file(p)`, in order: array of kind and argument."""
    each = F.regexp_extract_all(chain, F.lit(r":(?:zip|file|folder)\([^)]*\)"), F.lit(0))
    return F.transform(each, lambda x: F.struct(F.substring_index(F.substr(x, F.lit(2)), "(", 1).alias("kind"), F.regexp_extract(x, r"\(([^)]*)\)$", 1).alias("argument")))


def step_references(templates: DataFrame, column: str) -> DataFrame:
    """All `${step_output.step.output[:selectors]}` of a text column: the other columns, step, output, member, chain.

    member is the argument of a leading zip; chain is the selectors' text, for selectors().
    A template is searched once; a reference is cut at its first two dots and its first colon.
    """
    found = F.regexp_extract_all(F.col(column), F.lit(STEP_OUTPUT), F.lit(0))
    inner = F.substr("ref", F.lit(3), F.length("ref") - 3)
    rest = F.substr(inner, F.length(F.substring_index(inner, ".", 2)) + 2)
    output = F.substring_index(rest, ":", 1)
    chain = F.substr(rest, F.length(output) + 1)
    member = F.when(chain.startswith(":zip("), F.nullif(F.substring_index(F.substr(chain, F.lit(6)), ")", 1), F.lit("")))
    others = [c for c in templates.columns if c != column]
    return templates.withColumn("ref", F.explode(found)).select(*others, F.split_part(inner, F.lit("."), F.lit(2)).alias("step"), output.alias("output"), member.alias("member"), chain.alias("chain"))


def required_outputs(steps: DataFrame, references: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Each step's outputs that others refer to or that are declared, sorted; empty if none."""
    named = references.select("wf", "step", "output")
    if declared is not None:
        named = named.union(declared.select("wf", "step", "output"))
    sets = named.groupBy("wf", "step").agg(F.array_sort(F.collect_set("output")).alias("outputs"))
    return steps.select("wf", "step").join(sets, ["wf", "step"], "left").withColumn("outputs", F.coalesce("outputs", F.array().cast("array<string>")))


def required_members(references: DataFrame) -> DataFrame:
    """The archive members that references to each (step, output) name, sorted."""
    return references.filter("member is not null").groupBy("wf", "step", "output").agg(F.array_sort(F.collect_set("member")).alias("members"))


def resolved_references(references: DataFrame, outputs: DataFrame) -> DataFrame:
    """References with the hash of the output they name, null where there is none."""
    return references.join(outputs.select("wf", "step", "output", "hash"), ["wf", "step", "output"], "left")


def has_outputs(stored: Column, required: Column) -> Column:
    return F.size(F.array_except(required, stored)) == 0


def probe_cache(calls: DataFrame, instances: DataFrame) -> DataFrame:
    """Whether each call (key, required) is answered by an instance of that key with all required outputs."""
    held = instances.select("key", F.col("outputs").alias("_o"))
    return calls.join(held, "key", "left").withColumn("hit", F.coalesce(has_outputs(F.col("_o"), F.col("required")), F.lit(False))).drop("_o")


def run_summary(steps: DataFrame) -> DataFrame:
    """executed, cached, failed and total of each workflow, from a status column."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return steps.groupBy("wf").agg(n("executed"), n("cached"), n("failed"), F.count("*").alias("total"))


def by_recency() -> list[Column]:
    """Impure before pure, newer impure first, then the larger key; pure ones are ordered by key alone."""
    return [F.desc("impure"), F.desc(F.when(F.col("impure"), F.col("executed_at")).otherwise(0)), F.desc("key")]


def most_recent(instances: DataFrame, group: str) -> DataFrame:
    """Of each group the instance that recency puts first; one pass, without sorting groups."""
    rank = F.struct("impure", F.when(F.col("impure"), F.col("executed_at")).otherwise(0).alias("t"), "key")
    return instances.groupBy(group).agg(F.max_by("key", rank).alias("key"), F.count("*").alias("instances"))


def matched_instances(steps: DataFrame, instances: DataFrame) -> DataFrame:
    """An instance for each step (step, tool, key, required): strict if tool, key and outputs match, else relaxed.

    Where instances tell `made_key`, the key that their own inputs give, and it isn't their
    key, they match no step strictly; where they tell `readable`, those whose outputs can't be read match none.

    Relaxed takes, among instances of the tool with all required outputs, the one
    with the fewest outputs, then the newest, then the larger key.
    """
    if "readable" in instances.columns:
        instances = instances.filter("readable")
    fits = instances.select("tool", F.col("key").alias("ikey"), "outputs", "executed_at")
    own = instances.filter(F.col("made_key") == F.col("key")) if "made_key" in instances.columns else instances
    strict = steps.join(own.select("tool", "key", "outputs"), ["tool", "key"]).filter(has_outputs(F.col("outputs"), F.col("required"))).select("step", F.col("key").alias("instance"), F.lit("strict").alias("how"))
    open_ = steps.join(strict, "step", "left_anti").withColumn("required", F.array_sort("required"))
    # of instances with the same outputs only the best can win, and steps with the same needs share it: kinds meet kinds, not rows rows
    kinds = fits.groupBy("tool", F.array_sort("outputs").alias("outputs")).agg(F.max(F.struct("executed_at", "ikey")).alias("best"))
    needs = open_.select("tool", "required").distinct()
    rank = F.struct((-F.size("outputs")).alias("n"), "best.executed_at", "best.ikey")
    met = needs.join(kinds, "tool").filter(has_outputs(F.col("outputs"), F.col("required"))).groupBy("tool", "required").agg(F.max_by("best.ikey", rank).alias("instance"))
    return strict.union(open_.join(met, ["tool", "required"]).select("step", "instance", F.lit("relaxed").alias("how")))


def merged_persistence(policies: DataFrame, group: str) -> DataFrame:
    """Saved only if all say so, forced full if any does."""
    return policies.groupBy(group).agg(F.bool_and("save").alias("save"), F.bool_or("force_full").alias("force_full"))


def widest_save_mode(policies: DataFrame, group: str) -> DataFrame:
    """The most permissive mode: full over true over false; nulls don't count."""
    rank = F.array_position(F.array(*map(F.lit, SAVE_MODES)), F.col("mode"))
    return policies.groupBy(group).agg(F.max(F.when(F.col("mode").isNotNull(), rank)).alias("r")).select(group, F.when(F.col("r").isNotNull(), F.element_at(F.array(*map(F.lit, SAVE_MODES)), F.col("r").cast("int"))).alias("mode"))


def tool_by_name(tools: DataFrame) -> DataFrame:
    """Of each name's entries the first builtin, else the last with content, else the first of all, by key."""
    name = Window.partitionBy("name")
    class_ = F.when(F.col("builtin"), 0).when(F.col("has_content"), 1).otherwise(2)
    ranked = tools.withColumn("class", class_).withColumn("up", F.row_number().over(name.orderBy("class", "key"))).withColumn("down", F.row_number().over(name.orderBy("class", F.desc("key"))))
    lowest = F.min("class").over(name)
    picked = ranked.withColumn("low", lowest).filter((F.col("class") == F.col("low")) & F.when(F.col("class") == 1, F.col("down") == 1).otherwise(F.col("up") == 1))
    return picked.select("name", "key", "class")


def active_tool(tools: DataFrame) -> DataFrame:
    """Of each name the first entry with content, else the first."""
    return tools.groupBy("name").agg(F.min_by("key", F.struct((~F.col("has_content")).alias("n"), "key")).alias("key"))


def invalidated(instances: DataFrame, rules: DataFrame, now: int, ttl: int) -> DataFrame:
    """Whether each instance (id, tool, hashes, synced_at) is out of date.

    The first rule (tool, ord, expected) of its tool with expected hashes decides by
    comparing them; without one, an impure sync older than ttl does.
    """
    first = rules.filter("expected is not null and step_index is null").groupBy("tool").agg(F.min_by("expected", "ord").alias("expected"))
    late = F.col("synced_at").isNotNull() & (F.greatest(F.lit(0), F.lit(now) - F.col("synced_at")) > ttl)
    return instances.join(first, "tool", "left").withColumn("invalid", F.when(F.col("expected").isNotNull(), F.col("hashes") != F.col("expected")).otherwise(F.coalesce(late, F.lit(False)))).drop("expected")


def materialisable(instances: DataFrame, required: DataFrame, outputs: DataFrame, live: DataFrame, members: DataFrame) -> DataFrame:
    """Whether all required outputs of each instance can be made: stored, live, and with the required archive members.

    required(key, output, member) has a row for each member, or one with a null
    member; outputs(key, output, hash); live(hash); members(hash, member).  An
    instance that requires nothing can be made.
    """
    held = required.join(outputs, ["key", "output"], "left").join(live.select("hash", F.lit(True).alias("alive")).distinct(), "hash", "left")
    told = held.join(members.select("hash", "member", F.lit(True).alias("inside")).distinct(), ["hash", "member"], "left")
    ok = F.bool_and(F.coalesce("alive", F.lit(False)) & (F.col("member").isNull() | F.coalesce("inside", F.lit(False)))).alias("ok")
    return instances.select("key").join(told.groupBy("key").agg(ok), "key", "left").select("key", F.coalesce("ok", F.lit(True)).alias("materialisable"))
