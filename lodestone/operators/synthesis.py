"""Workflows made from media steps: which step feeds which, and what each expands to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The steps that one mapping of a tool becomes, in order; each needs the one before.
CHAINS = {
    "import": ("import",),
    "media-tagger": ("metadata", "apply"),
    "rsgain": ("extract", "rsgain", "export", "rewrite-track", "rewrite-album", "apply"),
}


def bound_inputs(steps: DataFrame) -> DataFrame:
    """The step that produced each input last before it is needed: media, ord, variant, producer; null if none did.

    steps(media, ord, inputs, outputs).  One pass over each media's uses of a variant,
    in the order of its steps; a step doesn't feed itself.
    """
    made = steps.select("media", "ord", F.explode("outputs").alias("variant")).distinct().withColumn("made", F.col("ord"))
    used = steps.select("media", "ord", F.explode("inputs").alias("variant")).distinct().withColumn("made", F.lit(None).cast(steps.schema["ord"].dataType))
    order = Window.partitionBy("media", "variant").orderBy("ord", F.col("made").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    return made.union(used).withColumn("producer", F.last("made", ignorenulls=True).over(order)).filter("made is null").drop("made")


def dependencies(bound: DataFrame) -> DataFrame:
    """The distinct producers that each step waits for, in order."""
    return bound.filter("producer is not null").groupBy("media", "ord").agg(F.array_sort(F.collect_set("producer")).alias("needs"))


def expanded(mappings: DataFrame) -> DataFrame:
    """Each mapping (media, ord, tool, variant) as its tool's chain of steps: media, ord, variant, step, needs."""
    table = F.create_map(*[x for tool, steps in CHAINS.items() for x in (F.lit(tool), F.array(*map(F.lit, steps)))])
    name = lambda i, s: F.concat_ws("-", F.col("ord").cast("string"), F.col("variant"), i.cast("string"), s)
    steps = table[F.col("tool")]
    rows = mappings.select("media", "ord", "variant", steps.alias("chain"), F.posexplode(steps).alias("i", "s"))
    before = F.when(F.col("i") > 0, name(F.col("i") - 1, F.get("chain", F.col("i") - 1)))
    return rows.select("media", "ord", "variant", name(F.col("i"), F.col("s")).alias("step"), before.alias("needs"))


def slots(outputs: DataFrame, most: int) -> DataFrame:
    """Output slots of each step: media, ord, variant, slot, problem (an index that is taken twice or too high)."""
    w = Window.partitionBy("media", "ord", "idx")
    problem = F.when(F.count("*").over(w) > 1, "index taken twice").when(F.col("idx") >= most, "index too high")
    return outputs.select("media", "ord", "variant", F.concat(F.lit("output-"), F.col("idx").cast("string")).alias("slot"), problem.alias("problem"))


def output_binding(kind: Column, tool: Column, idx: Column, language: Column) -> tuple[Column, Column]:
    """The output that holds a variant and, where that is an archive, the member."""
    output = F.when(tool == "ffmpeg", F.concat(F.lit("output-"), idx.cast("string"))).when(kind.isin("primary", "subtitle"), F.when(kind == "primary", "primary").otherwise("subtitles")).otherwise(kind)
    return output, F.when((tool == "yt-dlp") & (kind == "subtitle"), F.concat(F.lit("."), language, F.lit(".vtt")))


def step_targets(steps: DataFrame, tool: str) -> DataFrame:
    """(media, index) of the steps of a tool, from arrays of tools."""
    return steps.select("media", F.posexplode("tools").alias("i", "t")).filter(F.col("t") == tool).select("media", F.col("i").cast("long").alias("step_index"))


def option_tokens(name: Column, value: Column, kind: Column, flag: Column | None = None) -> Column:
    """Command tokens of an input: flag and value, a flag for true, --no-flag for false of a pair, or none; `--kebab` by default."""
    own = F.coalesce(flag if flag is not None else F.lit(None), F.concat(F.lit("--"), F.replace(name, F.lit("_"), F.lit("-"))))
    none = F.array().cast("array<string>")
    negative = F.concat(F.lit("--no-"), F.substr(own, F.lit(3)))
    return F.when(kind == "pair", F.array(own, value)).when((kind == "bool") & (value == "true"), F.array(own)).when((kind == "bool_pair") & (value == "true"), F.array(own)).when((kind == "bool_pair") & (value == "false"), F.array(negative)).otherwise(none)


def cleared(instances: DataFrame, targets: DataFrame) -> DataFrame:
    """Instances without those of the targeted (media, step_index)."""
    return instances.join(targets, ["media", "step_index"], "left_anti")


def recording_override(raw: Column) -> Column:
    """auto for nothing or `auto`, disabled for `none`, else the id itself."""
    text = F.coalesce(F.trim(raw), F.lit(""))
    return F.when((text == "") | (F.lower(text) == "auto"), "auto").when(F.lower(text) == "none", "disabled").otherwise(text)


def merged_tags(existing: Column, new: Column, clear: Column, failed: Column) -> Column:
    """New tags over existing ones, or alone if a clear is asked for; after a failure the existing ones."""
    kept = F.map_filter(existing, lambda k, v: ~F.array_contains(F.map_keys(new), k))
    return F.when(failed, existing).when(clear, new).otherwise(F.map_concat(kept, new))


def transcoding_steps(steps: DataFrame, bound: DataFrame, outputs: DataFrame, most_inputs: int, most_outputs: int) -> DataFrame:
    """One transcoding step for each media step: media, ord, step, inputs, outputs, needs, problem.

    steps(media, ord, inputs array), bound as bound_inputs gives it (media, ord,
    variant, producer), outputs(media, ord, variant, idx).  Inputs take slots in
    their order, outputs the slots of their idx; needs are the distinct producers in
    the order of the inputs that first name them.  The first rule that is broken is
    the problem: too many inputs, an unknown input, an idx too high or taken twice.
    """
    each = steps.select("media", "ord", F.posexplode("inputs").alias("i", "variant")).join(bound, ["media", "ord", "variant"], "left")
    slot = F.struct("i", F.concat(F.lit("input-"), F.col("i").cast("string"), F.lit("="), F.col("variant")).alias("slot"), "producer")
    read = each.groupBy("media", "ord").agg(F.array_sort(F.collect_list(slot)).alias("s"), F.bool_or(F.col("producer").isNull()).alias("unknown"))
    made = outputs.groupBy("media", "ord").agg(F.array_sort(F.collect_list(F.struct("idx", "variant"))).alias("o"), F.max("idx").alias("top"), (F.countDistinct("idx") < F.count("*")).alias("twice"))
    problem = (
        F.when(F.size("inputs") > most_inputs, "too many inputs")
        .when(F.coalesce("unknown", F.lit(False)), "unknown input")
        .when(F.col("top") >= most_outputs, "index too high")
        .when(F.coalesce("twice", F.lit(False)), "index taken twice")
    )
    none = F.array().cast("array<string>")
    needs = F.filter(F.array_distinct(F.transform("s", lambda x: x["producer"])), lambda x: x.isNotNull())
    held = F.transform("o", lambda x: F.concat(F.lit("output-"), x["idx"].cast("string"), F.lit("="), x["variant"]))
    return steps.join(read, ["media", "ord"], "left").join(made, ["media", "ord"], "left").select(
        "media", "ord", F.concat(F.col("ord").cast("string"), F.lit("-ffmpeg")).alias("step"),
        F.coalesce(F.transform("s", lambda x: x["slot"]), none).alias("inputs"), F.coalesce(held, none).alias("outputs"), F.coalesce(needs, F.array()).alias("needs"), problem.alias("problem"),
    )


def download_steps(variants: DataFrame) -> DataFrame:
    """One download step for each variant (media, ord, i, variant, kind) but archives: media, ord, variant, step, outputs.

    A primary variant's step also yields the archive of its media step, if there is one.
    """
    archive = variants.filter("kind = 'archive'").select("media", "ord", F.lit(True).alias("_archive")).distinct()
    own = variants.filter("kind <> 'archive'").join(archive, ["media", "ord"], "left")
    output = F.when(F.col("kind") == "subtitle", "subtitles").otherwise(F.col("kind"))
    outputs = F.when((F.col("kind") == "primary") & F.col("_archive"), F.array(output, F.lit("archive"))).otherwise(F.array(output))
    step = F.concat_ws("-", F.col("ord").cast("string"), F.col("i").cast("string"), F.lit("yt-dlp"), "variant")
    return own.select("media", "ord", "variant", step.alias("step"), outputs.alias("outputs"))
