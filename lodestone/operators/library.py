"""A library's configuration and its files: selection, playlists, merging and reconciliation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import ancestors, escape_xml, is_blank, stripped


def selected_variants(selectors: DataFrame, available: DataFrame) -> DataFrame:
    """Variants that each owner's ordered selectors name: owner, ord, variant.

    selectors(owner, ord, selector, regex), available(owner, variant).  A selector
    that finds nothing takes `default` if there is one.  Each variant stands where
    it is first selected; regex matches are in the variants' order.
    """
    hit = F.when(F.col("regex"), F.expr("variant rlike selector")).otherwise(F.col("variant") == F.trim("selector"))
    both = selectors.join(available, "owner")
    found = both.filter(hit).select("owner", "ord", "variant")
    none = selectors.join(found.select("owner", "ord").distinct(), ["owner", "ord"], "left_anti").select("owner", "ord")
    default = none.join(available.filter("variant = 'default'"), "owner").select("owner", "ord", "variant")
    firsts = found.union(default).groupBy("owner", "variant").agg(F.min("ord").alias("_o"))
    return firsts.select("owner", (F.row_number().over(Window.partitionBy("owner").orderBy("_o", "variant"))).cast("long").alias("ord"), "variant")


def playlists(entries: DataFrame, kind: str) -> DataFrame:
    """Rendered playlists of entries (playlist, ord, id, path) in their order: playlist, content."""
    xml = {"xspf", "wpl", "asx"}
    id_, path = (escape_xml(F.col("id")), escape_xml(F.col("path"))) if kind in xml else (F.col("id"), F.col("path"))
    n = F.row_number().over(Window.partitionBy("playlist").orderBy("ord")).cast("string") if kind == "pls" else F.lit("")
    lit = F.lit
    line = {
        "m3u8": lambda: F.concat(lit("#EXTINF:-1,"), id_, lit("\n"), path, lit("\n")),
        "pls": lambda: F.concat(lit("File"), n, lit("="), path, lit("\nTitle"), n, lit("="), id_, lit("\nLength"), n, lit("=-1\n")),
        "xspf": lambda: F.concat(lit("   <track>\n    <location>"), path, lit("</location>\n    <title>"), id_, lit("</title>\n   </track>\n")),
        "wpl": lambda: F.concat(lit('    <media src="'), path, lit('"/>\n')),
        "asx": lambda: F.concat(lit(' <entry>\n  <ref href="'), path, lit('"/>\n  <title>'), id_, lit("</title>\n </entry>\n")),
    }[kind]()
    head, tail = {
        "m3u8": (lit("#EXTM3U\n"), lit("")),
        "pls": (F.concat(lit("[playlist]\nNumberOfEntries="), F.size("e").cast("string"), lit("\n")), lit("Version=2\n")),
        "xspf": (lit('<?xml version="1.0" encoding="UTF-8"?>\n<playlist version="1" xmlns="http://xspf.org/ns/0/">\n  <trackList>\n'), lit("  </trackList>\n</playlist>\n")),
        "wpl": (lit('<?wpl version="1.0"?>\n<smil>\n  <head>\n   <meta name="Generator" content="lodestone"/>\n  </head>\n  <body>\n   <seq>\n'), lit("   </seq>\n  </body>\n</smil>\n")),
        "asx": (lit('<asx version="3.0">\n'), lit("</asx>\n")),
    }[kind]
    lines = entries.select("playlist", "ord", line.alias("line")).groupBy("playlist").agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("e"))
    return lines.select("playlist", F.concat(head, F.array_join(F.transform("e", lambda x: x["line"]), ""), tail).alias("content"))


def playlist_members(nodes: DataFrame, media: DataFrame) -> DataFrame:
    """Playlist entries by hierarchy id: playlist, ord, id, path, conflict (the id has several paths)."""
    refs = nodes.select("playlist", F.posexplode("ids").alias("ord", "id"))
    paths = media.groupBy("id").agg(F.min("path").alias("path"), (F.countDistinct("path") > 1).alias("conflict"))
    return refs.join(paths, "id").select("playlist", F.col("ord").cast("long").alias("ord"), "id", "path", "conflict")


def stale_paths(recorded: DataFrame, desired: DataFrame) -> DataFrame:
    """Recorded paths that are neither desired nor beneath a desired one: an equi-join on ancestors, not on prefixes."""
    above = recorded.select("path", F.explode(ancestors(F.col("path"))).alias("up"))
    safe = above.join(desired.select(F.col("path").alias("up")), "up", "left_semi").select("path").distinct()
    return recorded.join(safe, "path", "left_anti")


def duplicate_paths(entries: DataFrame) -> DataFrame:
    """Entries (path, media, ord, variants) that an earlier one of the same path and media overlaps: no variants, or shared ones.

    The first entry of each path and media, and of each of its variants, tells; ord is unique in them.
    """
    key = ["path", "media"]
    first = entries.groupBy(*key).agg(F.min("ord").alias("_first"), F.min(F.when(F.size("variants") == 0, F.col("ord"))).alias("_empty"))
    each = entries.select(*key, "ord", F.explode(F.array_distinct("variants")).alias("_v"))
    made = each.groupBy(*key, "_v").agg(F.min("ord").alias("_made"))
    shared = each.join(made, [*key, "_v"]).filter(F.col("_made") < F.col("ord")).select(*key, "ord", F.lit(True).alias("_shared")).distinct()
    clash = F.coalesce(F.col("_empty") < F.col("ord"), F.lit(False)) | ((F.size("variants") == 0) & (F.col("_first") < F.col("ord"))) | F.coalesce("_shared", F.lit(False))
    return entries.join(first, key).join(shared, [*key, "ord"], "left").filter(clash).select(*entries.columns)


def resolved_variants(wanted: DataFrame, stored_: DataFrame, produced: DataFrame, live: DataFrame) -> DataFrame:
    """The hash of each wanted (media, variant): a live stored one, else `default`'s, else what a workflow produced."""
    alive = stored_.join(live, "hash", "left_semi")
    exact = alive.select("media", "variant", F.col("hash").alias("e"))
    default = alive.filter("variant = 'default'").select("media", F.col("hash").alias("d"))
    made = produced.select("media", "variant", F.col("hash").alias("p"))
    return wanted.join(exact, ["media", "variant"], "left").join(default, "media", "left").join(made, ["media", "variant"], "left").select("media", "variant", F.coalesce("e", "d", "p").alias("hash"))


def producers(steps: DataFrame) -> DataFrame:
    """The last step that produces each variant of each media: media, variant, ord."""
    return steps.groupBy("media", "variant").agg(F.max("ord").alias("ord"))


def step_flows(steps: DataFrame) -> DataFrame:
    """(media, ord, input, output) of steps with arrays: one input feeds all outputs, else they pair up; no inputs: each output itself."""
    n = F.size("inputs")
    pair = lambda i, o: F.struct(i.alias("input"), o.alias("output"))
    one = F.transform("outputs", lambda o: pair(F.get("inputs", 0), o))
    many = F.transform(F.arrays_zip(F.col("inputs").alias("i"), F.col("outputs").alias("o")), lambda z: pair(z["i"], z["o"]))
    same = F.transform("outputs", lambda o: pair(o, o))
    return steps.select("media", "ord", F.explode(F.when(n == 0, same).when(n == 1, one).otherwise(many)).alias("f")).select("media", "ord", "f.input", "f.output")


def invalid_sources(steps: DataFrame) -> DataFrame:
    """Steps (media, ord, ingest, inputs, outputs) that break the rules: media, ord, problem.

    The first step ingests, no other does, and inputs are outputs of earlier steps.
    """
    first = steps.groupBy("media").agg(F.min("ord").alias("_first"))
    made = steps.select("media", "ord", F.explode("outputs").alias("_v")).groupBy("media", "_v").agg(F.min("ord").alias("_made"))
    used = steps.select("media", "ord", F.explode(F.array_distinct("inputs")).alias("_v"))
    unknown = used.join(made, ["media", "_v"], "left").filter(F.col("_made").isNull() | (F.col("_made") >= F.col("ord"))).select("media", "ord", F.lit(True).alias("_unknown")).distinct()
    later = F.col("ord") > F.col("_first")
    problem = F.when(~later & ~F.col("ingest"), "first step must ingest").when(later & F.col("ingest"), "only the first step ingests").when(later & F.col("_unknown"), "unknown input")
    return steps.join(first, "media").join(unknown, ["media", "ord"], "left").select("media", "ord", problem.alias("problem")).filter("problem is not null")


def hierarchy_problems(nodes: DataFrame, media: DataFrame) -> DataFrame:
    """Duplicate ids, unknown media and dangling references of nodes (node_id, media, refs): problem, subject, n."""
    twice = nodes.groupBy(F.col("node_id").alias("subject")).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("duplicate id").alias("problem"), "subject", "n")
    unknown = nodes.filter("media is not null").join(media, "media", "left_anti").groupBy("media").agg(F.count("*").alias("n")).select(F.lit("unknown media"), F.col("media"), "n")
    refs = nodes.select(F.explode("refs").alias("ref"))
    dangling = refs.join(nodes.select(F.col("node_id").alias("ref")), "ref", "left_anti").groupBy("ref").agg(F.count("*").alias("n")).select(F.lit("dangling reference"), "ref", "n")
    return twice.union(unknown).union(dangling)


def merge_conflicts(documents: DataFrame) -> DataFrame:
    """Names that several documents define differently: kind, name, definitions, first document."""
    return documents.groupBy("kind", "name").agg(F.countDistinct("body").alias("definitions"), F.min_by("document", "ord").alias("document")).filter("definitions > 1")


def usage(uses: DataFrame) -> DataFrame:
    """What uses each hash, joined in order."""
    return uses.groupBy("hash").agg(F.array_join(F.array_sort(F.collect_list("description")), "; ").alias("uses"))


def deduplicated_registry(registry: DataFrame, keys: list[str]) -> DataFrame:
    """The latest deployment of each tool and version; the earlier entry wins a tie."""
    rest = [c for c in registry.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct("deployed_at", (-F.col("ord")).alias("o"))).alias("s")
    return registry.groupBy(*keys).agg(newest).select(*keys, "s.*")


def reconciled(desired: DataFrame, actual: DataFrame) -> DataFrame:
    """add, update, skip or prune for each tool of desired(tool, version) and actual(tool, version)."""
    both = desired.select("tool", F.col("version").alias("d")).join(actual.select("tool", F.col("version").alias("a")), "tool", "full")
    action = F.when(F.col("a").isNull(), "add").when(F.col("d").isNull(), "prune").when(F.col("a") != F.col("d"), "update").otherwise("skip")
    return both.select("tool", action.alias("action"))


def requires_sync(tools: DataFrame, registry: DataFrame, desired: DataFrame) -> DataFrame:
    """Whether each tool needs a sync: not in the registry; desired at another version, or without content unless builtin."""
    joined = tools.join(registry, "tool", "left").join(desired.select("tool", F.col("version").alias("want"), "error"), "tool", "left")
    out = F.when(F.col("version").isNull(), True).when(F.col("want").isNull() & ~F.coalesce("error", F.lit(False)), False).when(F.coalesce("error", F.lit(False)), True)
    return joined.select("tool", out.otherwise((F.col("want") != F.col("version")) | (~F.col("builtin") & F.col("content_hash").isNull())).alias("requires"))


def replaced_managed(current: DataFrame, managed: DataFrame, key: str, prefix: str) -> DataFrame:
    """Managed rows (by prefix) replaced as a set; the user's own kept."""
    return current.filter(~F.col(key).startswith(prefix)).unionByName(managed)


def backfilled(entries: DataFrame, found: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Entries with only their null fields filled."""
    joined = entries.join(found.select(*keys, *[F.col(f).alias(f"_{f}") for f in fields]), keys, "left")
    return joined.withColumns({f: F.coalesce(f, f"_{f}") for f in fields}).drop(*[f"_{f}" for f in fields])


def composite_versions(tools: DataFrame, dependencies: DataFrame) -> DataFrame:
    """A tool's version with those of its dependencies, by name: `v+dep=v1+dep=v2`."""
    parts = dependencies.groupBy("tool").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("=", "dep", "dep_version"))), "+").alias("p"))
    return tools.join(parts, "tool", "left").select("tool", F.concat_ws("+", "version", "p").alias("version"))


#: A block of tools meets a block of keys in one task.
BLOCK_TOOLS, BLOCK_KEYS = 4096, 1024


def _block_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """left(tool, dep) and right(dep, key, hash) joined by dep, in blocks of about BLOCK_TOOLS by BLOCK_KEYS rows.  Only counts by dep go beside the rows."""
    counts = left.groupBy("dep").agg(F.count("*").alias("l")).join(right.groupBy("dep").agg(F.count("*").alias("r")), "dep")
    grid = counts.select("dep", F.ceil(F.col("l") / BLOCK_TOOLS).cast("int").alias("ls"), F.ceil(F.col("r") / BLOCK_KEYS).cast("int").alias("rs"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n, *by: F.pmod(F.xxhash64(*by), F.col(n)).cast("int")
    keys = right.join(grid, "dep").select("dep", "key", "hash", own("rs", "key").alias("rb"), each("ls").alias("lb"))
    tools = left.join(grid, "dep").select("dep", "tool", own("ls", "tool").alias("lb"), each("rs").alias("rb"))
    parts = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), grid.agg(F.coalesce(F.sum(F.col("ls") * F.col("rs")), F.lit(0))).first()[0] // 4)
    dealt = lambda df: df.repartition(min(parts, 1 << 15), "dep", "lb", "rb")
    # a sort-merge join goes through a block's tools for each of its keys, in one order
    return dealt(keys).hint("merge").join(dealt(tools), ["dep", "lb", "rb"])


def inlined_content(dependencies: DataFrame, content: DataFrame) -> DataFrame:
    """Content of a tool's dependencies under `deps/`, leaving out what they have inlined themselves.

    The result has a row for each tool and key, however many that is.  It is made in blocks of a dependency's tools and keys, a block
    by one task, so that what a task writes repeats few values and takes little space, and a large dependency is dealt out.
    A key is put together before it meets the tools, once for all of them.
    """
    own = content.filter(~F.col("key").startswith("deps/")).select(F.col("tool").alias("dep"), F.concat(F.lit("deps/"), "tool", F.lit("/"), "key").alias("key"), "hash")
    return _block_join(dependencies.select("tool", "dep"), own).select("tool", "key", "hash")


def without_adjacent_repeats(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Rows whose value differs from the one just before."""
    before = F.lag(value).over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("_b", before).filter(~F.col(value).eqNullSafe(F.col("_b"))).drop("_b")


def insert_position(rows: DataFrame, group: str, order: str, value: str, new: Column) -> DataFrame:
    """Before which row of each group a new value goes, null for the end."""
    return rows.groupBy(group).agg(F.min(F.when(F.col(value) > new, F.col(order))).alias("position"))


def first_per_name(rows: DataFrame, group: str, name: str, order: str) -> DataFrame:
    """Names in the order they first occur, whatever their case: group, name, ord."""
    return rows.groupBy(group, F.lower(name).alias("_l")).agg(F.min_by(name, order).alias("name"), F.min(order).alias("ord")).drop("_l")


def merged_settings(base: DataFrame, over: DataFrame, key: str, always: list[str], fill: list[str]) -> DataFrame:
    """Settings of base under over: `always` fields take the override's value, `fill` ones fall back to base."""
    o = over.select(key, *[F.col(c).alias(f"_{c}") for c in [*always, *fill]])
    joined = base.join(o, key, "left")
    return joined.select(key, *[F.col(f"_{c}").alias(c) for c in always], *[F.coalesce(f"_{c}", c).alias(c) for c in fill])


def step_inputs(declared: DataFrame, defaults: DataFrame) -> DataFrame:
    """Inputs of each step: its own, else the tool's default, else empty."""
    both = declared.select("step", "name", F.col("value").alias("v")).join(defaults.select("step", "name", F.col("value").alias("d")), ["step", "name"], "full")
    return both.select("step", "name", F.coalesce("v", "d", F.lit("")).alias("value"))


def best_match(results: DataFrame, group: str) -> DataFrame:
    """Of each group's results the one with the highest score (null is 0), the first of equals."""
    return results.groupBy(group).agg(F.max_by(F.struct("id", "score"), F.struct(F.coalesce("score", F.lit(0.0)).alias("s"), (-F.col("ord")).alias("o"))).alias("b")).select(group, "b.id")


def covers(images: DataFrame) -> DataFrame:
    """The first entry of each URL by provider priority."""
    return images.groupBy("url").agg(F.min_by(F.struct("provider", "comment"), F.struct("priority", "comment")).alias("s")).select("url", "s.provider", "s.comment")


def primary_cover(images: DataFrame, group: str) -> DataFrame:
    """Of each group the first front image, else the first."""
    return images.groupBy(group).agg(F.min_by("url", F.struct((~F.col("front")).alias("n"), "ord")).alias("url"), F.count("*").alias("images"))


def common_length(a: str, b: str) -> int:
    """The length of the longest sequence of characters that both have in order, a machine word of a at a time."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    every = (1 << len(a)) - 1
    open_ = every
    for c in b:
        found = open_ & places.get(c, 0)
        open_ = (open_ + found | open_ - found) & every
    return len(a) - open_.bit_count()


def _marks(keys: DataFrame, known: DataFrame, least_share: float) -> DataFrame:
    """tool, key, mark: each key's characters (with how often they came before), the rarest of its tool's, as many as a close key must share one of."""
    letters = keys.select("tool", "key", F.explode(F.split("key", "")).alias("letter")).filter("letter <> ''").groupBy("tool", "key", "letter").agg(F.count("*").alias("n"))
    marks = letters.select("tool", "key", F.explode(F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: F.concat(i.cast("string"), F.col("letter")))).alias("mark"))
    often = marks.join(known, ["tool", "key"], "left_semi").groupBy("tool", "mark").agg(F.count("*").alias("often"))
    of_key = Window.partitionBy("tool", "key").orderBy(F.coalesce("often", F.lit(0)), "mark")  # as many rows as the key has characters
    needed = F.length("key") - F.ceil(F.length("key") * F.lit(least_share) - 1e-9) + 1
    return marks.join(often, ["tool", "mark"], "left").withColumn("at", F.row_number().over(of_key)).filter(F.col("at") <= needed).select("tool", "key", "mark")


def close_keys(unknown: DataFrame, known: DataFrame, most: int = 3, cutoff: float = 0.6) -> DataFrame:
    """For each unknown key (tool, key) the closest known ones of the same tool: tool, key, near, rank.

    A key that ends with `_version` names the known one that it is without that, if there is one, and no
    other.  Else keys are compared by the share of characters in common in order, twice their
    number by the sum of lengths; of those at cutoff and above the `most` closest, ties to the
    later by text.  Keys meet where they share one of their rarest characters, enough of which are taken that no
    close pair is missed, and where their lengths allow it.
    """
    own, all_known = unknown.select("tool", "key").filter("key is not null").distinct(), known.select("tool", "key").filter("key is not null").distinct()
    suffix = "_version"
    bare = own.filter(F.col("key").endswith(suffix)).select("tool", "key", F.expr(f"substr(key, 1, length(key) - {len(suffix)})").alias("near"))
    named = bare.join(all_known.withColumnRenamed("key", "near"), ["tool", "near"], "left_semi").select("tool", "key", "near", F.lit(1).cast("long").alias("rank"))
    share = cutoff / (2 - cutoff)  # of a key's characters that a close key shares at least
    marks = _marks(own.unionAll(all_known).distinct(), all_known, share)
    left = marks.join(own.join(named, ["tool", "key"], "left_anti"), ["tool", "key"], "left_semi")
    right = marks.join(all_known, ["tool", "key"], "left_semi").withColumnRenamed("key", "near")
    lengths = (F.least(F.length("key"), F.length("near")) >= F.greatest(F.length("key"), F.length("near")) * share - 1e-9)
    pairs = left.join(right, ["tool", "mark"]).filter(lengths).select("tool", "key", "near").distinct()

    @F.pandas_udf("int")
    def common(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([common_length(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")

    ratio = 2 * F.col("common") / (F.length("key") + F.length("near"))
    close = pairs.withColumn("common", common("key", "near")).withColumn("ratio", ratio).filter(F.col("ratio") >= cutoff)
    ranked = close.withColumn("rank", F.row_number().over(Window.partitionBy("tool", "key").orderBy(F.desc("ratio"), F.desc("near"))).cast("long"))
    return ranked.filter(F.col("rank") <= most).select("tool", "key", "near", "rank").unionAll(named)


def with_aux(objects: DataFrame, aux: DataFrame, name: str) -> DataFrame:
    """Objects with their side payload of one name, null where there is none; aux(hash, name, data)."""
    own = aux.filter(F.col("name") == name).select("hash", F.col("data").alias(name))
    return objects.join(own, "hash", "left")


def backfilled_variants(stored_: DataFrame, produced: DataFrame, live: DataFrame) -> DataFrame:
    """Variants (media, variant, hash) with what workflows produced, where that is live; others stay as stored."""
    new = produced.join(live, "hash", "left_semi").select("media", "variant", F.col("hash").alias("n"))
    return stored_.join(new, ["media", "variant"], "full").select("media", "variant", F.coalesce("n", "hash").alias("hash"))


def resolved_releases(releases: DataFrame, prefix: str = "autobuild-") -> DataFrame:
    """Of each repository the tag marked latest, else the first with the prefix."""
    first = F.min_by("tag", F.when(F.col("tag").startswith(prefix), F.col("ord")))
    marked = F.min_by("tag", F.when(F.col("latest"), F.col("ord")))
    some = lambda c: F.coalesce(F.max(c), F.lit(False))
    own = releases.groupBy("repo").agg(marked.alias("m"), some("latest").alias("has"), first.alias("f"), some(F.col("tag").startswith(prefix)).alias("any"))
    return own.select("repo", F.when(F.col("has"), F.col("m")).when(F.col("any"), F.col("f")).alias("tag"))


def track_positions(releases: DataFrame, recordings: DataFrame) -> DataFrame:
    """The first medium and track, from 1, that holds each recording: release, recording, medium, track.

    releases(release, media array<array<recording>>).
    """
    tracks = releases.select("release", F.posexplode("media").alias("m", "t")).select("release", "m", F.posexplode("t").alias("t", "recording"))
    at = tracks.join(recordings, "recording", "left_semi").groupBy("release", "recording").agg(F.min(F.struct("m", "t")).alias("p"))
    return at.select("release", "recording", (F.col("p.m") + 1).cast("long").alias("medium"), (F.col("p.t") + 1).cast("long").alias("track"))


def byte_budgets(updates: DataFrame) -> DataFrame:
    """By group, bytes done and in all of items (item, pos, estimate, actual): the actual size, once known, replaces the estimate."""
    last = updates.groupBy("group", "item").agg(F.max("pos").alias("pos"), F.max("estimate").alias("estimate"), F.max("actual").alias("actual"))
    total = F.coalesce("actual", "estimate", F.lit(0))
    return last.groupBy("group").agg(F.sum(F.least("pos", total)).alias("pos"), F.sum(total).alias("total"))


def embedded_covers(images: DataFrame, only_front: bool) -> DataFrame:
    """The images to embed: all, or each group's first front one."""
    if not only_front:
        return images
    front = images.filter("front").groupBy("group").agg(F.min("ord").alias("ord"))
    return images.join(front, ["group", "ord"], "left_semi")


def normalized_media(media: DataFrame, texts: list[str]) -> DataFrame:
    """Media with their texts trimmed."""
    return media.withColumns({c: stripped(F.col(c)) for c in texts})


def normalized_tools(tools: DataFrame) -> DataFrame:
    """Tools without those that ask for the latest version and have no dependencies: they say nothing."""
    return tools.filter((F.col("version") != "latest") | (F.size("dependencies") > 0))


def normalized_files(files: DataFrame) -> DataFrame:
    """File records whose path, media and hash aren't blank."""
    return files.filter(~is_blank(F.col("path")) & ~is_blank(F.col("media")) & ~is_blank(F.col("hash")))


def merged_outputs(tools: DataFrame, steps: DataFrame) -> DataFrame:
    """Output specs of each step (step, name, spec): the tool's, each overridden by the step's own of that name."""
    both = tools.select("step", "name", F.col("spec").alias("t")).join(steps.select("step", "name", F.col("spec").alias("s")), ["step", "name"], "full")
    return both.select("step", "name", F.coalesce("s", "t").alias("spec"))
