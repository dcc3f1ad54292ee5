"""Trees and chains as parent tables.

Trees are walked upwards by doubling: each round a node's pointer jumps as far again
as it has come, so a tree of any depth takes as many rounds as its depth has bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.rounds import cut


def delta_chains(objects: DataFrame, most: int = 5) -> DataFrame:
    """Each delta's chain of bases, `most` hops at most: hash, root, hops, complete.

    complete is false where the chain goes on after `most` hops or comes back to
    itself.  objects(hash, base_hash) has a null base for whole objects.
    """
    base = objects.select(F.col("hash").alias("at"), F.col("base_hash").alias("_base"))
    ends = objects.select("hash", F.col("hash").alias("at"), F.lit(0).cast("long").alias("hops"), F.array("hash").alias("seen"), F.lit(False).alias("cyclic"))
    for _ in range(most):  # a join a hop, of all chains at once
        goes_on = F.col("_base").isNotNull() & ~F.col("cyclic")
        ends = ends.join(base, "at", "left").select(
            "hash", F.when(goes_on, F.col("_base")).otherwise(F.col("at")).alias("at"), (F.col("hops") + F.when(goes_on, 1).otherwise(0)).alias("hops"),
            F.when(goes_on, F.array_append("seen", F.col("_base"))).otherwise(F.col("seen")).alias("seen"), (F.col("cyclic") | (goes_on & F.array_contains("seen", F.col("_base")))).alias("cyclic"),
        )
    more = base.filter("_base is not null").select("at", F.lit(True).alias("goes_on"))
    return ends.join(more, "at", "left").select("hash", F.col("at").alias("root"), "hops", (F.col("goes_on").isNull() & ~F.col("cyclic")).alias("complete"))


def after_delete(objects: DataFrame, deleted: DataFrame) -> DataFrame:
    """Objects left after a delete; direct dependents of a deleted one become whole."""
    gone = deleted.select(F.col("hash").alias("_g")).distinct()
    left = objects.join(gone, objects["hash"] == gone["_g"], "left_anti")
    marked = left.join(gone, left["base_hash"] == gone["_g"], "left")
    return marked.select("hash", F.when(F.col("_g").isNull(), F.col("base_hash")).alias("base_hash"))


def _doubled(rows: DataFrame, values: dict[str, Column], done: Column) -> DataFrame:
    """Rows (node_id, up, ...) after their pointers have jumped until they are null, are done, or go on for ever.

    values tells a row's columns from its own and, with a prefix `u_`, those of the row
    that it points to.  A pointer to a row that doesn't exist stays.  Each round the
    open rows grow fewer, unless all that is left is on a cycle or behind one.
    """
    names = ["node_id", "up", *values]
    before, rows = -1, cut(rows.select(*names))
    while True:
        open_ = F.col("up").isNotNull() & ~done
        left = rows.filter(open_).count()
        if left in (0, before):
            return rows
        above = rows.select(F.col("node_id").alias("up"), *[F.col(c).alias(f"u_{c}") for c in ["up", *values]], F.lit(True).alias("u_known"))
        met = rows.filter(open_).join(above, "up", "left")
        moved = {"up": F.when(F.col("u_known"), F.col("u_up")).otherwise(F.col("up"))} | {c: F.when(F.col("u_known"), v).otherwise(F.col(c)) for c, v in values.items()}
        after = met.select("node_id", *[v.alias(c) for c, v in moved.items()])
        before, rows = left, cut(rows.filter(~open_).union(after), rows)


def flattened(nodes: DataFrame) -> DataFrame:
    """Every node's path and what it inherits: node_id, path, depth, sanitize, place.

    nodes(node_id, parent_id, ord, name, sanitize) with unique node_ids; a null
    sanitize is inherited.  `place` sorts nodes in pre-order.  All but node_id are
    null for nodes on a cycle, behind one, or under a parent that doesn't exist.
    """
    digits = F.col("ord").cast("string")
    place = F.when(F.length(digits) <= 8, F.lpad(digits, 8, "0")).otherwise(F.concat(F.lit(":"), F.lpad(digits, 19, "0")))  # a colon sorts behind digits
    own = nodes.select("node_id", F.col("parent_id").alias("up"), F.col("name").alias("path"), F.lit(0).cast("long").alias("depth"), "sanitize", place.alias("place"))
    values = {
        "path": F.concat("u_path", F.lit("/"), "path"),
        "depth": F.col("u_depth") + F.col("depth") + 1,
        "sanitize": F.coalesce("sanitize", "u_sanitize"),
        "place": F.concat("u_place", F.lit("."), "place"),
    }
    told = _doubled(own, values, F.lit(False)).withColumn("sanitize", F.coalesce("sanitize", F.lit("default")))
    return told.select("node_id", *[F.when(F.col("up").isNull(), F.col(c)).alias(c) for c in values])


def below(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """The ids of roots and of everything under them; a cycle that a root is on, or above, is under it as a whole."""
    hit = roots.select("node_id", F.lit(True).alias("hit")).distinct()
    marked = nodes.select("node_id", "parent_id").join(hit, "node_id", "left").select("node_id", F.col("parent_id").alias("up"), F.coalesce("hit", F.lit(False)).alias("hit"))
    found = _doubled(marked, {"hit": F.col("hit") | F.col("u_hit")}, F.col("hit")).filter("hit")
    return found.select("node_id").union(roots.select("node_id")).distinct()


def removed_deep(nodes: DataFrame, condition: Column) -> DataFrame:
    """Nodes left when those that meet the condition go with all that is under them."""
    return nodes.join(below(nodes, nodes.filter(condition)), "node_id", "left_anti")


def inherited_versions(requirements: DataFrame, dependencies: DataFrame) -> DataFrame:
    """A dependency's version, its own or by one hop the required tool's: parent, dep, version, error.

    requirements(tool, version); dependencies(parent, dep, version); `inherit` asks
    for the required version.  Errors: `nothing to inherit`, and `inherits too` of what would be inherited.
    """
    own = requirements.select(F.col("tool").alias("dep"), F.col("version").alias("_v"))
    error = F.when((F.col("version") == "inherit") & F.col("_v").isNull(), "nothing to inherit").when((F.col("version") == "inherit") & (F.col("_v") == "inherit"), "inherits too")
    joined = dependencies.join(own, "dep", "left").withColumn("error", error)
    return joined.select("parent", "dep", F.when(F.col("error").isNotNull(), None).when(F.col("version") == "inherit", F.col("_v")).otherwise(F.col("version")).alias("version"), "error")


def recovered_chain(wanted: DataFrame, known: DataFrame, blobs: DataFrame, most: int = 5) -> DataFrame:
    """Metadata that is missing along the delta chains of wanted objects: hash, len, base_hash, and error rows.

    wanted(base_hash), known(hash), blobs(hash, len, base_hash) as read from stored
    files, base_hash null for whole ones.  A walk stops at known metadata, at a whole
    object, or where there is no file; after `most` recovered deltas it is an error,
    `chain too deep`, with the hash at which it gave up.  Each step is a join of all walks at once.
    """
    at, found = wanted.select(F.col("base_hash").alias("hash")).filter("hash is not null").distinct(), None
    for _ in range(most):
        step = cut(at.join(known.select("hash"), "hash", "left_anti").join(blobs, "hash").select("hash", "len", "base_hash"))
        found = step if found is None else found.union(step)
        at = step.filter("base_hash is not null").select(F.col("base_hash").alias("hash")).distinct()
    late = at.join(known.select("hash"), "hash", "left_anti").select("hash", F.lit(None).cast("long").alias("len"), F.lit(None).cast(blobs.schema["base_hash"].dataType).alias("base_hash"), F.lit("chain too deep").alias("error"))
    return found.distinct().withColumn("error", F.lit(None).cast("string")).union(late)
