"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on a bounded sample; every vector is dealt to a leaf by greedy
descent.  A query walks the tree best bin first: a priority queue holds nodes by
their centres' distance, and the nearest is opened next until enough leaves have
been visited.  How many that is, is calibrated: visits widen until sample queries
reach the wanted recall against brute force on the sample.  A query whose leaves
hold too few rows for k neighbours goes on until they do.

Inner products become distances by one more component, sqrt(M^2 - |x|^2), so that
the nearest vector has the largest inner product, whatever the norms.

A leaf's vectors are packed into blocks of bounded size, so a vector that a third
of all rows share makes more blocks, not a larger one.  Each pair of block and
pack of queries gives each query's best rows, which are merged by query.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import stored

LEAF_ROWS = 1024
BLOCK_ROWS = 4096
PACK_QUERIES = 256


class Tree(NamedTuple):
    """Nodes by number, 0 the root; children[i] is empty for a leaf."""

    centres: np.ndarray
    children: list[np.ndarray]
    #: Leaf number by node, -1 for inner nodes.
    leaf: np.ndarray
    longest: float
    visits: int


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)]
    own = np.zeros(len(x), dtype=np.int64)
    for _ in range(12):
        own = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres, _nearest(x, centres)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def _lifted(x: np.ndarray, longest: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(longest**2 - (x * x).sum(axis=1), 0))[:, None]], axis=1)


def build_tree(sample: np.ndarray, longest: float, leaves: int, branching: int = 8) -> Tree:
    """Splits the sample until it has about `leaves` leaves, the largest node first."""
    rng = np.random.default_rng(3)
    x = _lifted(sample, longest)
    centres, children = [x.mean(axis=0)], [np.zeros(0, dtype=np.int64)]
    queue, n_leaves = [(-len(x), 0, np.arange(len(x)))], 1
    while queue and n_leaves < leaves:
        _, node, own = heapq.heappop(queue)
        k = min(branching, leaves - n_leaves + 1, len(own))
        if k < 2 or (x[own] == x[own[0]]).all():
            continue
        c, part = _kmeans(x[own], k, rng)
        used = np.unique(part)
        if len(used) < 2:
            continue
        children[node] = np.arange(len(centres), len(centres) + len(used))
        for i in used:
            heapq.heappush(queue, (-int((part == i).sum()), len(centres), own[part == i]))
            centres.append(c[i])
            children.append(np.zeros(0, dtype=np.int64))
        n_leaves += len(used) - 1
    leaf = np.full(len(centres), -1)
    at = [i for i, c in enumerate(children) if not len(c)]
    leaf[at] = np.arange(len(at))
    return Tree(np.stack(centres), children, leaf, longest, 1)


def leaves_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Each vector's leaf, by greedy descent."""
    lifted, node = _lifted(x, tree.longest), np.zeros(len(x), dtype=np.int64)
    todo = [0]
    while todo:
        at = todo.pop()
        if len(below := tree.children[at]):
            own = np.flatnonzero(node == at)
            if len(own):
                node[own] = below[_nearest(lifted[own], tree.centres[below])]
                todo.extend(below.tolist())
    return tree.leaf[node]


def best_bins(tree: Tree, query: np.ndarray) -> Iterator[int]:
    """Leaves in best-bin-first order."""
    q = np.append(query, 0.0)
    queue = [(0.0, 0)]
    while queue:
        _, node = heapq.heappop(queue)
        below = tree.children[node]
        if not len(below):
            yield int(tree.leaf[node])
            continue
        for d, child in zip(((tree.centres[below] - q) ** 2).sum(axis=1).tolist(), below.tolist(), strict=True):
            heapq.heappush(queue, (d, child))


def opened(tree: Tree, rows: np.ndarray, query: np.ndarray, k: int) -> Iterator[int]:
    """The leaves that a query visits: tree.visits, and more until they hold k rows besides the query; rows are counts by leaf."""
    held = 0
    for visit, leaf in enumerate(best_bins(tree, query)):
        if visit >= tree.visits and held > k:
            return
        held += int(rows[leaf])
        yield leaf


def calibrated(tree: Tree, sample: np.ndarray, k: int, recall: float, queries: int = 256) -> Tree:
    """The tree with as many leaf visits as bring sample queries to the recall, the visits widening by an eighth."""
    n_leaves = int(tree.leaf.max()) + 1
    at = np.random.default_rng(5).permutation(len(sample))[:queries]
    own = leaves_of(tree, sample)
    scores = sample[at] @ sample.T
    scores[np.arange(len(at)), at] = -np.inf
    most = min(k, len(sample) - 1)
    if most < 1:
        return tree._replace(visits=n_leaves)
    best = np.argpartition(-scores, most - 1, axis=1)[:, :most]
    order = np.zeros((len(at), n_leaves), dtype=np.int64)  # when each query visits each leaf
    for i, a in enumerate(at):
        for when, leaf in enumerate(best_bins(tree, sample[a])):
            order[i, leaf] = when
    when = np.take_along_axis(order, own[best], axis=1)
    visits = 1
    while visits < n_leaves and (when < visits).mean() < recall:
        visits = min(n_leaves, visits + max(1, visits // 8))
    return tree._replace(visits=visits)


def exact_products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component to the last."""
    return np.add.accumulate(rows * query, axis=1)[:, -1]


def best_rows(ids: np.ndarray, rows: np.ndarray, query_id: int, query: np.ndarray, near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best rows for a query by (score descending, id); near are the scores up to rounding."""
    if len(ids) > k + 1:
        edge = np.partition(near, len(near) - k - 1)[len(near) - k - 1]
        at = np.flatnonzero(near >= edge - 1e-9 * max(1.0, abs(float(edge))))
    else:
        at = np.arange(len(ids))
    at = at[ids[at] != query_id]
    score = exact_products(rows[at], query)
    order = np.lexsort((ids[at], -score))[:k]
    return ids[at][order], score[order]


def usable(column: Column, dim: int) -> Column:
    """Whether a vector takes part: of dim finite components, not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return column.isNotNull() & (F.size(column) == dim) & F.forall(column, finite) & F.exists(column, lambda x: x != 0)


def nearest_neighbours(vectors: DataFrame, queries: Column, k: int = 20, recall: float = 0.97, sample_rows: int = 16384, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """For each row of vectors that `queries` selects, its k nearest other rows by inner product.

    The tree is fitted and calibrated on about sample_rows vectors, chosen by a hash
    of vec_id; every vector is indexed.  The number of leaves follows the number of
    vectors, up to an eighth of the sample.

    Returns query_id, rank (from 1), vec_id, score, nearest first, ties to the
    smaller vec_id; fewer than k where there are fewer candidates.  Vectors that are
    null, zero, or hold null or non-finite components take no part, nor do vectors
    of another length than most have, nor rows with a null vec_id.  Rows that repeat
    a vec_id are one vector, the one that sorts first, and ask if any of them does.  Other columns are not read.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), queries.alias("asks")).filter("vec_id is not null")
    size = base.filter("embedding is not null").groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    out = "query_id bigint, rank int, vec_id bigint, score double"
    if size is None:
        return spark.createDataFrame([], out)
    dim = size.dim
    base = base.filter(usable(F.col("embedding"), dim))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    seen = base.agg(F.count("*").alias("n"), F.max(norm).alias("longest")).first()
    if not seen.n:
        return spark.createDataFrame([], out)
    share = min(1.0, sample_rows / seen.n)
    taken = base.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("vec_id", "embedding").toPandas().sort_values("vec_id")
    sample = np.array(taken["embedding"].tolist(), dtype=np.float64).reshape(-1, dim)
    if not len(sample):
        sample = np.zeros((1, dim))
    leaves = int(np.clip(seen.n // leaf_rows, 1, max(1, sample_rows // 8)))
    tree = calibrated(build_tree(sample, float(seen.longest) * (1 + 1e-9), leaves), sample, k, recall)
    shared = spark.sparkContext.broadcast(tree)

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch)
                rows = [r.tobytes() for r in x.astype(np.float64)]
                yield pa.RecordBatch.from_arrays([pa.array(leaves_of(shared.value, x), pa.int32()), batch.column("vec_id"), pa.array(rows, pa.binary()), batch.column("asks")], ["leaf", "vec_id", "v", "asks"])

    dealt = stored(base.groupBy("vec_id").agg(F.min("embedding").alias("embedding"), F.bool_or("asks").alias("asks")).mapInArrow(deal, "leaf int, vec_id bigint, v binary, asks boolean"), "dealt")
    counts = dealt.groupBy("leaf").count().collect()  # a row per leaf: sample_rows / 8 at most
    rows_of = np.zeros(int(tree.leaf.max()) + 1, dtype=np.int64)
    rows_of[[r["leaf"] for r in counts]] = [r["count"] for r in counts]
    held = spark.sparkContext.broadcast(rows_of)
    sizes = spark.createDataFrame([(r["leaf"], -(-r["count"] // BLOCK_ROWS)) for r in counts], "leaf int, parts int")
    placed = dealt.drop("asks").join(F.broadcast(sizes), "leaf").withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts").cast("int"))

    def pack(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("vec_id")
        return pd.DataFrame({"leaf": block["leaf"].iloc[:1], "ids": [block["vec_id"].to_numpy(np.int64).tobytes()], "rows": [b"".join(block["v"])]})

    packed = placed.groupBy("leaf", "part").applyInPandas(pack, "leaf int, ids binary, rows binary")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, PACK_QUERIES):
                batch = whole.slice(begin, PACK_QUERIES)
                x, ids = np.frombuffer(b"".join(batch.column("v").to_pylist())).reshape(-1, dim), batch.column("vec_id").to_numpy(zero_copy_only=False)
                asks: dict[int, list[int]] = {}
                for i, q in enumerate(x):
                    for leaf in opened(shared.value, held.value, q, k):
                        asks.setdefault(leaf, []).append(i)
                rows = [(leaf, ids[at].astype(np.int64).tobytes(), x[at].astype(np.float64).tobytes()) for leaf, at in asks.items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["leaf", "query_ids", "queries"])

    asked = dealt.filter("asks").select("vec_id", "v").mapInArrow(ask, "leaf int, query_ids binary, queries binary")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, rows, query_ids, queries_ in zip(*(batch.column(c).to_pylist() for c in ("ids", "rows", "query_ids", "queries")), strict=True):
                own, x = np.frombuffer(ids, dtype=np.int64), np.frombuffer(rows).reshape(-1, dim)
                who, q = np.frombuffer(query_ids, dtype=np.int64), np.frombuffer(queries_).reshape(-1, dim)
                found = [best_rows(own, x, int(w), q[i], near, k) for i, (w, near) in enumerate(zip(who, q @ x.T, strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.array([f[0].tobytes() for f in found], pa.binary()), pa.array([f[1].tobytes() for f in found], pa.binary())], ["query_id", "ids", "scores"])

    found = asked.join(packed, "leaf").select("ids", "rows", "query_ids", "queries").mapInArrow(search, "query_id bigint, ids binary, scores binary")

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        ids = np.frombuffer(b"".join(group["ids"]), dtype=np.int64)
        score = np.frombuffer(b"".join(group["scores"]))
        order = np.lexsort((ids, -score))[:k]
        return pd.DataFrame({"query_id": group["query_id"].iloc[0], "rank": np.arange(1, len(order) + 1, dtype=np.int32), "vec_id": ids[order], "score": score[order]})

    return found.groupBy("query_id").applyInPandas(merge, out)
