"""Near-duplicate classes by SetSketch registers.

Each document's set of word shingles becomes a SetSketch: register i is
floor(1 - log_b(E_i)), truncated to 16 bits, where E_i is the least of
independent exponential values of the set's elements under hash function i.
Registers are exponentially spaced minima, so sketches of parts merge by maximum
and two sets agree in a register about as often as their Jaccard similarity.

1. Equal sets form a class; only one sketch of a class is used from here on.
2. Bands of registers are hashed; buckets with one class are done.  A class meets
   two classes of each bucket it falls into, the least by id and the least by
   hash; its pairs with the best estimates are verified.
3. Verified links form components.  Where a bucket still holds several
   components, all pairs across them are estimated, in blocks of bounded size,
   each pair in the first bucket it shares.  Those that may reach the threshold
   are counted on the sets' 32-bit hashes, which can only raise the count, and
   what is left is verified.

Estimates maximise the joint likelihood of the registers' order (greater, less,
equal) given both sizes.  Links are confirmed on the full sets.  Pairs inside a
component are never listed, so a large group of copies costs a few rows a member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import bloom
from lodestone.llm.components import connected_components
from lodestone.llm.shared import discard, row_id, stored, told_apart
from lodestone.llm.textops import NON_SPACE, blocks, mix64, window_hashes, words_of

BASE = 1.001
RATE = 20.0
BANDS, ROWS = 48, 6
REGISTERS = BANDS * ROWS
#: Pairs whose estimate is below the threshold by more than this many standard deviations are not verified.
DEVIATIONS = 4.0
#: Pairs with the best estimates that are verified first, for each class.
BEST = 2
#: Bits of the filter that tells which texts are worth reading again; it is broadcast (8 MiB).
FILTER_BITS = 1 << 26
#: Shingles (8 bytes each) of the sets on either side of a block of pairs to verify.
BLOCK_SHINGLES = 1 << 20
#: Rows on either side of a block of pairs.
BLOCK = 1024

_RNG = np.random.default_rng(271828)
_MULTIPLIERS = (_RNG.integers(0, 2**32, REGISTERS, dtype=np.uint32) | np.uint32(1)).astype(np.uint32)
_OFFSETS = _RNG.integers(0, 2**32, REGISTERS, dtype=np.uint32)


def shingle_sets(texts: list[bytes | None], size: int) -> list[np.ndarray]:
    """Sorted hashes of each text's distinct shingles of size words; fewer words are one shingle, none are none."""
    words = words_of([(t or b"").lower() for t in texts], NON_SPACE)
    whole = window_hashes(words.hash, size)
    out = []
    for a, b in zip(words.lo[:-1].tolist(), words.lo[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(whole[a : b - size + 1]))
        else:
            out.append(window_hashes(words.hash[a:b], b - a) if b > a else whole[:0])
    return out


def sketches_of(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of non-empty sets, a row each."""
    lengths = np.array([len(s) for s in sets])
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    least = np.empty((REGISTERS, len(sets)), dtype=np.uint32)
    value = np.empty_like(x)
    for i in range(REGISTERS):
        np.multiply(x, _MULTIPLIERS[i], out=value)
        np.add(value, _OFFSETS[i], out=value)
        np.minimum.reduceat(value, begin, out=least[i])
    exponential = -np.log1p(-(least.T + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, 65535).astype(np.uint16)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """A hash of each band's registers, a row per sketch."""
    parts = sketches.reshape(len(sketches), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key


_GRID = np.linspace(0.0, 1.0, 201)


def estimates(greater: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarities, from how many registers of a are greater and less than those of b."""
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.minimum(_GRID[None, :], np.minimum(u / v, v / u))
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    more, fewer = p(u - v * j), p(v - u * j)
    log = lambda x: np.log(np.maximum(x, 1e-12))
    greater, less = greater[:, None], less[:, None]
    total = greater * log(more) + less * log(fewer) + (REGISTERS - greater - less) * log(1 - more - fewer)
    return j[np.arange(len(u)), total.argmax(axis=1)]


def _least_estimate(threshold: float) -> float:
    return threshold - DEVIATIONS * np.sqrt(threshold * (1 - threshold) / REGISTERS)


def _sketched(docs: DataFrame, size: int) -> DataFrame:
    """_id, doc_id, h1 and h2 (equal for equal sets), n, sketch (once for equal sets of a block)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            sets = shingle_sets(texts, size)
            h1 = np.array([np.add.reduce(s) for s in sets], dtype=np.uint64)
            h2 = np.array([np.bitwise_xor.reduce(mix64(s + np.uint64(0xA0761D6478BD642F))) for s in sets], dtype=np.uint64)
            first: dict[tuple[int, int], int] = {}
            for i, key in enumerate(zip(h1.tolist(), h2.tolist(), strict=True)):
                if len(sets[i]):
                    first.setdefault(key, i)
            registers: list[bytes | None] = [None] * len(sets)
            if first:
                for i, row in zip(first.values(), sketches_of([sets[i] for i in first.values()]), strict=True):
                    registers[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("doc_id"), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array([len(s) for s in sets], pa.int64()), pa.array(registers, pa.binary())],
                ["_id", "doc_id", "h1", "h2", "n", "sketch"],
            )

    return docs.mapInArrow(sketch, "_id bigint, doc_id bigint, h1 bigint, h2 bigint, n bigint, sketch binary")


def _bands(classes: DataFrame) -> DataFrame:
    """bucket, rep: a row for each band of each class."""

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            registers = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)
            keys = band_keys(registers)
            reps = np.repeat(batch.column("rep").to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(reps)], ["bucket", "rep"])

    return classes.select("rep", "sketch").mapInArrow(banded, "bucket bigint, rep bigint")


def _estimated(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Of pairs (a, b) those whose estimate is at least least, with it: a, b, j."""
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS) for c in ("s_a", "s_b"))
            n_a, n_b = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n_a", "n_b"))
            j = estimates((x > y).sum(axis=1), (x < y).sum(axis=1), n_a, n_b)
            kept = pa.array(j >= least)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(kept), batch.column("b").filter(kept), pa.array(j[j >= least])], ["a", "b", "j"])

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(estimate, "a bigint, b bigint, j double")


def _sets_of(ids: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """The shingle sets of documents (_id, text), of all that ids (_need) holds and few others: _id, own.

    A filter over the ids tells which texts are read into sets, so texts aren't shuffled.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield bloom.part(mix64(batch.column("_need").to_numpy(zero_copy_only=False).view(np.uint64)), FILTER_BITS)

    needed = docs.sparkSession.sparkContext.broadcast(bloom.plane(ids.mapInArrow(parts, bloom.PARTS), FILTER_BITS, 1))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            if not whole.num_rows:
                continue
            hit = bloom.hits(needed.value, mix64(whole.column("_id").to_numpy(zero_copy_only=False).view(np.uint64)), FILTER_BITS)
            for batch, texts in blocks([whole.filter(pa.array(hit))]):
                yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array([s.tobytes() for s in shingle_sets(texts, size)], pa.binary())], ["_id", "own"])

    return docs.select("_id", "text").mapInArrow(sets, "_id bigint, own binary").dropDuplicates(["_id"])


def _across(shared: DataFrame, classes: DataFrame, placed: DataFrame, docs: DataFrame, size: int, percent: int, least: float) -> DataFrame:
    """Pairs of one bucket but different components that look linked, with few others, written: a, b.

    In a bucket, every class outside its largest component meets every class of
    other components, in blocks of about BLOCK rows a side.
    """
    sizes = placed.groupBy("component").agg(F.count("*").alias("size"))
    known = placed.join(sizes, "component").select("rep", "component", "size")
    rows = shared.join(known, "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("component"), F.coalesce("size", F.lit(1)).alias("size"))
    main = F.max_by("component", F.struct("size", "component")).alias("main")
    buckets = rows.groupBy("bucket").agg(main, F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("rows")).filter("low < high").drop("low", "high")
    mixed = stored(rows.join(buckets, "bucket").withColumn("minor", F.col("component") != F.col("main")).select("bucket", "rep", "component", "minor", "rows"), "mixed")
    minors = mixed.filter("minor").groupBy("bucket").agg(F.count("*").alias("minors"))
    sized = mixed.join(minors, "bucket").withColumns({"across": F.ceil(F.col("rows") / BLOCK).cast("int"), "down": F.ceil(F.col("minors") / BLOCK).cast("int")})
    own = F.xxhash64("rep")
    every = sized.select("bucket", "rep", "component", F.lit(False).alias("side"), F.pmod(own, "across").cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("y"))
    minor = sized.filter("minor").select("bucket", "rep", "component", F.lit(True).alias("side"), F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("x"), F.pmod(own, "down").cast("int").alias("y"))
    held = _sets_of(mixed.select(F.col("rep").alias("_need")).distinct(), docs, size)

    def shorter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [(np.frombuffer(x, dtype=np.uint64) >> np.uint64(32)).astype(np.uint32).tobytes() for x in batch.column("own").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(own, pa.binary())], ["rep", "own"])

    known_sets = classes.select("rep", "n", "sketch").join(held.mapInArrow(shorter, "rep bigint, own binary"), "rep")
    dealt = every.union(minor).join(known_sets, "rep")
    # one bit of a register agrees with probability J + (1 - J) / 2; five deviations below what `least` gives
    agree = (least + 1) / 2
    differ = REGISTERS * (1 - agree) + 5 * np.sqrt(REGISTERS * agree * (1 - agree))

    def linked(own: list[bytes], i: int, k: int) -> bool:
        s, t = sorted((np.frombuffer(own[i], dtype=np.uint32), np.frombuffer(own[k], dtype=np.uint32)), key=len)
        both = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
        return 100 * both >= percent * (len(s) + len(t) - both)

    def block_pairs(bucket: int, side: np.ndarray, component: np.ndarray, rep: np.ndarray, n: np.ndarray, registers: np.ndarray, own: list[bytes]) -> list[np.ndarray]:
        band = int(np.flatnonzero(band_keys(registers[:1])[0].view(np.int64) == bucket)[0])
        bits = np.packbits(mix64(registers.astype(np.uint64)).astype(np.uint8) & 1, axis=1)
        bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view(np.uint64)
        others, a, b = np.flatnonzero(~side), [], []
        for i in np.flatnonzero(side):
            meets = others[(component[others] != component[i]) & (np.minimum(n[others], n[i]) >= least * np.maximum(n[others], n[i]))]
            meets = meets[np.bitwise_count(bits[meets] ^ bits[i]).sum(axis=1) <= differ]
            a.append(np.full(len(meets), i))
            b.append(meets)
        a, b = np.concatenate(a), np.concatenate(b)
        out = []
        for begin in range(0, len(a), 4096):
            i, k = a[begin : begin + 4096], b[begin : begin + 4096]
            x, y = registers[i], registers[k]
            first = (x == y).reshape(len(x), BANDS, ROWS).all(axis=2).argmax(axis=1) == band
            i, k, x, y = i[first], k[first], x[first], y[first]
            j = estimates((x > y).sum(axis=1), (x < y).sum(axis=1), n[i].astype(float), n[k].astype(float))
            kept = np.array([jj >= least and linked(own, a_, b_) for jj, a_, b_ in zip(j.tolist(), i.tolist(), k.tolist(), strict=True)], dtype=bool)
            out.append(np.stack([np.maximum(rep[i], rep[k]), np.minimum(rep[i], rep[k])])[:, kept])
        return out

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(table: pa.Table) -> Iterator[pa.RecordBatch]:
            columns = [table.column(c).to_numpy() for c in ("bucket", "x", "y", "side", "component", "rep", "n")]
            registers = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)
            own = table.column("own").to_pylist()
            new = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)]))
            found = []
            for a, b in zip(new, [*new[1:], len(registers)], strict=True):
                if columns[3][a:b].any():
                    found += block_pairs(int(columns[0][a]), *(c[a:b] for c in columns[3:]), registers[a:b], own[a:b])
            if found:
                both = np.unique(np.concatenate(found, axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

        held: list[pa.RecordBatch] = []  # batches that end inside a block
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            ends = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "x", "y")]
            cut = np.flatnonzero(np.any([e != e[-1] for e in ends], axis=0))
            if len(cut):  # all but the last block is whole
                table = pa.Table.from_batches(held)
                left = batch.num_rows - int(cut[-1]) - 1
                yield from of(table.slice(0, table.num_rows - left))
                held = [batch.slice(batch.num_rows - left)]
        if held:
            yield from of(pa.Table.from_batches(held))

    partitions = int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocked = dealt.repartition(partitions, "bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    found = stored(blocked.mapInArrow(pairs, "a bigint, b bigint").distinct(), "across")
    discard(mixed)
    return found


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Of pairs (a, b) of _ids, a table, those with 100 * |A and B| >= percent * |A or B| on the full sets: u, v.

    Sets and pairs meet in blocks of about BLOCK_SHINGLES a side, however long the sets
    are, or of one set that is longer; a set goes to a block once.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("_need")).distinct()
    total = ids.join(classes.select(F.col("rep").alias("_need"), "n"), "_need").agg(F.sum("n")).first()[0] or 0
    sides = max(1, -(-total // BLOCK_SHINGLES))
    held = _sets_of(ids, docs, size)
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(sides)).cast("int")
    asked = pairs.select("a", "b", spot("a").alias("x"), spot("b").alias("y"))
    places = asked.select("x", "y", F.explode(F.array("a", "b")).alias("_id")).distinct()
    dealt = places.join(held, "_id").select(F.col("x").alias("px"), F.col("y").alias("py"), "_id", "own")

    def confirm(asks: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        own = {i: np.frombuffer(s, dtype=np.uint64) for i, s in zip(known["_id"], known["own"], strict=True)}
        kept = []
        for a, b in zip(asks["a"], asks["b"], strict=True):
            s, t = sorted((own[a], own[b]), key=len)
            both = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum()) if len(t) else 0
            kept.append(100 * both >= percent * (len(s) + len(t) - both))
        out = asks[np.array(kept, dtype=bool)]
        return pd.DataFrame({"u": out["a"], "v": out["b"]})

    return asked.groupBy("x", "y").cogroup(dealt.groupBy("px", "py")).applyInPandas(confirm, "u bigint, v bigint")


def near_duplicate_classes(docs: DataFrame, shingle: int = 5, percent: int = 80, apart: bool = False) -> DataFrame:
    """Components of documents linked by 100 * |A and B| >= percent * |A or B| over their shingle sets.

    Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased; the set holds
    the distinct runs of `shingle` words, or the whole sequence where there are
    fewer words.

    Returns a row per row of docs: doc_id, n_shingles, component_id (the smallest
    doc_id reachable, itself included), kept (whether the row is the first document
    of its component), and _id, the document's number inside this operator.
    Documents without words or text have an empty set, are linked with nothing and
    are kept.  A null doc_id is smaller than all others, and component_id is null
    where such a document is the smallest.  Rows that repeat a doc_id and its text
    are one document; rows of one doc_id, or of none, with different texts are
    different documents, in an order by their texts' hashes, of which at most the
    first of a component is kept.  With apart, no doc_id but null has several
    texts, and none are looked for.  Other columns are not read.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100: bands are laid out for 80 and find less below")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = keyed.withColumn("_id", row_id()) if apart else told_apart(keyed)
    least = _least_estimate(percent / 100)
    members = stored(_sketched(keyed, shingle), "members")
    classes = stored(members.filter("n > 0").groupBy("h1", "h2").agg(F.min("_id").alias("rep"), F.min_by("doc_id", "_id").alias("lead"), F.max("n").alias("n"), F.max("sketch").alias("sketch")), "classes")
    bands = _bands(classes)
    leads = bands.groupBy("bucket").agg(F.min("rep").alias("l1"), F.min_by("rep", F.xxhash64("rep")).alias("l2"), F.count("*").alias("rows")).filter("rows > 1").drop("rows")
    shared = stored(bands.join(leads, "bucket"), "shared")
    stars = shared.select(F.col("rep").alias("a"), F.explode(F.array("l1", "l2")).alias("b")).filter("a <> b").distinct()
    order = Window.partitionBy("a").orderBy(F.desc("j"), "b")
    best = _estimated(stars, classes, least).withColumn("at", F.row_number().over(order)).filter(F.col("at") <= BEST).select("a", "b")
    best = stored(best, "best")
    links = stored(_verified(best, classes, keyed, shingle, percent), "links")
    first = connected_components(links).select(F.col("vertex").alias("rep"), "component")
    roots = first.select(F.col("component").alias("rep"), "component").distinct()
    placed = stored(first.union(roots), "placed")
    more = _across(shared.select("bucket", "rep"), classes, placed, keyed, shingle, percent, least)
    discard(best, shared, placed)
    late = stored(_verified(more, classes, keyed, shingle, percent), "late")
    final = connected_components(links.union(late)).select(F.col("vertex").alias("rep"), "component")
    discard(more, links, late)
    leads = classes.select(F.col("rep").alias("component"), F.col("lead").alias("first"))
    named = classes.select("rep", "h1", "h2", "lead").join(final.join(leads, "component"), "rep", "left")
    own = F.col("component").isNull()
    labels = named.select("h1", "h2", F.coalesce("component", "rep").alias("_component"), F.when(own, F.col("lead")).otherwise(F.col("first")).alias("first"))
    told = members.join(labels, ["h1", "h2"], "left")
    empty = F.col("n") == 0
    return told.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("first")).alias("component_id"),
        (empty | (F.col("_component") == F.col("_id"))).alias("kept"),
        "_id",
    )
