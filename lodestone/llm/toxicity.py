"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the distinct hashes of its words, of their first 4, 6
and 8 bytes (so that inflected forms share features), of pairs of neighbouring
words and of pairs with one word between; a hash that occurs twice, and one that
occurs three times or more, is a further feature each, so that repeated use counts.  Weights are learned one example at a time
with per-coordinate rates; L1 keeps most of them at exactly zero, so the model is
a short list of slots and weights that is broadcast to the scoring tasks.

Learning takes a bounded sample (`train_docs` documents and `train_features` features
at most, as the parameters say), chosen by a hash of the id; it runs in one executor
task, and only the weights come to the driver.  Scoring reads every whole text.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import fitted
from lodestone.llm.textops import ALNUM, blocks, mix64, words_of

SLOT_BITS = 20
#: A slot's feature for at least n occurrences is number slot + (n - 1) * 2**SLOT_BITS.
LEVELS = 3
SIZE = LEVELS << SLOT_BITS
STEMS = (4, 6, 8)
_KINDS = np.array([0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x9B05688C2B3E6C1F, 0x510E527FADE682D1], dtype=np.uint64)


class Model(NamedTuple):
    bias: float
    slots: np.ndarray
    weights: np.ndarray

    def table(self) -> np.ndarray:
        out = np.zeros(SIZE, dtype=np.float32)
        out[self.slots] = self.weights
        return out


def features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of each n-gram occurrence, in no order."""
    words = words_of([(t or b"").lower() for t in texts], ALNUM, stems=STEMS)
    text, h = words.text_of(), words.hash
    parts = [(text, mix64(h + _KINDS[0]))]
    for n, stem in zip(STEMS, words.stems, strict=True):
        parts.append((text, mix64(stem + _KINDS[3] + np.uint64(n))))
    for kind, gap in ((1, 1), (2, 2)):
        if len(h) > gap:
            same = text[gap:] == text[:-gap]
            parts.append((text[gap:][same], mix64(h[:-gap] * np.uint64(0xD6E8FEB86659FD93) + h[gap:] + _KINDS[kind])[same]))
    return np.concatenate([p[0] for p in parts]), (np.concatenate([p[1] for p in parts]) >> np.uint64(64 - SLOT_BITS)).astype(np.int32)


def leveled(slots: np.ndarray) -> np.ndarray:
    """A text's features from the slots of its n-gram occurrences."""
    own, n = np.unique(slots, return_counts=True)
    return np.concatenate([own[n > i] + (i << SLOT_BITS) for i in range(LEVELS)]).astype(np.int32)


def ftrl(examples: list[tuple[np.ndarray, int]], alpha: float, beta: float, l1: float, l2: float, epochs: int) -> Model:
    """Learns from (features, label)."""
    z, n = np.zeros(SIZE), np.zeros(SIZE)
    bias_z = bias_n = 0.0
    order = np.random.default_rng(7)

    def weight(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for i in order.permutation(len(examples)).tolist():
            slots, label = examples[i]
            w = weight(z[slots], n[slots])
            bias = -bias_z / ((beta + np.sqrt(bias_n)) / alpha + l2)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35)))
            g = p - label
            own = n[slots]
            z[slots] += g - (np.sqrt(own + g * g) - np.sqrt(own)) / alpha * w
            n[slots] = own + g * g
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / alpha * bias
            bias_n += g * g
    kept = np.flatnonzero(np.abs(z) > l1)
    return Model(float(-bias_z / ((beta + np.sqrt(bias_n)) / alpha + l2)), kept.astype(np.int32), weight(z[kept], n[kept]).astype(np.float32))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """text and label of at most about `most` labelled documents, chosen by a hash of the id.

    The share to take comes from a count, so no text is shuffled that isn't taken,
    and a text that very many documents hold is taken in proportion.
    Null labels and null texts are left out; a document labelled twice differently counts twice.
    """
    known = labels.select(F.col("doc_id").alias("_labelled"), F.col(label).cast("int").alias("label")).filter("label is not null and _labelled is not null").distinct()
    share = min(1.0, most / max(1, known.count()))
    taken = docs.select("doc_id", "text").filter(F.col("text").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))))
    return taken.join(known, taken["doc_id"] == known["_labelled"]).select("text", "label")


def train_toxicity(docs: DataFrame, labels: DataFrame, train_docs: int = 8000, train_features: int = 1 << 25, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.1, epochs: int = 6) -> Model:
    """Fits the model on at most about train_docs of the docs that labels.toxic marks.

    Documents are taken in an order by a hash of their features; one that would bring them
    above train_features in all, 4 bytes each, is passed over.  Without usable labels
    the model gives 0.5 everywhere.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            text, slot = features(texts)
            slot = slot[np.argsort(text, kind="stable")]
            end = np.cumsum(np.bincount(text, minlength=len(texts)))
            rows = [leveled(own).tobytes() for own in np.split(slot, end[:-1])]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column("label")], ["slots", "label"])

    def learn(batches: Iterator[pa.RecordBatch]) -> bytes | None:
        examples, left = [], train_features
        for batch in batches:
            for slots, label in zip(batch.column("slots"), batch.column("label").to_pylist(), strict=True):
                own = np.frombuffer(slots.as_buffer(), dtype=np.int32)
                if len(own) > left:
                    continue
                left -= len(own)
                examples.append((own, int(label > 0)))
        return pickle.dumps(ftrl(examples, alpha, beta, l1, l2, epochs)) if examples else None

    sample = labelled_sample(docs, labels, "toxic", train_docs).mapInArrow(encode, "slots binary, label int").withColumn("at", F.xxhash64("slots"))
    model = fitted(sample, ["at", "slots", "label"], learn)
    return pickle.loads(model) if model else ftrl([], alpha, beta, l1, l2, epochs)


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """Adds `_score` (0 to 1, higher: toxicity likelier) to every row of docs.

    Whole texts are scored.  Null and empty texts have no features, so theirs is
    the bias alone.  Equal texts get equal scores; other columns pass through, but for an input
    column `_score`, which is overwritten.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.withColumn("_score", F.lit(0.0)).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, table = shared.value.bias, shared.value.table()
        used = table.reshape(LEVELS, -1).any(axis=0)
        for batch, texts in blocks(batches):
            text, slot = features(texts)
            heavy = np.flatnonzero(used[slot])
            own, n = np.unique(text[heavy].astype(np.int64) << SLOT_BITS | slot[heavy], return_counts=True)
            weights = sum(np.where(n > i, table[(own & ((1 << SLOT_BITS) - 1)) + (i << SLOT_BITS)], 0) for i in range(LEVELS))
            total = bias + np.bincount(own >> SLOT_BITS, weights=weights, minlength=len(texts))
            scores = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            columns = {n: batch.column(n) for n in batch.schema.names} | {"_score": pa.array(scores, pa.float64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.mapInArrow(score, schema)
