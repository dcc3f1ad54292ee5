"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of `PASSAGE_WORDS` words.  Each is encoded by a
learned layer over its byte histogram and a few word statistics; gated attention
(a tanh layer times a sigmoid layer) weighs the passages, and the weighted sum is
classified.  Encoder, attention and classifier are trained together from document
labels alone.

Learning takes a bounded sample (`train_docs` documents, `train_passages` passages),
chosen by a hash of the id; it runs in one executor task, and only the model comes to
the driver.  Every passage of every text is scored.
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
from lodestone.llm.textops import NON_SPACE, blocks, words_of
from lodestone.llm.toxicity import labelled_sample

PASSAGE_WORDS = 64
FEATURES = 256 + 3
HIDDEN, GATE = 24, 12


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    u: np.ndarray
    a: np.ndarray
    c: np.ndarray
    d: np.ndarray


def passages(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages, and where each text's begin (one more than texts)."""
    words = words_of([t or b"" for t in texts], NON_SPACE)
    counts = -(-np.diff(words.lo) // PASSAGE_WORDS)
    begin = np.concatenate([[0], np.cumsum(counts)])
    total = int(begin[-1])
    if not total:
        return np.zeros((0, FEATURES), dtype=np.float32), begin
    text = np.repeat(np.arange(len(texts)), counts)
    first = words.lo[text] + (np.arange(total) - begin[text]) * PASSAGE_WORDS
    last = np.minimum(first + PASSAGE_WORDS, words.lo[text + 1])
    lo, hi = words.start[first], words.end[last - 1]
    buffer = np.frombuffer(words.data, dtype=np.uint8)
    inside = np.zeros(len(buffer) + 1, dtype=np.int32)
    inside[lo] += 1
    inside[hi] -= 1
    covered = np.cumsum(inside[:-1]).astype(bool)
    owner = np.repeat(np.arange(total), hi - lo)
    histogram = np.bincount(owner * 256 + buffer[covered], minlength=total * 256).reshape(total, 256)
    n = last - first
    lengths = words.end - words.start
    mean_length = np.add.reduceat(lengths, first) / n
    of_word = np.repeat(np.arange(total), n)
    order = np.lexsort((words.hash, of_word))
    repeat = (words.hash[order][1:] == words.hash[order][:-1]) & (of_word[order][1:] == of_word[order][:-1])
    repeats = np.bincount(of_word[order][1:][repeat], minlength=total) / n
    rows = np.empty((total, FEATURES), dtype=np.float32)
    rows[:, :256] = np.sqrt(histogram / (hi - lo)[:, None])
    rows[:, 256] = np.log(mean_length)
    rows[:, 257] = repeats
    rows[:, 258] = n / PASSAGE_WORDS
    return rows, begin


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _forward(m: Model, rows: np.ndarray, begin: np.ndarray) -> tuple:
    """Probabilities of bags that all have passages, and what the gradient needs."""
    x = (rows - m.mean) / m.scale
    h = np.tanh(x @ m.w + m.b)
    t, s = np.tanh(h @ m.v), _sigmoid(h @ m.u)
    e = (t * s) @ m.a
    size = np.diff(np.append(begin, len(rows)))
    weight = np.exp(e - np.repeat(np.maximum.reduceat(e, begin), size))
    weight /= np.repeat(np.add.reduceat(weight, begin), size)
    z = np.add.reduceat(weight[:, None] * h, begin, axis=0)
    return _sigmoid(z @ m.c + m.d[0]), x, h, t, s, weight, z, size


def fit(bags: list[np.ndarray], labels: np.ndarray, steps: int = 150, rate: float = 0.02, decay: float = 1e-3) -> Model:
    """Trains by Adam on whole bags; the result depends on nothing but the arguments."""
    rng = np.random.default_rng(11)
    rows = np.concatenate(bags)
    begin = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]])
    m = Model(
        rows.mean(axis=0), rows.std(axis=0) + 1e-2,
        (rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN))).astype(np.float32), np.zeros(HIDDEN, np.float32),
        rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)).astype(np.float32), rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)).astype(np.float32),
        rng.normal(0, GATE**-0.5, GATE).astype(np.float32), rng.normal(0, HIDDEN**-0.5, HIDDEN).astype(np.float32), np.zeros(1, np.float32),
    )
    first, second = [np.zeros_like(p) for p in m[2:]], [np.zeros_like(p) for p in m[2:]]
    for step in range(1, steps + 1):
        p, x, h, t, s, weight, z, size = _forward(m, rows, begin)
        dlogit = ((p - labels) / len(labels)).astype(np.float32)
        dz = np.repeat(dlogit[:, None] * m.c, size, axis=0)
        dweight = (dz * h).sum(axis=1)
        de = weight * (dweight - np.repeat(np.add.reduceat(weight * dweight, begin), size))
        dt, ds = de[:, None] * m.a * s * (1 - t * t), de[:, None] * m.a * t * s * (1 - s)
        dh = (weight[:, None] * dz + dt @ m.v.T + ds @ m.u.T) * (1 - h * h)
        grads = [x.T @ dh + decay * m.w, dh.sum(axis=0), h.T @ dt, h.T @ ds, (t * s).T @ de, z.T @ dlogit + decay * m.c, np.array([dlogit.sum()])]
        new = []
        for i, (param, g) in enumerate(zip(m[2:], grads, strict=True)):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            new.append((param - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)).astype(np.float32))
        m = Model(m.mean, m.scale, *new)
    return m


def train_quality(docs: DataFrame, labels: DataFrame, train_docs: int = 3000, train_passages: int = 1 << 16) -> Model | None:
    """Fits the model on at most about train_docs of the docs that labels.quality marks; None without usable labels.

    Documents are taken in an order by a hash of their passages; one that would bring them
    above train_passages in all (1 KB each while learning) is passed over.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            rows, begin = passages(texts)
            own = [rows[a:b].astype(np.float16).tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), batch.column("label")], ["bag", "label"])

    def learn(batches: Iterator[pa.RecordBatch]) -> bytes | None:
        bags, labels_, left = [], [], train_passages
        for batch in batches:
            for bag, label in zip(batch.column("bag"), batch.column("label").to_pylist(), strict=True):
                own = np.frombuffer(bag.as_buffer(), dtype=np.float16).reshape(-1, FEATURES)
                if len(own) > left:
                    continue
                left -= len(own)
                bags.append(own.astype(np.float32))
                labels_.append(label > 0)
        return pickle.dumps(fit(bags, np.array(labels_, dtype=np.float32))) if bags else None

    sample = labelled_sample(docs, labels, "quality", train_docs).mapInArrow(encode, "bag binary, label int").filter(F.length("bag") > 0)
    model = fitted(sample.withColumn("at", F.xxhash64("bag")), ["at", "bag", "label"], learn)
    return pickle.loads(model) if model else None


def score_quality(docs: DataFrame, model: Model | None) -> DataFrame:
    """Adds `_score` (0 to 1, higher: label 1 likelier) to every row of docs, from its whole text.

    Null texts and texts without words have no passages; theirs is the classifier's
    value for an empty representation, and 0.5 for all texts without a model.
    Equal texts get equal scores; other columns pass through, but for an input
    column `_score`, which is overwritten.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.withColumn("_score", F.lit(0.0)).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch, texts in blocks(batches):
            scores = np.full(len(texts), 0.5 if m is None else float(_sigmoid(m.d[0])))
            if m is not None:
                rows, begin = passages(texts)
                full = np.flatnonzero(np.diff(begin))
                if len(full):
                    scores[full] = _forward(m, rows, begin[full])[0]
            columns = {n: batch.column(n) for n in batch.schema.names} | {"_score": pa.array(scores, pa.float64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.mapInArrow(score, schema)
