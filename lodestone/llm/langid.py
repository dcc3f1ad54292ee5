"""Language identification with bit-sliced Bloom filters over byte n-grams.

A slot of the filter holds one bit for each language; the conjunction of an
n-gram's slots is a bitmask of all languages that contain it.  A text's n-grams
are looked up at once, bits are counted per language, the counts are corrected
for the filters' false positives, and the largest decides.

An n-gram belongs to a language's filter if its share there is at least
`kinship` of its largest share in any language, so that passages in another
language inside labelled texts don't fill every filter.

Learning takes a bounded sample of labelled texts for each language
(`train_docs`), chosen by a hash of a column; every whole text is predicted.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.textops import blocks

GRAM = 4
SLOT_BITS = 20
UNKNOWN = "und"
#: The filters of 64 languages are 8 MiB, so this bounds what is broadcast to 64 MiB.
MOST_LANGUAGES = 512

#: Bytes as the n-grams see them: letters in lower case, other ASCII as a space.
_FOLD = np.full(256, 0x20, dtype=np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


class Filters(NamedTuple):
    languages: list[str]
    #: Bitmasks of languages by slot, one for each 64 languages.
    masks: np.ndarray

    def false_positives(self) -> np.ndarray:
        """For each language, how likely an n-gram that isn't in its filter seems to be."""
        fill = [((self.masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(self.languages))]
        return np.minimum(np.array(fill) ** 2, 0.999)


def _grams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram as an integer, text) for all n-grams of letters and single spaces between them."""
    data = b"".join(b" " + (t or b"") + b" " for t in texts)
    lengths = np.fromiter((len(t or b"") + 2 for t in texts), dtype=np.int64, count=len(texts))
    folded = _FOLD[np.frombuffer(data, dtype=np.uint8)]
    text = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    space = folded == 0x20
    kept = np.ones(len(space), dtype=bool)
    kept[1:] = ~(space[1:] & space[:-1] & (text[1:] == text[:-1]))  # a text's runs of spaces count as one
    folded, text = folded[kept].astype(np.uint32), text[kept]
    n = len(folded) - GRAM + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int32)
    gram = np.zeros(n, dtype=np.uint32)
    for i in range(GRAM):
        gram = gram << np.uint32(8) | folded[i : i + n]
    one = text[:n] == text[GRAM - 1 :]
    return gram[one], text[:n][one]


def _slots(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint32(32 - SLOT_BITS)
    return (gram * np.uint32(0x9E3779B1)) >> shift, ((gram ^ gram >> np.uint32(15)) * np.uint32(0x85EBCA77)) >> shift


def _empty(languages: int) -> np.ndarray:
    return np.zeros((-(-languages // 64), 1 << SLOT_BITS), dtype=np.uint64)


def build_filters(grams: dict[str, tuple[np.ndarray, np.ndarray]], kinship: float, least: int) -> Filters:
    """Filters from each language's distinct n-grams and their counts."""
    languages = sorted(grams)
    every = np.unique(np.concatenate([grams[x][0] for x in languages])) if languages else np.zeros(0, dtype=np.uint32)
    share = np.zeros((len(languages), len(every)))
    count = np.zeros((len(languages), len(every)), dtype=np.int64)
    for i, x in enumerate(languages):
        at = np.searchsorted(every, grams[x][0])
        count[i, at] = grams[x][1]
        share[i, at] = grams[x][1] / max(1, grams[x][1].sum())
    masks = _empty(len(languages))
    for i in range(len(languages)):
        own = every[(count[i] >= least) & (share[i] >= kinship * share.max(axis=0))]
        for slot in _slots(own):
            masks[i // 64, slot] |= np.uint64(1 << i % 64)
    return Filters(languages, masks)


def train_languages(docs: DataFrame, train_docs: int = 1500, kinship: float = 0.4, least: int = 2, sample_by: str = "text") -> Filters:
    """Learns filters from docs with text and lang, at most about train_docs of each language.

    A hash of the column sample_by, best an id, chooses them.
    Counts of n-grams, not texts, come to the driver; there are few of them, as
    n-grams are four bytes long.  Up to MOST_LANGUAGES; rows with null text or lang are left out.
    """
    known = docs.select("text", "lang", F.xxhash64(sample_by).alias("_hash")).filter("text is not null and lang is not null")
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().orderBy("lang").limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return Filters([], _empty(0))
    cut = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(int(min(1.0, train_docs / n) * (1 << 30))))])
    taken = known.filter(F.pmod("_hash", F.lit(1 << 30)) < cut[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            gram, text = _grams(texts)
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for lang in sorted(set(langs.tolist())):
                own, n = np.unique(gram[(langs == lang)[text]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own.astype(np.int64)), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    grams: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    table = taken.select("text", "lang").mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).toPandas()
    for lang, own in table.sort_values("gram").groupby("lang"):
        grams[str(lang)] = own["gram"].to_numpy().astype(np.uint32), own["n"].to_numpy()
    return build_filters(grams, kinship, least)


def predict_languages(docs: DataFrame, filters: Filters) -> DataFrame:
    """Adds `_lang` and `_lang_score` (0 to 1) to every row of docs, from its whole text.

    `und` with score 0 if the text is null, has no letter, or nothing was learned.
    Ties go to the language that sorts first.  Other columns pass through, but for
    input columns `_lang` and `_lang_score`, which are overwritten.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    schema = docs.withColumns({"_lang": F.lit(""), "_lang_score": F.lit(0.0)}).schema

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, masks = shared.value
        wrong = shared.value.false_positives()
        for batch, texts in blocks(batches):
            gram, text = _grams(texts)
            first, second = _slots(gram)
            held = [m[first] & m[second] for m in masks]
            total = np.bincount(text, minlength=len(texts))
            hits = np.stack([np.bincount(text, weights=(held[i // 64] >> np.uint64(i % 64)) & np.uint64(1), minlength=len(texts)) for i in range(len(languages))], axis=1) if languages else np.zeros((len(texts), 0))
            likely = np.maximum((hits - total[:, None] * wrong) / (1 - wrong), 0.0)
            langs, scores = [], []
            for i, t in enumerate(texts):
                if t is None or not languages or not any(map(str.isalpha, t.decode())):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                else:
                    best = int(likely[i].argmax())
                    langs.append(languages[best])
                    scores.append(float(likely[i, best] / likely[i].sum()) if likely[i, best] > 0 else 1 / len(languages))
            columns = {n: batch.column(n) for n in batch.schema.names} | {"_lang": pa.array(langs, pa.string()), "_lang_score": pa.array(scores, pa.float64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.mapInArrow(predict, schema)
