"""Packing token ids into sequences: vector bin packing with the dot-product heuristic.

Each task packs its own documents into sequences under simultaneous limits on
tokens, segments and loss-bearing tokens.  It keeps a bounded number of open
sequences; a piece goes to the one whose remaining room has the largest dot
product with the piece's needs (both as shares of the limits) among those that
can hold it.  If none can and no more may be opened, the fullest is filled up
with the front of the piece and closed, so closed sequences are full unless
their segment or loss limit is reached.  What is still open at the end of a task
is filled from one another in the same way, and the last partial sequence is cut
into lengths of powers of two, which need no padding.

No document meets another task's documents, so nothing is shuffled, and a task
holds no more than its open sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lodestone.llm.tokens import added_tokens, token_ids

__all__ = ["Limits", "Packer", "Piece", "added_tokens", "pack_sequences", "powers_of_two"]


class Limits(NamedTuple):
    tokens: int = 1024
    segments: int = 256
    loss_tokens: int = 1024


class Piece(NamedTuple):
    doc: int
    start: int
    length: int
    #: Running sums of loss-bearing tokens over the document's ids, None if all bear loss.
    loss: np.ndarray | None

    def bearing(self) -> int:
        return self.length if self.loss is None else int(self.loss[self.start + self.length] - self.loss[self.start])

    def front(self, tokens: int, bearing: int) -> int:
        """How many ids of the piece fit into the room."""
        n = min(tokens, self.length)
        if self.loss is None:
            return min(n, bearing)
        return int(min(n, np.searchsorted(self.loss[self.start : self.start + n + 1], self.loss[self.start] + bearing, side="right") - 1))

    def split(self, n: int) -> tuple[Piece, Piece]:
        return self._replace(length=n), self._replace(start=self.start + n, length=self.length - n)


class Packer:
    """Packs pieces into sequences; put() and finish() yield closed sequences as lists of pieces."""

    def __init__(self, limits: Limits, open_most: int = 64) -> None:
        self.limits = limits
        self.most = open_most
        self.open: list[list[Piece]] = []
        self.room = np.zeros((0, 3))
        self.whole = np.array(limits, dtype=float)

    def put(self, piece: Piece) -> Iterator[list[Piece]]:
        while piece.length:
            if len(self.open) < self.most and (n := piece.front(self.limits.tokens, self.limits.loss_tokens)) < piece.length:
                own, piece = piece.split(n)  # longer than a sequence: its front makes one of its own
                yield [own]
                continue
            needs = np.array([piece.length, 1, piece.bearing()], dtype=float)
            fits = (self.room >= needs).all(axis=1)
            if fits.any():
                value = np.where(fits, (self.room / self.whole) @ (needs / self.whole), -1)
                self._add(int(value.argmax()), piece, needs)
                return
            if len(self.open) < self.most:
                self.open.append([])
                self.room = np.vstack([self.room, self.whole])
                self._add(len(self.open) - 1, piece, needs)
                return
            at = int(self.room[:, 0].argmin())
            n = piece.front(int(self.room[at, 0]), int(self.room[at, 2])) if self.room[at, 1] >= 1 else 0
            if n:
                own, piece = piece.split(n)
                self.open[at].append(own)
            yield self.open.pop(at)
            self.room = np.delete(self.room, at, axis=0)

    def _add(self, at: int, piece: Piece, needs: np.ndarray) -> None:
        self.open[at].append(piece)
        self.room[at] -= needs

    def finish(self) -> Iterator[list[Piece]]:
        """Closes everything: the emptiest sequences fill the others, and the rest is cut at powers of two."""
        order = np.argsort(self.room[:, 0])
        rest = [p for i in order[1:][::-1] for p in self.open[i]] if len(order) else []
        kept = self.open[order[0]] if len(order) else []
        self.open, self.room, self.most = ([kept], self.room[order[:1]], 1) if kept else ([], np.zeros((0, 3)), 1)
        for piece in rest:
            yield from self.put(piece)
        for last in self.open:
            yield from powers_of_two(last)
        self.open, self.room = [], np.zeros((0, 3))


def powers_of_two(pieces: list[Piece]) -> Iterator[list[Piece]]:
    """A partial sequence as sequences whose lengths are powers of two."""
    left = list(pieces)
    total = sum(p.length for p in left)
    while total:
        size = 1 << (total.bit_length() - 1)
        total -= size
        own: list[Piece] = []
        while size:
            n = min(size, left[0].length)
            front, back = left[0].split(n)
            own.append(front)
            left = [back, *left[1:]] if back.length else left[1:]
            size -= n
        yield own


OUT = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_NAMES = [x.split()[0] for x in OUT.split(", ")]


def pack_sequences(docs: DataFrame, ranks_path: str, pattern: str, limits: Limits = Limits(), open_most: int = 64, with_ids: bool = False, loss_mask: str | None = None, special_tokens: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """Packs the token ids of docs, each document's followed by id 0, into sequences.

    `ranks_path` names a byte-level BPE's ranks (base64 token and rank a line) and
    `pattern` its pre-token pattern; every executor has the file at that path.
    `loss_mask` names a column array<boolean> that tells which ids bear loss (by
    position; positions beyond its end bear loss); by default all do.
    `special_tokens` are strings with their ids that a text may hold as tokens
    (see added_tokens); by default such strings are ordinary text.

    Returns a row per piece: doc_id, start (its document's ids before it), length,
    ids_crc32 (of the ids as little-endian unsigned 32-bit integers), doc_tokens
    (with the id 0), sequence_id, offset (from 0, without gaps, in the sequence),
    and `ids` array<int> if with_ids.  Null and empty texts are the id 0 alone;
    runs of millions of blanks or newlines are encoded like any other text.
    Every row of docs is packed, rows that repeat a doc_id too; a null doc_id
    stays null.  Other columns are not read.
    """
    if min(limits) < 1:
        raise ValueError("limits must be positive")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_ids(ranks_path, pattern, special_tokens)
        packer, number = Packer(limits, open_most), TaskContext.get().partitionId() << 33
        held: dict[int, list] = {}  # documents with pieces in open sequences: doc_id, ids as bytes, tokens, tokens not yet written
        rows: list[tuple] = []

        def write(sequences: Iterator[list[Piece]]) -> None:
            nonlocal number
            for pieces in sequences:
                offset = 0
                for p in pieces:
                    own = held[p.doc]
                    ids = own[1][4 * p.start : 4 * (p.start + p.length)]
                    rows.append((own[0], p.start, p.length, zlib.crc32(ids), own[2], number, offset, *([np.frombuffer(ids, "<u4").astype(np.int32)] if with_ids else [])))
                    offset += p.length
                    own[3] -= p.length
                    if not own[3]:
                        del held[p.doc]
                number += 1

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:7]] + [pa.array(c, pa.list_(pa.int32())) for c in columns[7:]], _NAMES + ["ids"] * with_ids)

        count = 0
        for batch in batches:
            masks = batch.column("_mask").to_pylist() if loss_mask else [None] * batch.num_rows
            for doc_id, text, mask in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), masks, strict=True):
                ids = encode(text)
                n = len(ids)
                sums = None
                if mask is not None:
                    bears = np.array([bool(m) for m in mask[:n]] + [True] * (n - len(mask)), dtype=np.int64)
                    sums = np.concatenate([[0], np.cumsum(bears)])
                held[count] = [doc_id, np.array(ids, dtype="<u4").tobytes(), n, n]
                write(packer.put(Piece(count, 0, n, sums)))
                count += 1
                if len(rows) >= 4096:
                    yield out()
        write(packer.finish())
        if rows:
            yield out()

    columns = ["doc_id", "text"] if loss_mask is None else [docs["doc_id"], docs["text"], docs[loss_mask].alias("_mask")]
    return docs.select(*columns).mapInArrow(packed, OUT + ", ids array<int>" * with_ids)
