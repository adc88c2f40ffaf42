"""Packing as vector bin packing with the dot-product heuristic.

An example has a demand vector: tokens, one segment, loss-bearing tokens. A
sequence (bin) has a capacity in each. While a sequence is open, the next piece
is the example that fits in every dimension and whose demand has the largest dot
product with the room left, each dimension scaled by its capacity. ``pack``
keeps examples whole. ``pack_documents`` may cut them: a document of more than a
sequence gives full sequences first; when nothing fits whole, a piece is cut to
the room left, so a sequence closes exactly full: the one with the largest product
among documents that are cut already, else among all. The last segment that a
sequence may hold must fill it, so a sequence runs out of segments and of tokens
together. Where no document is long enough for that, and at the end of a
partition, a sequence is cut into ones whose lengths are powers of two, which need
no padding.

A piece's loss-bearing tokens are all but its first, which nothing stands before.

Everything is done within a partition, in groups of bounded size, with the open
sequence carried from group to group; no shuffle, and a lost task is repeated
with the same result because ids depend only on the partition and its rows.
Sequence ids are partition * 2**40 + a running number.

Defined cases: a null text counts as empty and gives the end mark alone; null or
repeated ids give pieces like any others; equal products go to the first example;
an example above a capacity is returned alone with ``sequence_id`` null by
``pack``; long texts are read whole and cut; empty tables give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldgrid.llm.tokens import ByteBpe, count_tokens, default_vocabulary

LENGTH = 2048
END = 1
GROUP = 2048


@dataclass(frozen=True)
class Capacity:
    tokens: int = LENGTH
    segments: int = 8
    loss: int = LENGTH - 1

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss], dtype=np.float64)


def best_fit(demands: np.ndarray, open_: np.ndarray, room: np.ndarray, scale: np.ndarray) -> int:
    """Index of the fitting example with the largest dot product with the room left, or -1. Ties: the first."""
    fits = open_ & (demands <= room).all(axis=1)
    if not fits.any():
        return -1
    score = (demands / scale) @ (room / scale)
    score[~fits] = -1.0
    return int(score.argmax())


def pack_whole(demands: np.ndarray, capacity: Capacity) -> list[list[int]]:
    """Bins of example numbers, none of them cut. Examples above a capacity stay out."""
    scale = capacity.vector()
    left = (demands <= scale).all(axis=1)
    bins = []
    while left.any():
        room, bin_ = scale.copy(), []
        while (i := best_fit(demands, left, room, scale)) >= 0:
            bin_.append(i)
            left[i] = False
            room -= demands[i]
        bins.append(bin_)
    return bins


class _Packer:
    """Cuts and places the pieces of one partition. A piece: (document number, start, length)."""

    def __init__(self, base: int, capacity: Capacity):
        self.capacity, self.next, self.out = capacity, base, []
        self.scale = capacity.vector()
        self.size = min(capacity.tokens, capacity.loss + 1)  # what one document may fill
        self._open()

    def _open(self) -> None:
        self.open: list[tuple] = []
        self.room = self.scale.copy()

    def _emit(self, pieces: list[tuple]) -> None:
        at = 0
        for piece in pieces:
            self.out.append((*piece, self.next, at, len(pieces)))
            at += piece[2]
        self.next += 1

    def _place(self, doc, start: int, length: int) -> None:
        self.open.append((doc, start, length))
        self.room -= (length, 1, length - 1)
        if self.room[0] <= 0:
            self._emit(self.open)
            self._open()
        elif self.room.min() <= 0:
            self.finish()

    def add(self, docs: list[tuple[object, int]]) -> None:
        """docs: (document, tokens). All but a sequence's worth at most is placed."""
        docs_left, starts, lengths = [], [], []
        for doc, n in docs:
            full = n // self.size
            for k in range(full):
                self._emit([(doc, k * self.size, self.size)])
            if rest := n - full * self.size:
                docs_left.append(doc)
                starts.append(full * self.size)
                lengths.append(rest)
        for at in range(0, len(docs_left), GROUP):
            self._group(docs_left[at : at + GROUP], starts[at : at + GROUP], np.array(lengths[at : at + GROUP], dtype=np.float64))

    def _group(self, docs: list, starts: list[int], lengths: np.ndarray) -> None:
        demands = np.stack([lengths, np.ones_like(lengths), lengths - 1], axis=1)
        left, cut = np.ones(len(docs), dtype=bool), np.array(starts) > 0
        while left.any():
            room = int(min(self.room[0], self.room[2] + 1))
            last = self.room[1] == 1  # this segment must fill the sequence, if any document can
            able = left & (demands[:, 0] >= room) if last else left
            whole = able & (demands[:, 0] == room) if last and able.any() else left
            i = best_fit(demands, whole, self.room, self.scale)
            if i >= 0:
                left[i] = False
                self._place(docs[i], starts[i], int(demands[i, 0]))
                continue
            # nothing fits whole: a piece is cut to the room left, of a document that is cut already if there is one
            able = able if able.any() else left
            able = able & cut if (able & cut).any() else able
            score = np.where(able, demands @ (self.room / self.scale / self.scale), -1.0)
            i = int(score.argmax())
            doc, start = docs[i], starts[i]
            starts[i] += room
            demands[i] -= (room, 0, room)
            cut[i] = True
            self._place(doc, start, room)

    def finish(self) -> None:
        """Cut the open sequence into sequences whose lengths are powers of two, longest first."""
        pieces = self.open
        self._open()
        total = sum(p[2] for p in pieces)
        sizes = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
        for size in sizes:
            at, own = 0, []
            while at < size:
                doc, start, n = pieces.pop(0)
                take = min(n, size - at)
                if take < n:
                    pieces.insert(0, (doc, start + take, n - take))
                own.append((doc, start, take))
                at += take
            self._emit(own)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, segments long, loss_tokens long"
ARROW = pa.schema([(f.split()[0], pa.int64()) for f in SCHEMA.split(", ")])


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: Capacity = Capacity()) -> DataFrame:
    """Pieces of all documents(doc_id, text), packed without padding. ``segments`` counts the pieces of the sequence."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe = ByteBpe.of(path)
        packer = _Packer(TaskContext.get().partitionId() << 40, capacity)
        ids: dict[int, np.ndarray] = {}  # ids of documents with pieces that aren't out yet
        names: dict[int, object] = {}
        count = 0

        def drain() -> Iterator[pa.RecordBatch]:
            rows = []
            for doc, start, n, sequence, at, segments in packer.out:
                part = ids[doc][start : start + n]
                rows.append((names[doc], start, n, zlib.crc32(part.tobytes()), len(ids[doc]), sequence, at, segments, n - 1))
            packer.out.clear()
            held = {p[0] for p in packer.open}
            for doc in [d for d in ids if d not in held]:
                del ids[doc], names[doc]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=ARROW)

        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                part, new = batch.slice(at, GROUP), []
                for name, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids[count] = np.array([*bpe.encode(text or ""), END], dtype="<u4")
                    names[count] = name
                    new.append((count, len(ids[count])))
                    count += 1
                packer.add(new)
                yield from drain()
        packer.finish()
        yield from drain()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def pack(examples: DataFrame, capacity: Capacity = Capacity()) -> DataFrame:
    """examples(id, tokens, loss_tokens) -> id, sequence_id, place: whole examples under all three limits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                part = batch.slice(at, GROUP)
                tokens, loss = (np.array([x or 0 for x in part.column(c).to_pylist()], dtype=np.float64) for c in (1, 2))
                bins = pack_whole(np.stack([tokens, np.ones_like(tokens), loss], axis=1), capacity)
                placed = {i: (number + b, k) for b, bin_ in enumerate(bins) for k, i in enumerate(bin_)}
                number += len(bins)
                names = part.column(0).to_pylist()
                each = [(names[i], *placed.get(i, (None, None))) for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*each, strict=True)], names=["id", "sequence_id", "place"])

    return examples.select(F.col("id").cast("long"), F.col("tokens").cast("long"), F.col("loss_tokens").cast("long")).mapInArrow(run, "id long, sequence_id long, place long")


def instruction_examples(conversations: DataFrame, vocabulary: str | None = None, answers: str = "assistant") -> DataFrame:
    """conversations(conv_id, role, text) -> id, tokens, loss_tokens: a conversation's turns with an end mark each; the
    answers bear loss. Turns are summed where they are before anything moves; a null id is a conversation of its own."""
    n = (count_tokens(F.col("text").cast("string"), vocabulary) + 1).alias("n")
    turns = conversations.select(F.col("conv_id").cast("long").alias("id"), F.col("role"), n)
    return turns.groupBy("id").agg(F.sum("n").alias("tokens"), F.sum(F.when(F.col("role") == answers, F.col("n")).otherwise(F.lit(0))).alias("loss_tokens"))
