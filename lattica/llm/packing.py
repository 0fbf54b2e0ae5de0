"""Sequence packing: bounded-space online best-fit over token pieces.

One pass per partition holds a fixed number of open bins, found through a bitset keyed by free space: a piece goes to
the open bin that it leaves least space in; where none fits, a new bin opens, and if that is one too many, the fullest
closes. Pieces are looked at `window` at a time, the longest of them first. The pieces of the bins that are open at a
partition's end, unless almost full, are packed again in the same way for `merged` partitions together, so that what a small
partition leaves half empty doesn't stay so. Pieces never move between tasks before that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from .common import sliced, stored
from .tokens import encoder

CAPACITY, END_ID = 1024, 2
OPEN_BINS, WINDOW, MERGED = 1024, 2048, 16
#: A bin with at most this share free counts as full at a partition's end.
ALMOST = 1 / 32


class BestFit:
    """Open bins by free space. place() returns the item's bin and offset there, and the bins that closed."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.most = capacity, open_bins
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = self.count = self.made = 0

    def place(self, size: int) -> tuple[int, int, list[int]]:
        if not 0 < size <= self.capacity:
            raise ValueError(f"an item of {size} does not fit a bin of {self.capacity}")
        closed = []
        fitting = self.bits >> size
        if fitting:
            free = (fitting & -fitting).bit_length() - 1 + size
            number = self._take(free)
        else:
            if self.count == self.most:
                closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
            number, free = self.made, self.capacity
            self.made += 1
        left = free - size
        if left:
            self.at[left].append(number)
            self.bits |= 1 << left
            self.count += 1
        else:
            closed.append(number)
        return number, self.capacity - free, closed

    def _take(self, free: int) -> int:
        number = self.at[free].pop()
        if not self.at[free]:
            self.bits ^= 1 << free
        self.count -= 1
        return number


def _cut(path: str, pattern: str, capacity: int, end_id: int):
    """Batches of (doc_id, text) to batches of pieces."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, pattern).encode_all
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for part in sliced([batch], 1024):
                for doc, ids in zip(part.column(0).to_pylist(), encode(part.column(1)), strict=True):
                    ids += end
                    total = len(ids) // 4
                    start, piece = 0, 0
                    while start < total:
                        length = (total - start) % capacity or capacity if start == 0 else capacity
                        for column, x in zip(out, (doc, piece, start, length, ids[4 * start : 4 * (start + length)]), strict=True):
                            column.append(x)
                        start, piece = start + length, piece + 1
                if len(out[0]) >= 4096:
                    yield _pieces(out)
                    out = [[], [], [], [], []]
            if out[0]:
                yield _pieces(out)

    return run


PIECES = StructType([StructField("doc_id", LongType()), StructField("piece", IntegerType()), StructField("start", LongType()), StructField("length", LongType()), StructField("ids", BinaryType())])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def token_pieces(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids (binary, little-endian unsigned 32-bit) of each document's ids plus end_id.

    Only documents longer than the capacity are cut: all pieces but the first then have the capacity's length. Null text
    counts as empty and gives one piece, the end id. Rows with a null id stay; equal rows all stay.
    """
    return _texts(docs, id_col, text_col).mapInArrow(_cut(path, pattern, capacity, end_id), PIECES)


def _pieces(out: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids"])


def _pass(capacity: int, open_bins: int, window: int, length_col: str, last: bool):
    """Adds sequence_id and offset; but in the last pass rows of bins that stay open get nulls there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (1 << 62 if last else 0) | TaskContext.get().partitionId() << 32
        fit = BestFit(capacity, open_bins)
        #: By open bin: whether each row lies in this batch or among the rows kept of those before, its place there, its offset.
        held: dict[int, list[tuple[bool, int, int]]] = {}
        kept: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column(length_col).to_pylist()
            order = [i for at in range(0, len(sizes), window) for i in sorted(range(at, min(at + window, len(sizes))), key=lambda i: -sizes[i])]
            done: dict[bool, list[tuple[int, int, int]]] = {False: [], True: []}
            for i in order:
                number, offset, closed = fit.place(sizes[i])
                held.setdefault(number, []).append((True, i, offset))
                for n in closed:
                    for here, row, at in held.pop(n):
                        done[here].append((row, base + n, at))
            for source, rows in ((kept, done[False]), (batch, done[True])):
                if rows:
                    yield _placed(source.take(pa.array([r for r, _, _ in rows])), [n for _, n, _ in rows], [at for _, _, at in rows])
            # Only the open bins' rows are kept.
            places = {here: [row for rows in held.values() for h, row, _ in rows if h is here] for here in (False, True)}
            first = len(places[False])
            parts = [source.take(pa.array(places[here], pa.int64())) for here, source in ((False, kept), (True, batch)) if places[here]]
            kept = pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if parts else None
            old, new = iter(range(first)), iter(range(first, first + len(places[True])))
            held = {n: [(False, next(new) if here else next(old), at) for here, _, at in rows] for n, rows in held.items()}
        full = set(held) if last else {n for free in range(int(capacity * ALMOST) + 1) for n in fit.at[free]}
        for done_ in (True, False):
            rest = [(row, base + n, at) for n, rows in held.items() if (n in full) == done_ for _, row, at in rows]
            if rest:
                yield _placed(kept.take(pa.array([r for r, _, _ in rest])), [n for _, n, _ in rest] if done_ else None, [at for _, _, at in rest] if done_ else None)

    return run


def _placed(batch: pa.RecordBatch, ids: list[int] | None, offsets: list[int] | None) -> pa.RecordBatch:
    none = pa.nulls(batch.num_rows, pa.int64())
    return pa.RecordBatch.from_arrays([*batch.columns, none if ids is None else pa.array(ids, pa.int64()), none if offsets is None else pa.array(offsets, pa.int64())], [*batch.schema.names, "sequence_id", "offset"])


def _placed_schema(rows: StructType) -> StructType:
    return StructType([*rows.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])


def _finish(first: DataFrame, length_col: str, capacity: int, open_bins: int, window: int, merged: int) -> DataFrame:
    first = stored(first, "snappy")
    left = first.where("sequence_id is null").drop("sequence_id", "offset")
    tasks = max(1, -(-left.rdd.getNumPartitions() // merged))
    return first.where("sequence_id is not null").unionAll(left.coalesce(tasks).mapInArrow(_pass(capacity, open_bins, window, length_col, True), first.schema))


def pack(pieces: DataFrame, length_col: str = "length", capacity: int = CAPACITY, open_bins: int = OPEN_BINS, window: int = WINDOW, merged: int = MERGED) -> DataFrame:
    """Add sequence_id and offset to each row: rows of one sequence_id lie gapless from 0 and fill at most the capacity.

    Every row is placed once, with all its columns (an existing sequence_id or offset is replaced). Lengths must lie
    between 1 and the capacity, else the job fails; null lengths fail too. Memory per task is bounded by its open bins
    and one batch. An empty table gives no rows. Which ids are given is arbitrary.
    """
    pieces = pieces.drop("sequence_id", "offset")
    return _finish(pieces.mapInArrow(_pass(capacity, open_bins, window, length_col, False), _placed_schema(pieces.schema)), length_col, capacity, open_bins, window, merged)


def pack_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, open_bins: int = OPEN_BINS, window: int = WINDOW, merged: int = MERGED) -> DataFrame:
    """pack() of token_pieces(): doc_id, piece, start, length, ids, sequence_id, offset, cut and packed in one pass over the texts."""
    cut, place = _cut(path, pattern, capacity, end_id), _pass(capacity, open_bins, window, "length", False)
    return _finish(_texts(docs, id_col, text_col).mapInArrow(lambda batches: place(cut(batches)), _placed_schema(PIECES)), "length", capacity, open_bins, window, merged)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, length, ids (the pieces' ids in order)."""
    parts = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", "length", F.expr("aggregate(parts, cast('' as binary), (acc, p) -> concat(acc, p.ids))").alias("ids"))


