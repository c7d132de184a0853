"""Best-fit decreasing packing of tokenised documents into sequences of limited length.

Pieces of one length are interchangeable, so best-fit decreasing over any number of pieces is decided by how many there
are of each length: at most ``capacity`` numbers. A segment tree over remaining capacities finds the tightest open
sequences that take a length; all pieces of a length that go to alike sequences are placed in one step. The plan says
for the n-th piece of a length where it goes; pieces are numbered and placed where they lie, over the whole cluster.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfwright.llm.common import snapshot
from shelfwright.llm.wordids import encoder, slices

CAPACITY = 2048
PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long"


class FreeSpace:
    """A segment tree over remaining capacities: how many runs of open sequences have each."""

    def __init__(self, capacity: int):
        self._leaves = 1 << capacity.bit_length()
        self._count = [0] * (2 * self._leaves)

    def add(self, room: int, runs: int) -> None:
        node = room + self._leaves
        while node:
            self._count[node] += runs
            node >>= 1

    def tightest(self, room: int) -> int | None:
        """The least remaining capacity of at least ``room`` that some open sequence has."""
        node = room + self._leaves
        if self._count[node]:
            return room
        while node > 1:
            if not node & 1 and self._count[node + 1]:
                node += 1
                while node < self._leaves:
                    node = 2 * node if self._count[2 * node] else 2 * node + 1
                return node - self._leaves
            node >>= 1
        return None


def best_fit(counts: dict[int, int], capacity: int) -> np.ndarray:
    """The plan: rows of (length, first, sequence, each, offset), in order of length and first.

    From the ``first``-th piece of a length on, every ``each`` pieces go to one sequence, from ``sequence`` and
    ``offset`` on; then comes the next sequence, until the next row's ``first``."""
    free, open_runs, plan, opened = FreeSpace(capacity), {}, [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            open_runs.setdefault(room, []).append((first, n))
            free.add(room, 1)

    for length in sorted(counts, reverse=True):
        left, done = counts[length], 0
        while left:
            room = free.tightest(length)
            if room is None:
                room, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            else:
                first, n = open_runs[room].pop()
                free.add(room, -1)
            each = room // length
            plan.append((length, done, first, each, capacity - room))
            full = min(n, left // each)
            put(room - each * length, first, full)
            left, done, used = left - full * each, done + full * each, full
            if full < n and left:
                put(room - left * length, first + full, 1)
                left, done, used = 0, done + left, full + 1
            put(room, first + used, n - used)
    return np.array(plan, np.int64).reshape(-1, 5)[np.lexsort(([r[1] for r in plan], [r[0] for r in plan]))] if plan else np.empty((0, 5), np.int64)


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """The pieces of every row, each numbered (``nth``) among those of its length that its task saw (``task``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = encoder(tokenizer_file), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        row = task << 40
        for batch in batches:
            doc_ids = batch.column(0)
            for first, texts in slices(batch.column(1)):
                ids, offsets = encode(texts, end_id)
                sizes = np.diff(offsets)
                cuts = -(-sizes // capacity)
                owner = np.repeat(np.arange(len(sizes)), cuts)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                start = piece * capacity
                length = np.minimum(sizes[owner] - start, capacity)
                at, data = offsets[owner] + start, memoryview(ids.astype("<u4", copy=False)).cast("B")
                crc = [zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist())]
                # The n-th of its length: its place among equal lengths here, after those of the batches before.
                order = np.argsort(length, kind="stable")
                tally = np.bincount(length, minlength=capacity + 1)
                nth = np.empty(len(order), np.int64)
                nth[order] = np.arange(len(order)) - np.repeat(np.cumsum(tally) - tally, tally)
                nth += seen[length]
                seen += tally
                columns = [row + owner, doc_ids.slice(first, len(texts)).take(pa.array(owner)), piece.astype(np.int32), start, length, np.array(crc, np.int64), np.full(len(owner), task), nth]
                row += len(texts)
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [c.split()[0] for c in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece.

    A document is its ids and ``end_id``; null and empty texts are ``end_id`` alone. Only documents longer than the
    capacity are cut. Repeated rows and null ids are packed like any others. Sequences have no gaps."""
    cut = snapshot(pieces(docs, tokenizer_file, capacity, end_id), "pieces")
    by_task = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = snapshot(by_task.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumnsRenamed({"length": "_length", "task": "_task"}), "starts")
    # At most one row per length reaches the driver, whatever the number of pieces.
    counts = {r[0]: r[1] for r in starts.groupBy("_length").agg(F.sum("n")).collect()}
    plan = docs.sparkSession.sparkContext.broadcast(best_fit(counts, capacity))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = plan.value
        shift = np.int64(1) << 48  # places of a length; lengths are far below 2^15
        keys = rows[:, 0] * shift + rows[:, 1]
        for frame in frames:
            length, nth = frame["length"].to_numpy(), frame["nth"].to_numpy() + frame.pop("_before").to_numpy()
            chosen = rows[np.searchsorted(keys, length * shift + nth, side="right") - 1]
            beyond = nth - chosen[:, 1]
            frame["sequence_id"] = chosen[:, 2] + beyond // chosen[:, 3]
            frame["offset"] = chosen[:, 4] + beyond % chosen[:, 3] * length
            yield frame.drop(columns="nth")

    numbered = cut.join(starts, (F.col("length") == F.col("_length")) & (F.col("task") == F.col("_task"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "nth", "_before"
    )
    return numbered.mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
