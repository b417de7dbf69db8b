"""Best-fit packing of tokenised documents by a plan over the histogram of piece lengths.

One pass tokenises and cuts the documents and writes the pieces with their rank among equal lengths of their own
partition. The histogram (at most `capacity` counts, whatever the input) is planned on the driver: best-fit
decreasing over counts fills whole groups of equally filled sequences at a time, so the plan holds runs, not
documents. Each piece then takes the slot that the plan gives to its rank within its length.

Defined results: null or empty text is the end id alone; a document of more than `capacity` ids is cut so that
only its first piece may be shorter; repeated rows and repeated or null doc_ids are packed row by row; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import BPE_SLICE_BYTES, load
from .common import cut, scratch, text_slices, texts_of

CAPACITY = 2048


def plan_runs(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length, runs (first rank, first sequence, pieces a sequence, first offset), by first rank.

    Lengths go in descending order; a piece goes to the fullest sequence that still holds it. Sequences filled alike
    are one group (first, count), so a step places as many pieces as a whole group takes."""
    groups: dict[int, list[tuple[int, int]]] = {}
    free: list[int] = []
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    opened = 0

    def put(room: int, first: int, count: int) -> None:
        if count and room:
            if room not in groups:
                groups[room] = []
                insort(free, room)
            groups[room].append((first, count))

    for length in sorted((n for n, c in histogram.items() if c), reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(free, length)
            if at < len(free):
                room = free[at]
                first, count = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    free.pop(at)
            else:
                room = capacity
                count = -(-left // (capacity // length))
                first, opened = opened, opened + count
            each = room // length
            used = min(count, left // each) if left >= each else 1
            each = min(each, left)
            runs.setdefault(length, []).append((rank, first, each, capacity - room))
            rank, left = rank + used * each, left - used * each
            put(room - each * length, first, used)
            put(room, first + used, count - used)
    return runs


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Rows for each piece: doc_id, piece, start, length, ids_crc32, the partition and the rank among its equal lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        part_no = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for part in text_slices(batches, max_bytes=BPE_SLICE_BYTES):
            ids, ends = bpe.encode_column(texts_of(part))
            n = len(ends) - 1
            total = np.diff(ends) + 1
            flat = np.full(len(ids) + n, end_id, "<u4")
            flat[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(ends))] = ids
            count = -(-total // capacity)
            doc = np.repeat(np.arange(n), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            head = (total - (count - 1) * capacity)[doc]
            start = np.where(piece == 0, 0, head + (piece - 1) * capacity)
            length = np.where(piece == 0, head, capacity)
            begin = (ends[:-1] + np.arange(n))[doc] + start
            raw = memoryview(flat).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(length)) - np.searchsorted(ordered, ordered) + seen[ordered]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.record_batch(
                [part.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part_no), pa.int32()), pa.array(rank, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "part_no", "part_rank"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part_no int, part_rank long")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Every piece with its sequence_id and its gapless offset there."""
    with scratch() as keep:
        return keep(_pack(docs, path, capacity, end_id))


def _pack(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    made = cut(pieces(docs, path, capacity, end_id))
    counts = made.groupBy("part_no", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part_no", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    runs = {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in plan_runs(histogram, capacity).items()}

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("slot_rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length).tolist():
                own = np.flatnonzero(length == n)
                first, seq, each, at = runs[n]
                r = np.searchsorted(first, rank[own], side="right") - 1
                k = rank[own] - first[r]
                sequence[own] = seq[r] + k // each[r]
                offset[own] = at[r] + k % each[r] * n
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = made.join(offsets, ["part_no", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("earlier") + F.col("part_rank")).alias("slot_rank"))
    return ranked.mapInArrow(take, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
