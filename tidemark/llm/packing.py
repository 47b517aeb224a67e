"""Best-fit packing of token sequences, planned on the histogram of lengths.

Documents over the capacity are cut into full pieces and a rest. Which bin holds which lengths
depends on the counts of the lengths only, so the plan is made from at most ``capacity`` counts:
lengths over a third of the capacity meet at most twice in a bin, by a greedy matching that gives
the largest its largest partner that fits; smaller ones, in falling order, go each to the
smallest gap that holds them. Runs of equal lengths are placed at once, so the plan has a few
rows for each length, whatever the number of documents. A piece finds its place by its rank
among the pieces of its length.

Defined cases: a null or empty text is a document of the end id alone; repeated rows are packed
each; documents with a null doc_id too; no documents give no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.scratch import new_path
from .text import sized
from .tokens import default_path, encoder

CAPACITY = 4096
#: Bytes of text that a task encodes at once.
_SLICE = 1 << 20


def token_pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1,
                 capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every document and its ``end_id``: ``doc_id``,
    ``piece``, ``start``, ``length``, ``ids_crc32``, with ``task`` and ``task_rank`` (the number
    of pieces of that length before it in its task)."""
    tokenizer = tokenizer or default_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in sized(batches, limit=_SLICE):
            flat, offsets = encoder(tokenizer).encode(batch.column("text"))
            flat = np.insert(flat, offsets[1:], np.uint32(end_id)).astype("<u4")
            offsets = offsets + np.arange(len(offsets))
            size = np.diff(offsets)
            pieces = -(-size // capacity)
            row = np.repeat(np.arange(len(size)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(size[row] - start, capacity)
            data = memoryview(flat.tobytes())
            at = (offsets[:-1][row] + start) * 4
            crc = [zlib.crc32(data[a:b]) for a, b in zip(at.tolist(), (at + length * 4).tolist())]
            # Ranks of equal lengths: stable order, then the distance from the first of its kind.
            order = np.argsort(length, kind="stable")
            kinds, counts = np.unique(length, return_counts=True)
            rank = np.empty(len(row), np.int64)
            rank[order] = (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                           + np.repeat(seen[kinds], counts))
            seen[kinds] += counts
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                 pa.array(crc, pa.int64()), pa.array(np.full(len(row), task), pa.int32()),
                 pa.array(rank, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "task", "task_rank"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, "
             "task int, task_rank bigint")


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Placements ``(length, rank, bin, per_bin, offset)``: from that rank of the length on, each
    bin from ``bin`` on takes ``per_bin`` pieces, side by side from ``offset``."""
    large = sorted((n for n in counts if 3 * n > capacity), reverse=True)
    left, taken = dict(counts), dict.fromkeys(counts, 0)
    places, bins = [], 0
    gaps: dict[int, list[tuple[int, int]]] = {}
    heap: list[int] = []  # gaps, a gap once or more

    def place(length, count, bin_, per_bin, offset):
        places.append((length, taken[length], bin_, per_bin, offset))
        taken[length] += count
        left[length] -= count

    def leave(gap, bin_, count):
        if gap and count:
            gaps.setdefault(gap, []).append((bin_, count))

    for n in large:
        while left[n]:
            partner = next((m for m in large if m <= min(n, capacity - n)
                            and left[m] >= 1 + (m == n)), None)
            if partner is None:
                pairs = left[n]
                place(n, pairs, bins, 1, 0)
                leave(capacity - n, bins, pairs)
            elif partner == n:
                pairs = left[n] // 2
                place(n, 2 * pairs, bins, 2, 0)
                leave(capacity - 2 * n, bins, pairs)
            else:
                pairs = min(left[n], left[partner])
                place(n, pairs, bins, 1, 0)
                place(partner, pairs, bins, 1, n)
                leave(capacity - n - partner, bins, pairs)
            bins += pairs

    heap = sorted(gaps)
    for n in sorted((n for n in counts if 3 * n <= capacity), reverse=True):
        # Gaps under n hold only smaller pieces: they wait.
        waiting = []
        while left[n]:
            while heap and (heap[0] < n or not gaps.get(heap[0])):
                gap = heapq.heappop(heap)
                if gaps.get(gap):
                    waiting.append(gap)
            if heap:
                gap = heap[0]
                bin_, count = gaps[gap].pop()
            else:
                gap, bin_ = capacity, bins
                count = -(-left[n] // (capacity // n))
                bins += count
            each = gap // n
            full = min(count, left[n] // each)
            if full:
                place(n, full * each, bin_, each, capacity - gap)
                rest = gap - each * n
                if rest:
                    leave(rest, bin_, full)
                    heapq.heappush(heap, rest)
            if full < count and left[n]:
                some = left[n]
                place(n, some, bin_ + full, some, capacity - gap)
                leave(gap - some * n, bin_ + full, 1)
                heapq.heappush(heap, gap - some * n)
                full += 1
            if full < count:
                leave(gap, bin_ + full, count - full)
                heapq.heappush(heap, gap)
        for gap in waiting:
            heapq.heappush(heap, gap)
    return places


def pack_sequences(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset`` (gapless from 0 in each sequence).

    ``pieces`` has ``length`` (1 to ``capacity``), ``task`` and ``task_rank`` as from
    ``token_pieces``; the other columns stay. Best read from a table, as it is read twice.
    """
    spark = pieces.sparkSession
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("__n"))
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(
        F.sum("__n").alias("n")).collect()}  # at most ``capacity`` rows
    places = plan_bins(counts, capacity)
    table = np.array(sorted(places), np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(table)
    before = by_task.select(
        F.col("length").alias("__length"), F.col("task").alias("__task"),
        (F.sum("__n").over(Window.partitionBy("length").orderBy("task")) - F.col("__n"))
        .alias("__before"))
    ranked = pieces.join(before, (F.col("length") == F.col("__length"))
                         & (F.col("task") == F.col("__task")))
    keep = [c for c in pieces.columns if c not in ("task", "task_rank", "sequence_id", "offset")]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = shared.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "__rank"))
            # Ranks stay under 2^48, so length and rank together order as one number.
            at = np.searchsorted((places[:, 0] << 48) + places[:, 1], (length << 48) + rank,
                                 "right") - 1
            _, first, bin_, each, offset = places[at].T
            sequence = bin_ + (rank - first) // each
            place = offset + (rank - first) % each * length
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(sequence), pa.array(place)],
                keep + ["sequence_id", "offset"])

    fields = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in keep)
    return ranked.select(*[F.col(f"`{c}`") for c in keep],
                         (F.col("task_rank") + F.col("__before")).alias("__rank")).mapInArrow(
        assign, f"{fields}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1,
                   capacity: int = CAPACITY) -> DataFrame:
    """Tokenize, cut and pack: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id`` and ``offset`` for every piece."""
    path = new_path(docs.sparkSession, "pieces")
    token_pieces(docs, tokenizer, end_id, capacity).write.parquet(path)
    return pack_sequences(docs.sparkSession.read.parquet(path), capacity)
