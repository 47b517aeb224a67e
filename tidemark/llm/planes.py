"""Token-id files: ids in bit or byte planes, each plane compressed, with an index of all planes.

Documents are dealt by ranges of doc_id and hash of the text and sorted, tokenized, and written as segments of whole
documents. A segment is one row of a Parquet file: its documents and their lengths, the ids as
blocks of ``block_ids`` ids (the last may be shorter), each block transposed to four byte planes
or thirty-two bit planes of its unsigned 32-bit ids, each plane compressed with zstandard, and an
index with offset and length of every plane, block after block. A segment can be read alone; its
place in the whole order is its shard's start plus its own start in the shard.

Defined cases: a null text is empty and holds the end id only; rows with a null doc_id come
first; rows with equal doc_id follow each other in the order of their texts' hashes, so that an id
on many rows is split too (rows with equal doc_id and text are one range); no documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .text import sized
from .tokens import default_path, encoder

BLOCK_IDS = 1 << 16
#: A segment ends with the document that brings it to this many ids.
SEGMENT_IDS = 1 << 20
#: Starts of shards (two numbers each) are broadcast up to this many; more join by a shuffle.
BROADCAST_SHARDS = 1 << 20
_SCHEMA = ("shard int, shard_start bigint, n_ids bigint, doc_ids array<bigint>, "
           "lengths array<bigint>, planes string, block_ids int, index binary, payload binary")


def to_planes(ids: np.ndarray, planes: str = "byte") -> list[bytes]:
    """The planes of one block, lowest byte or bit first."""
    rows = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if planes == "bit":
        bits = np.unpackbits(rows, axis=1, bitorder="little")
        return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]
    return [rows[:, k].tobytes() for k in range(4)]


def from_planes(parts: list[bytes], count: int) -> np.ndarray:
    rows = np.empty((count, 4), np.uint8)
    if len(parts) == 32:
        bits = np.empty((count, 32), np.uint8)
        for k, part in enumerate(parts):
            bits[:, k] = np.unpackbits(np.frombuffer(part, np.uint8), count=count,
                                       bitorder="little")
        rows = np.packbits(bits, axis=1, bitorder="little")
    else:
        for k, part in enumerate(parts):
            rows[:, k] = np.frombuffer(part, np.uint8)
    return np.ascontiguousarray(rows).view("<u4").reshape(-1)


def pack_ids(ids: np.ndarray, planes: str, block_ids: int, level: int = 3) -> tuple[bytes, bytes]:
    """Index (pairs of unsigned 64-bit offset and length) and payload of a segment's ids."""
    squeeze = zstandard.ZstdCompressor(level=level)
    parts = [squeeze.compress(p) for at in range(0, len(ids), block_ids)
             for p in to_planes(ids[at:at + block_ids], planes)]
    size = np.array([len(p) for p in parts], "<u8")
    index = np.stack([np.cumsum(size) - size, size], axis=1) if parts else size
    return index.astype("<u8").tobytes(), b"".join(parts)


def unpack_ids(index: bytes, payload: bytes, count: int, planes: str,
               block_ids: int) -> np.ndarray:
    spread = zstandard.ZstdDecompressor()
    places = np.frombuffer(index, "<u8").reshape(-1, 2)
    each = 32 if planes == "bit" else 4
    blocks = []
    for number, at in enumerate(range(0, count, block_ids)):
        parts = [spread.decompress(payload[int(a):int(a + n)])
                 for a, n in places[number * each:(number + 1) * each]]
        blocks.append(from_planes(parts, min(block_ids, count - at)))
    return np.concatenate(blocks) if blocks else np.zeros(0, np.uint32)


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2,
                 planes: str = "byte", block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of all documents, each followed by ``end_id``, in ascending doc_id order."""
    if planes not in ("byte", "bit"):
        raise ValueError(f"planes must be 'byte' or 'bit', not {planes!r}")
    tokenizer = tokenizer or default_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, start = TaskContext.get().partitionId(), 0
        ids, names, lengths = [], [], []

        def segment():
            nonlocal start, ids, names, lengths
            flat = np.concatenate(ids)
            index, payload = pack_ids(flat, planes, block_ids)
            row = pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()),
                "shard_start": pa.array([start], pa.int64()),
                "n_ids": pa.array([len(flat)], pa.int64()),
                "doc_ids": pa.array([names], pa.list_(pa.int64())),
                "lengths": pa.array([lengths], pa.list_(pa.int64())),
                "planes": [planes], "block_ids": pa.array([block_ids], pa.int32()),
                "index": [index], "payload": [payload]})
            start += len(flat)
            ids, names, lengths = [], [], []
            return row

        for batch in sized(batches):
            flat, offsets = encoder(tokenizer).encode(batch.column("text"))
            ids.append(np.insert(flat, offsets[1:], np.uint32(end_id)))
            names += batch.column("doc_id").to_pylist()
            lengths += (np.diff(offsets) + 1).tolist()
            if sum(map(len, ids)) >= SEGMENT_IDS:
                yield segment()
        if ids:
            yield segment()

    # No count of partitions is given, so that Spark may join small neighbours.
    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text",
                          F.xxhash64("text").alias("hash")) \
        .repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text")
    ordered.select("doc_id", "text").mapInArrow(encode, _SCHEMA).write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Documents of written files: ``doc_id``, ``start`` (ids of all documents before it),
    ``n_tokens`` and ``ids`` (unsigned 32-bit, little-endian, end id included)."""
    rows = spark.read.parquet(path)
    # One row for each task that wrote.
    shards = rows.groupBy(F.col("shard").alias("__shard")).agg(F.sum("n_ids").alias("__ids"))
    starts = shards.select("__shard", (F.sum("__ids").over(
        Window.orderBy("__shard")) - F.col("__ids")).alias("__start"))
    if shards.count() <= BROADCAST_SHARDS:
        starts = F.broadcast(starts)
    placed = rows.join(starts, F.col("shard") == F.col("__shard")).select(
        (F.col("__start") + F.col("shard_start")).alias("start"), "n_ids", "doc_ids", "lengths",
        "planes", "block_ids", "index", "payload")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                ids = unpack_ids(row["index"], row["payload"], row["n_ids"], row["planes"],
                                 row["block_ids"])
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                data = pa.py_buffer(ids.astype("<u4").tobytes())
                offsets = pa.py_buffer(np.concatenate([[0], ends * 4]).astype(np.int64).tobytes())
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "start": pa.array(row["start"] + ends - lengths, pa.int64()),
                    "n_tokens": pa.array(lengths, pa.int64()),
                    "ids": pa.LargeBinaryArray.from_buffers(
                        pa.large_binary(), len(lengths), [None, offsets, data]).cast(pa.binary())})

    return placed.mapInArrow(decode, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
