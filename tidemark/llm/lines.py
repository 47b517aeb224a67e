"""Line dedup: two Bloom filters find suspects, only these shuffle for exact confirmation.

Every task fills two bit arrays from its documents: ``once`` for line keys it has seen and
``twice`` for keys that it saw again. Arrays of tasks merge bitwise, with what is in ``once`` of
both going to ``twice``; merging goes over two levels of groups. Keys of which every bit is in
the merged ``twice`` are suspects: a superset of all keys that two documents share. Their 128-bit
digests are counted exactly; a filter that is too small for the input costs shuffle, not results.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z in lower case.
Defined cases: a null text is one empty line; a key counts once for each row of the table that
holds it, so repeated rows count as documents; rows with a null doc_id are documents too.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..sources.scratch import new_path
from .text import sized

#: Bits a filter may have at most: 32 MB as it is sent to the executors.
MAX_BITS = 1 << 28
_MIN_BITS = 1 << 20
_BLOCK = 1 << 16
_FAN_IN = 256
#: Parts over which the rows of one repeated line are spread.
SALTS = 32


def _keys(text: str | None) -> list[bytes]:
    """Keys of the lines of a text, in order."""
    return [line.strip().lower() for line in (text or "").encode().split(b"\n")]


def _digests(text: str | None, min_chars: int) -> list[bytes | None]:
    """128-bit digests of the keys; None for keys too short to count."""
    return [xxhash.xxh3_128_digest(k) if len(k) >= min_chars and
            (min_chars < 2 or len(k.decode()) >= min_chars) else None for k in _keys(text)]


def _places(digests: np.ndarray, bits: int) -> np.ndarray:
    """Four bit positions for each 16-byte digest."""
    return (digests.view(np.uint32).reshape(-1, 4) & np.uint32(bits - 1)).astype(np.int64)


def _holds(filled: np.ndarray, places: np.ndarray) -> np.ndarray:
    return ((filled[places >> 3] >> (places & 7).astype(np.uint8)) & 1).all(axis=1)


def _fill(filled: np.ndarray, places: np.ndarray) -> None:
    places = np.unique(places)
    if len(places):
        where = places >> 3
        starts = np.flatnonzero(np.diff(where, prepend=-1))
        bits = np.left_shift(1, places & 7).astype(np.uint8)
        filled[where[starts]] |= np.bitwise_or.reduceat(bits, starts)


def _filters(min_chars: int, bits: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in sized(batches):
            found = [d for text in batch.column("text").to_pylist()
                     for d in set(_digests(text, min_chars)) if d is not None]
            if not found:
                continue
            counted = Counter(found)
            places = _places(np.frombuffer(b"".join(counted), np.uint8), bits)
            again = np.fromiter(counted.values(), np.int64, len(counted)) > 1
            _fill(twice, places[again | _holds(once, places)])
            _fill(once, places)
        task = TaskContext.get().partitionId()
        for at in range(0, bits // 8, _BLOCK):
            a, b = once[at:at + _BLOCK], twice[at:at + _BLOCK]
            if a.any():
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([at // _BLOCK], pa.int32()),
                    "part": pa.array([task], pa.int32()),
                    "once": pa.array([a.tobytes()], pa.binary()),
                    "twice": pa.array([b.tobytes()], pa.binary())})
    return build


def _merge(table: pa.Table) -> pa.Table:
    once = twice = None
    for a, b in zip(table.column("once"), table.column("twice")):
        a, b = (np.frombuffer(x.as_buffer(), np.uint8) for x in (a, b))
        if once is None:
            once, twice = a.copy(), b.copy()
        else:
            twice |= b | (once & a)
            once |= a
    return pa.table({"block": table.column("block").slice(0, 1),
                     "part": pa.array([table.column("part")[0].as_py() // _FAN_IN], pa.int32()),
                     "once": pa.array([once.tobytes()], pa.binary()),
                     "twice": pa.array([twice.tobytes()], pa.binary())})


def suspect_filter(docs: DataFrame, min_chars: int = 1, bits: int | None = None) -> np.ndarray:
    """The merged filter of keys that were seen twice. ``bits`` (a power of two) follows the
    number of documents, about 100 each, up to ``MAX_BITS``."""
    if bits is None:
        wanted = max(1, docs.count()) * 100
        bits = min(MAX_BITS, max(_MIN_BITS, 1 << (wanted - 1).bit_length()))
    schema = "block int, part int, once binary, twice binary"
    parts = docs.select("text").mapInArrow(_filters(min_chars, bits), schema)
    parts = parts.groupBy("block", F.expr(f"part div {_FAN_IN}")).applyInArrow(_merge, schema)
    parts = parts.groupBy("block").applyInArrow(_merge, schema)
    filled = np.zeros(bits // 8, np.uint8)
    for row in parts.select("block", "twice").collect():  # bits / 8 bytes in all
        filled[row.block * _BLOCK:row.block * _BLOCK + len(row.twice)] = np.frombuffer(
            row.twice, np.uint8)
    return filled


def repeated_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1,
                   bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Suspect lines (``doc_id``, ``text_hash``, ``digest``, ``line``), and of them the keys held
    by ``min_docs`` documents or more (``digest``, ``n_docs``, ``first``: the place of the first
    occurrence by doc_id and line)."""
    spark = docs.sparkSession
    filled = suspect_filter(docs, min_chars, bits)
    shared = spark.sparkContext.broadcast(filled)
    everything = min_docs < 2

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared.value
        for batch in sized(batches):
            ids, hashes, digests, lines = [], [], [], []
            for doc_id, text_hash, text in zip(*(batch.column(c).to_pylist() for c in (
                    "doc_id", "text_hash", "text"))):
                first: dict[bytes, int] = {}
                for n, d in enumerate(_digests(text, min_chars)):
                    if d is not None:
                        first.setdefault(d, n)
                ids += [doc_id] * len(first)
                hashes += [text_hash] * len(first)
                digests += first
                lines += first.values()
            if not digests:
                continue
            hit = np.ones(len(digests), bool) if everything else _holds(
                seen, _places(np.frombuffer(b"".join(digests), np.uint8), len(seen) * 8))
            where = np.flatnonzero(hit).tolist()
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([ids[i] for i in where], pa.int64()),
                "text_hash": pa.array([hashes[i] for i in where], pa.int64()),
                "digest": pa.array([digests[i] for i in where], pa.binary()),
                "line": pa.array([lines[i] for i in where], pa.int32())})

    path = new_path(spark, "lines")
    docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        suspects, "doc_id bigint, text_hash bigint, digest binary, line int").write.parquet(path)
    found = spark.read.parquet(path)
    counted = found.groupBy("digest").agg(
        F.count("*").alias("n_docs"), F.min(F.struct("doc_id", "line")).alias("first"))
    return found, counted.filter(F.col("n_docs") >= min_docs)


def _without(min_chars: int, names: list[str]):
    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches):
            kept, n_lines, n_dropped = [], [], []
            for text, gone, spared in zip(*(batch.column(c).to_pylist() for c in (
                    "text", "__gone", "__spared"))):
                lines = (text or "").split("\n")
                n_lines.append(len(lines))
                if gone:
                    gone, spared = set(gone), set(spared or ())
                    stay = []
                    for line, d in zip(lines, _digests(text, min_chars)):
                        if d not in gone:
                            stay.append(line)
                        elif d in spared:  # its first occurrence
                            spared.discard(d)
                            stay.append(line)
                    n_dropped.append(len(lines) - len(stay))
                    kept.append("\n".join(stay))
                else:
                    n_dropped.append(0)
                    kept.append(text or "")
            fixed = {"__kept": pa.array(kept, pa.string()),
                     "__n_lines": pa.array(n_lines, pa.int64()),
                     "__n_dropped": pa.array(n_dropped, pa.int64())}
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + list(fixed.values()), names + list(fixed))
    return drop


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1,
                keep_first: bool = False, bits: int | None = None) -> DataFrame:
    """Documents without the lines whose key ``min_docs`` documents hold or more; with
    ``keep_first`` the first occurrence (smallest doc_id, then line; one for each row of that
    doc_id) stays.

    Returns the columns of ``docs`` other than ``text``, with ``text`` (the lines that stay,
    joined), ``n_lines`` (before) and ``n_dropped``. Input columns of these names are replaced.
    """
    found, repeated = repeated_lines(docs, min_docs, min_chars, bits)
    # A line of every third document would be one task's work: its rows are salted.
    salt = F.pmod(F.xxhash64("doc_id", "text_hash", "digest"), F.lit(SALTS)).cast("int")
    spread = repeated.select("digest", "first", F.explode(
        F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    hits = found.withColumn("__salt", salt).join(spread, ["digest", "__salt"])
    spared = F.collect_set(F.when(
        F.lit(keep_first) & F.col("first.doc_id").eqNullSafe(F.col("doc_id")), F.col("digest")))
    # The rows of one id go by their texts, so that a set holds lines of one text. Texts that
    # share a hash share a set: it still holds repeated lines only.
    gone = hits.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(
        F.collect_set("digest").alias("__gone"), spared.alias("__spared"))
    keep = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    joined = docs.select(*[F.col(f"`{c}`") for c in keep], "text").join(
        gone, F.col("doc_id").cast("bigint").eqNullSafe(F.col("__id"))
        & (F.xxhash64("text") == F.col("__hash")), "left")
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    out = joined.select(*[F.col(f"`{c}`") for c in keep], "text", "__gone", "__spared").mapInArrow(
        _without(min_chars, keep), f"{fields}, __kept string, __n_lines bigint, __n_dropped bigint")
    return out.select(*[F.col(f"`{c}`") for c in keep], F.col("__kept").alias("text"),
                      F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"))
