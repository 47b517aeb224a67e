"""Exact top-k search: products of query and shard tiles, selection per tile, tree merging.

Candidates are dealt to shards and queries to groups by hash, both of bounded size. Each pair of
a group and a shard is a tile, computed in one task as blocked matrix products, of which only the
``k`` best of each query leave the task. Lists of a query merge over levels of ``FAN_IN`` shards.

Integers stay exact: products are made in double precision while every possible sum is under
2^53, else with integers of any size (scores beyond a long are cut to the long range).

Defined cases: vectors that are null or hold null or non-finite components and rows with a null
id take no part; rows with one id are a candidate each, and as a query the one with the smallest
vector asks, for none of them; shorter vectors count as filled up with zeros; equal scores go to
the smaller id; no queries or candidates give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.scratch import new_path

FAN_IN = 16
#: Components in a shard and in a group of queries, and rows in a shard.
SHARD_VALUES, GROUP_VALUES, SHARD_ROWS = 1 << 21, 1 << 22, 4096
_BLOCK = 256
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


def scaled_floor(vector: Column, scale: int = 64) -> Column:
    """Every component as ``floor(scale * x)``, kept as a double."""
    def one(x: Column) -> Column:
        y = x.cast("double") * float(scale)
        # Beyond 2^53 a double is a whole number already.
        return F.when(F.abs(y) < _EXACT, F.floor(y).cast("double")).otherwise(y)
    return F.transform(vector, one)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.asarray(column.offsets)
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
    length = np.diff(offsets)
    if (length == width).all():
        return values.reshape(len(length), width)
    out = np.zeros((len(length), width))
    out[np.arange(width) < length[:, None]] = values
    return out


def best_of_tile(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray,
                 row_ids: np.ndarray, k: int):
    """For each query the places and scores of its ``k`` best rows with other ids; ``row_ids``
    ascend."""
    n = len(row_ids)
    k = min(k, n)
    bound = (np.abs(queries).sum(axis=1).max(initial=0.0) * np.abs(rows).max(initial=0.0))
    whole = bool((rows == np.floor(rows)).all() and (queries == np.floor(queries)).all())
    own, end = (np.searchsorted(row_ids, query_ids, side) for side in ("left", "right"))
    most = int((end - own).max(initial=0))
    for at in range(0, len(queries), _BLOCK):
        block = queries[at:at + _BLOCK]
        if whole and bound >= _EXACT:
            to_int = np.vectorize(int, otypes=[object])
            score = to_int(block).dot(to_int(rows).T)
        else:
            score = block @ rows.T
        if whole and bound * n * 4 < _EXACT:
            # Score and place as one number, so that one selection settles ties too.
            key = score * n - np.arange(n)
            for i in np.flatnonzero((end > own)[at:at + _BLOCK]).tolist():
                key[i, own[at + i]:end[at + i]] = -np.inf
            best = np.argpartition(key, n - k, axis=1)[:, n - k:]
            order = np.argsort(-np.take_along_axis(key, best, axis=1), axis=1)
            best = np.take_along_axis(best, order, axis=1)
        else:
            best = np.array([sorted(range(n), key=lambda j: (-s[j], j))[:k + most] for s in score])
        for i, places in enumerate(best):
            places = places[(places < own[at + i]) | (places >= end[at + i])][:k]
            yield at + i, places, score[i, places]


def _tile(width: int, k: int):
    empty = pa.table({
        "query_id": pa.array([], pa.int64()), "__shard": pa.array([], pa.int32()),
        "hits": pa.array([], pa.list_(pa.struct([("low", pa.float64()), ("vec_id", pa.int64()),
                                                ("score", pa.int64())])))})

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return empty
        right = right.take(pa.array(np.argsort(right.column("vec_id").to_numpy())))
        ids = right.column("vec_id").to_numpy()
        query_ids = left.column("vec_id").to_numpy()
        names, hits = [], []
        for i, places, scores in best_of_tile(
                _matrix(left.column("vector"), width), query_ids,
                _matrix(right.column("vector"), width), ids, k):
            names.append(int(query_ids[i]))
            hits.append([{"low": -float(s), "vec_id": int(v),
                          "score": max(-_LONG, min(_LONG, int(math.floor(s))))}
                         for v, s in zip(ids[places], scores)])
        shard = pa.array([right.column("__shard")[0].as_py()] * len(names), pa.int32())
        return pa.table({"query_id": pa.array(names, pa.int64()), "__shard": shard,
                         "hits": pa.array(hits, empty.schema.field("hits").type)})
    return run


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """The ``k`` rows with the highest inner product for every query, the query's own left out.

    ``vectors`` has ``vec_id`` and ``embedding``; ``is_query`` tells which rows are queries too.
    Returns ``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``, the inner product of the
    components ``floor(scale * x)``.
    """
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
        & (F.abs(x.cast("double")) < float("inf")))
    clean = vectors.withColumn("__query", F.coalesce(is_query, F.lit(False))).filter(
        F.coalesce(usable, F.lit(False))).select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        scaled_floor(F.col("embedding"), scale).alias("vector"), "__query")
    # Written once: its size, the queries and the candidates are three readings.
    path = new_path(vectors.sparkSession, "vectors")
    clean.write.parquet(path)
    clean, asked = (vectors.sparkSession.read.parquet(path) for _ in range(2))
    size = clean.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width"),
                     F.count_if("__query").alias("queries")).first()
    width = size.width or 0
    rows = max(1, min(SHARD_ROWS, SHARD_VALUES // max(1, width)))
    shards = max(1, -(-size.n // rows))
    groups = max(1, -(-size.queries * max(1, width) // GROUP_VALUES))
    # Rows of one id are dealt out by their vectors, so that a frequent id fills no shard alone.
    right = clean.select("vec_id", "vector", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)).cast("int").alias("__shard"),
                         F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("__group"))
    left = asked.filter("__query").groupBy("vec_id").agg(F.min("vector").alias("vector")).select(
        "vec_id", "vector", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("__group"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("__shard"))
    keys = ["__group", "__shard"]
    lists = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        _tile(width, k), "query_id bigint, __shard int, "
        "hits array<struct<low: double, vec_id: bigint, score: bigint>>")
    while True:
        merged = F.slice(F.sort_array(F.flatten(F.collect_list("hits"))), 1, k).alias("hits")
        shards = -(-shards // FAN_IN)
        lists = lists.groupBy("query_id", F.expr(f"__shard div {FAN_IN}").cast("int").alias(
            "__shard")).agg(merged)
        if shards <= 1:
            break
    return lists.select("query_id", F.posexplode("hits").alias("__at", "__hit")).select(
        "query_id", (F.col("__at") + 1).alias("rank"), F.col("__hit.vec_id").alias("vec_id"),
        F.col("__hit.score").alias("score"))
