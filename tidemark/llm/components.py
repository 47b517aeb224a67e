"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.scratch import drop, new_path

#: Edges that a task contracts at once (16 bytes each).
EDGES = 1 << 18


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of some edges and the smallest node each of them reaches."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two = ends[:len(a)], ends[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[one], root[two])
        new = root.copy()
        np.minimum.at(new, root[one], low)
        np.minimum.at(new, root[two], low)
        new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The edges of a task, about ``EDGES`` at a time."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= EDGES:
            yield tuple(pa.Table.from_batches(held).column(c).to_numpy() for c in ("a", "b"))
            held, rows = [], 0
    if rows:
        yield tuple(pa.Table.from_batches(held).column(c).to_numpy() for c in ("a", "b"))


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each slice of edges as stars: fewer edges and shorter paths with the same components."""
    for a, b in _slices(batches):
        nodes, roots = local_roots(a, b)
        other = nodes != roots
        yield pa.RecordBatch.from_pydict({"a": nodes[other], "b": roots[other]})


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every node of a slice with its root."""
    for a, b in _slices(batches):
        nodes, roots = local_roots(a, b)
        yield pa.RecordBatch.from_pydict({"node": nodes, "root": roots})


def _stored(edges: DataFrame, after: str | None = None) -> tuple[DataFrame, str]:
    """The edges as a written table, in the place of the one before it."""
    spark, path = edges.sparkSession, new_path(edges.sparkSession, "stars")
    edges.write.parquet(path)
    if after is not None:
        drop(spark, after)
    return spark.read.parquet(path), path


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for every node of an edge.

    ``edges`` has the BIGINT columns ``a`` and ``b``. Each round links the larger neighbours of
    every node to its smallest neighbour, then the smaller ones, until every node has one edge and
    that leads to a root.
    Slices are contracted and minima aggregated before they are shuffled, and each round is a
    written table, so that no lineage grows. Once the edges that are left fit one slice, that is
    contracted without any more rounds.
    """
    current, path = _stored(edges.filter("a <> b").select("a", "b").mapInArrow(
        _contract, "a bigint, b bigint"))
    while True:
        if current.count() <= EDGES:
            return _stored(current.coalesce(1).mapInArrow(
                _rooted, "node bigint, root bigint"), after=path)[0]
        # An edge points from the larger node to the smaller: roots have no edge of their own. A
        # node with two targets links them, so those are not roots yet.
        ends = current.select(F.col("a").alias("node"), F.lit(1).alias("own"), F.lit(0).alias("met"))
        ends = ends.unionByName(current.select(F.col("b").alias("node"), F.lit(0).alias("own"),
                                               F.lit(1).alias("met")))
        open_nodes = ends.groupBy("node").agg(F.sum("own").alias("own"), F.max("met").alias("met"))
        if open_nodes.filter("own > 1 or (own = 1 and met = 1)").isEmpty():
            break
        both = current.select("a", "b").unionByName(
            current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(
            F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter(
            "a <> b").unionByName(least.select("a", F.col("m").alias("b")))
        current, path = _stored(
            small.mapInArrow(_contract, "a bigint, b bigint").distinct(), after=path)
    roots = current.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    tops = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return roots.unionByName(tops)
