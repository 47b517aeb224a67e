"""Bounded samples of labelled documents for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the documents that no model learns from: crc32 of the id's text mod 4 is 2."""
    crc = F.crc32(F.col(doc_id).cast("bigint").cast("string").cast("binary"))
    return F.coalesce(crc % 4 == 2, F.lit(False))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str,
                   per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """Texts of at most ``per_class`` labelled documents of each class that are not held out
    (``doc_id``, ``label``, ``text``), those with the smallest hashes, and the number of labels
    of each class they stand for.

    Null ids and labels teach nothing; of several labels of one document the largest counts, of
    several texts the one with the smallest hash. So there are at most ``2 * per_class`` rows.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()
                          & ~held_out()).groupBy(F.col("doc_id").cast("bigint").alias("__id")).agg(
        F.max(label).cast("int").alias("label"))
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()
              if r.label in (0, 1)}
    chosen = None
    for value in (0, 1):
        part = known.filter(F.col("label") == value).orderBy(F.xxhash64("__id"), "__id").limit(
            per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most 2 * per_class rows of two numbers.
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(
        F.broadcast(chosen), F.col("doc_id") == F.col("__id")).groupBy("doc_id", "label").agg(
        F.min_by("text", F.xxhash64("text")).alias("text"))
    return texts, counts
