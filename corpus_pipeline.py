"""A corpus pipeline over ``documents``: classify, drop repeated lines, drop near-duplicates, mix
sources, pack sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written and read
again for the next one. All but the last keep the columns of ``docs``.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession, functions as F  # noqa: E402

from tidemark.llm.jaccard import one_of_each  # noqa: E402
from tidemark.llm.lines import dedup_lines  # noqa: E402
from tidemark.llm.mixing import mix_sources  # noqa: E402
from tidemark.llm.packing import pack_documents  # noqa: E402
from tidemark.llm.quality import score_quality  # noqa: E402
from tidemark.sources.scratch import new_path  # noqa: E402

#: Neighbour votes have no SQL form; tests hold every stage against a plain version of it.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_quality(docs, labels).filter("predicted = 1").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that ten or more of them hold; emptied documents stay, empty."""
    cut = dedup_lines(docs, min_docs=10, min_chars=1)
    return cut.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of five words, 0.8 or more."""
    return one_of_each(docs, width=5, num=80, den=100)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, shuffled."""
    return mix_sources(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their place in a sequence."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("lines", lines), ("near_copies", near_copies), ("mix", mix),
    ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, one after another."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
