"""Counts of a change feed and user hooks on a stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from .. import schemas as S
from .apply import turns_live
from .carry import RANGE_BITS, carry_last


def change_metrics(changes: DataFrame, bits: int = RANGE_BITS, levels: int = 1) -> DataFrame:
    """Per (database, table, op): changes, INSERTs of a live key, UPDATEs/DELETEs of a missing
    key. ``seq`` is a BIGINT, unique within a key."""
    op = F.col("op")
    by = ["database", "table", "key"]
    feed = changes.select(*by, "op", "seq")
    seen = carry_last(feed, by, "seq", turns_live(), "__live", strict=True, bits=bits,
                      levels=levels)
    live = F.coalesce(F.col("__live"), F.lit(False))
    return seen.groupBy("database", "table", "op").agg(
        F.count("*").alias("n_changes"),
        F.count_if((op == S.INSERT) & live).alias("duplicate_inserts"),
        F.count_if((op != S.INSERT) & ~live).alias("missing_key_changes"))


def tap(df: DataFrame, name: str | Observation, *metrics: Column) -> DataFrame:
    """Watch the records passing a stage without changing them. Give an ``Observation`` to read
    the totals after a batch action, or a name to find them in streaming progress."""
    if not metrics:
        metrics = (F.count(F.lit(1)).alias("n_records"),)
    return df.observe(name, *metrics)
