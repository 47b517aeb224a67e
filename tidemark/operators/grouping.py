"""Grouping keys that sort fast."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

HASH = "__hash"


def with_group_hash(df: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    """Put a hash of the group columns in front of them when one is text.

    Sorts compare the first eight bytes first; keys padded with zeros agree in more than that,
    so without the hash every comparison would walk both keys. Groups stay the same.
    """
    text = any(isinstance(df.schema[c].dataType, T.StringType) for c in by)
    return (df.withColumn(HASH, F.xxhash64(*by)), [HASH, *by]) if text else (df, by)
