"""Sketches of the keys of a change feed, stored per log file and merged on read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Registers of a distinct count are 2^12 (standard error 1.6 %).
LG_REGISTERS = 12
#: Keys a frequency sketch tracks.
TRACKED = 1_000
_BY = ("database", "table", "op")


def key_sketches(changes: DataFrame, lg_registers: int = LG_REGISTERS,
                 tracked: int = TRACKED) -> DataFrame:
    """Per (log file, database, table, op): exact ``n_changes``, and mergeable sketches of the
    number of distinct keys (``keys``) and of the most frequent keys (``frequent``). ``seq`` is a
    log position, whose upper half is the file's number. Null keys are counted as changes only."""
    return changes.groupBy(F.shiftright("seq", 32).alias("file_seq"), *_BY).agg(
        F.count("*").alias("n_changes"), F.hll_sketch_agg("key", F.lit(lg_registers)).alias("keys"),
        F.expr(f"approx_top_k_accumulate(key, {int(tracked)})").alias("frequent"))


def write_key_sketches(changes: DataFrame, path: str, lg_registers: int = LG_REGISTERS,
                       tracked: int = TRACKED) -> None:
    """Store ``key_sketches`` below ``path`` by log file. A file that is written again replaces
    its own sketches and leaves those of other files."""
    (key_sketches(changes, lg_registers, tracked).repartition("file_seq").write
     .mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file_seq")
     .parquet(path))


def merge_key_sketches(sketches: DataFrame, top: int = 10, tracked: int = TRACKED) -> DataFrame:
    """Per (database, table, op) over all given log files: ``n_changes``, the estimated number of
    ``distinct_keys`` and the ``top`` most frequent keys with their estimated counts."""
    return sketches.groupBy(*_BY).agg(
        F.sum("n_changes").alias("n_changes"),
        F.hll_sketch_estimate(F.hll_union_agg("keys")).alias("distinct_keys"),
        F.expr(f"approx_top_k_estimate(approx_top_k_combine(frequent, {int(tracked)}), {int(top)})")
        .alias("top_keys"))


def read_key_sketches(spark: SparkSession, path: str, top: int = 10,
                      tracked: int = TRACKED) -> DataFrame:
    """``merge_key_sketches`` of all stored files."""
    return merge_key_sketches(spark.read.parquet(path), top, tracked)
