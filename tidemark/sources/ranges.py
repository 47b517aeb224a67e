"""State clustered by ranges of its key, with an index of the files' smallest and largest keys.

    data/version=<n>      rows, dealt to files by sampled ranges of the key and sorted
    index/version=<n>     for every file its name, ``low``, ``high`` and number of rows

The index is written last and makes a version count; a version that failed in between leaves the
one before it in force, and that stays on disk for readers that have begun. A point read finds its
file in the index, so it opens one data file however large the state is; a range read opens the
files that overlap the range. What reaches the driver is the names of the files to read.

Rows with a null key are kept, in the first file, and no read by key finds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .versions import finished, numbers, remove


def write_ranges(state: DataFrame, path: str, key: str = "key", files: int | None = None) -> None:
    """Replace the state at ``path``. Without ``files`` their number follows the bytes written.

    A key should be one row's, as in the state of a table: rows of one key share a file. Sampling
    reads ``state`` once more, so give it from a table rather than from a long plan.
    """
    spark, column = state.sparkSession, F.col(f"`{key}`")
    data, index = (numbers(spark, f"{path}/{kind}", "version") for kind in ("data", "index"))
    before = [n for n in index if finished(spark, f"{path}/index/version={n}")][-1:]
    new = max(data + index, default=-1) + 1
    ranged = state.repartitionByRange(*([] if files is None else [files]), column)
    ranged.sortWithinPartitions(column).write.parquet(f"{path}/data/version={new}")
    rows = spark.read.schema(state.schema).parquet(f"{path}/data/version={new}")
    rows.groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.min(column).alias("low"), F.max(column).alias("high"), F.count("*").alias("n_rows")) \
        .sortWithinPartitions("low").write.parquet(f"{path}/index/version={new}")
    for kind, there in (("index", index), ("data", data)):
        for n in there:
            if n not in before:
                remove(spark, f"{path}/{kind}/version={n}")


def _newest(spark: SparkSession, path: str) -> int:
    for n in reversed(numbers(spark, f"{path}/index", "version")):
        if finished(spark, f"{path}/index/version={n}"):
            return n
    raise FileNotFoundError(f"no finished state below {path}")


def range_index(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``low``, ``high`` and ``n_rows`` of every file of the newest version."""
    return spark.read.parquet(f"{path}/index/version={_newest(spark, path)}")


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the newest version."""
    return spark.read.parquet(f"{path}/data/version={_newest(spark, path)}")


def _files(spark: SparkSession, path: str, wanted: Column, rows: Column) -> DataFrame:
    n = _newest(spark, path)
    folder = f"{path}/data/version={n}"
    found = spark.read.parquet(f"{path}/index/version={n}").filter(wanted).select("file").collect()
    if not found:
        return spark.read.parquet(folder).filter(F.lit(False))
    return spark.read.parquet(*[f"{folder}/{r.file}" for r in found]).filter(rows)


def range_lookup(spark: SparkSession, path: str, value, key: str = "key") -> DataFrame:
    """The rows of one key."""
    value = F.lit(value)
    return _files(spark, path, (F.col("low") <= value) & (F.col("high") >= value),
                  F.col(f"`{key}`") == value)


def range_scan(spark: SparkSession, path: str, low, high, key: str = "key") -> DataFrame:
    """The rows with keys from ``low`` to ``high``, both included."""
    low, high, column = F.lit(low), F.lit(high), F.col(f"`{key}`")
    return _files(spark, path, (F.col("low") <= high) & (F.col("high") >= low),
                  (column >= low) & (column <= high))
