"""State clustered by key ranges: which files reads open, and versions that do not get whole."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.functions import format_key
from tidemark.sources import (
    range_index, range_lookup, range_scan, read_ranges, ranges, write_ranges,
)

N = 100_000


@pytest.fixture(scope="module")
def state(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("clustered"))
    rows = spark.range(N).select(format_key(F.col("id") * 2, integer=True).alias("key"),
                                 (F.col("id") % 7).alias("value"))
    rows.repartition(5).write.parquet(f"{folder}/plain")
    write_ranges(spark.read.parquet(f"{folder}/plain"), f"{folder}/state", files=16)
    return f"{folder}/state"


def key(n):
    return str(n).rjust(24, "0")


def test_a_point_read_opens_one_file(spark, state):
    index = range_index(spark, state).orderBy("low").collect()
    assert len(index) == 16 and sum(r.n_rows for r in index) == N
    assert all(a.high < b.low for a, b in zip(index, index[1:]))
    for n in (0, 2, 77_776, 2 * N - 2):
        found = range_lookup(spark, state, key(n))
        assert len(found.inputFiles()) == 1
        assert [tuple(r) for r in found.collect()] == [(key(n), n // 2 % 7)]
    assert range_lookup(spark, state, key(3)).collect() == []
    beyond = range_lookup(spark, state, key(2 * N))
    assert beyond.collect() == [] and beyond.columns == ["key", "value"]


def test_a_range_read_opens_the_files_that_overlap(spark, state):
    index = range_index(spark, state).orderBy("low").collect()
    low, high = index[3].high, index[5].low
    found = range_scan(spark, state, low, high)
    assert len(found.inputFiles()) == 3
    assert found.count() == index[4].n_rows + 2
    assert range_scan(spark, state, key(5), key(5)).count() == 0
    assert range_scan(spark, state, key(9), key(4)).count() == 0
    assert range_scan(spark, state, "", "9").count() == N


def test_versions(spark, tmp_path):
    path = str(tmp_path / "s")
    with pytest.raises(FileNotFoundError):
        read_ranges(spark, path)
    rows = "key string, `a.b` int"
    write_ranges(spark.createDataFrame([("k1", 1), (None, 2), ("k3", 3)], rows), path, files=2)
    broken = spark.createDataFrame([("k1", 9)], rows).withColumn(
        "a.b", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        write_ranges(broken, path)
    assert sorted(r[1] for r in read_ranges(spark, path).collect()) == [1, 2, 3]
    assert [tuple(r) for r in range_lookup(spark, path, "k3").collect()] == [("k3", 3)]
    write_ranges(spark.createDataFrame([("k1", 10)], rows), path)
    assert [tuple(r) for r in read_ranges(spark, path).collect()] == [("k1", 10)]
    write_ranges(spark.createDataFrame([], rows), path)
    assert read_ranges(spark, path).count() == 0
    assert range_lookup(spark, path, "k1").collect() == []
    assert len([d for d in os.listdir(f"{path}/index") if d.startswith("version=")]) == 2


def test_numeric_keys(spark, tmp_path):
    path = str(tmp_path / "n")
    write_ranges(spark.range(-50, 50).select(F.col("id").alias("order id")), path,
                 key="order id", files=4)
    assert range_lookup(spark, path, -7, key="order id").count() == 1
    assert range_scan(spark, path, -7, 7, key="order id").count() == 15
    assert ranges.range_index(spark, path).agg(F.min("low")).first()[0] == -50
