"""Streams: equal to batch, restart, repeated and growing files, compaction, hooks."""

import random

import pytest
from pyspark.sql import Observation, functions as F

from logs import KEY, rows, table_map, write_file
from test_apply import FEED, cases
from tidemark import schemas as S
from tidemark.operators import apply_multi_table, split_valid, tap
from tidemark.plans import packing as P
from tidemark.sources.binlog import bad_events
from tidemark.streaming import (
    apply_stream, binlog_stream, change_stream, compact_state, read_state, state_per_core,
    use_rocksdb,
)
from tidemark.streaming.apply import keep_batches, read_kept

BY = ("database", "table", "key")


def rows_of(df):
    return {(r.table, r.key): (r.a, r.b, r.last_seq) for r in df.collect()}


def test_disorder_restart_repeats_and_compaction(spark, tmp_path):
    use_rocksdb(spark)
    _, feeds = cases(40, seed=9)
    flat = [r for f in feeds for r in f]
    random.Random(4).shuffle(flat)
    source, target, checkpoint = (str(tmp_path / d) for d in ("in", "out", "check"))
    third = len(flat) // 3
    seen = []

    def land(part):
        spark.createDataFrame(part, FEED).coalesce(2).write.mode("append").parquet(source)

    def run(to):
        stream = spark.readStream.schema(FEED).option("maxFilesPerTrigger", "1").parquet(source)
        apply_stream(stream, to, checkpoint, BY, on_batch=lambda df, i: seen.append(i),
                     availableNow=True).awaitTermination()

    land(flat[:third])
    run(target)
    land(flat[third:2 * third])
    land(flat[:third // 2])  # delivered again
    run(target)  # goes on from the checkpoint
    compacted = str(tmp_path / "compacted")
    before = rows_of(read_state(spark, target, BY))
    compact_state(spark, target, compacted, BY)
    assert rows_of(read_state(spark, compacted, BY)) == before
    land(flat[2 * third:])
    run(compacted)
    want = rows_of(apply_multi_table(spark.createDataFrame(flat, FEED)))
    assert rows_of(read_state(spark, compacted, BY)) == want and want
    assert seen == sorted(set(seen)) and len(seen) >= 5


def change_rows(spark, changes, path):
    good, _ = split_valid(changes)
    flat = good.select("op", "key", "seq", F.variant_get("after", "$.a", "int").alias("a"))
    (flat.writeStream.format("parquet").option("path", f"{path}/out")
     .option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start()
     .awaitTermination())
    return sorted((r.op, int(r.key), r.a) for r in spark.read.parquet(f"{path}/out").collect())


SHAPE = [KEY, ("a", S.LONG, b"", False, False)]


def test_landed_files(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    for number in (1, 2, 3):
        write_file(logs, number, [table_map(SHAPE),
                                  rows(SHAPE, S.WRITE_ROWS_V1, [[number, number * 10]])])
    got = change_rows(spark, change_stream(spark, str(logs), max_files=1), tmp_path)
    assert got == [("INSERT", n, n * 10) for n in (1, 2, 3)]
    write_file(logs, 4, [table_map(SHAPE), rows(SHAPE, S.DELETE_ROWS_V1, [[4, 40]])])
    got = change_rows(spark, change_stream(spark, str(logs), max_files=1), tmp_path)
    assert got[0] == ("DELETE", 4, None) and len(got) == 4


def test_growing_file(spark, tmp_path):
    """Events are taken once each although the file is cut inside an event, and a table map of
    an earlier batch still applies."""
    logs = tmp_path / "logs"
    logs.mkdir()
    events = [table_map(SHAPE)] + [rows(SHAPE, S.WRITE_ROWS_V1, [[n, n]]) for n in range(1, 7)]
    whole = open(write_file(tmp_path, 1, events), "rb").read()
    growing = logs / P.log_name(1)
    for cut in (len(whole) // 2, len(whole) - 5, len(whole)):
        growing.write_bytes(whole[:cut])
        got = change_rows(spark, change_stream(spark, str(logs), growing=True), tmp_path)
        assert got == [("INSERT", n, n) for n in range(1, len(got) + 1)]
    assert len(got) == 6
    write_file(logs, 2, [table_map(SHAPE), rows(SHAPE, S.WRITE_ROWS_V1, [[7, 7]])])
    got = change_rows(spark, change_stream(spark, str(logs), growing=True), tmp_path)
    assert got == [("INSERT", n, n) for n in range(1, 8)]


def test_broken_end_of_a_closed_file_is_reported_once(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    events = [table_map(SHAPE), rows(SHAPE, S.WRITE_ROWS_V1, [[1, 1]])]
    whole = open(write_file(tmp_path, 1, events), "rb").read()
    (logs / P.log_name(1)).write_bytes(whole[:-3])

    def errors():
        stream = bad_events(binlog_stream(spark, str(logs), growing=True))
        (stream.writeStream.format("parquet").option("path", f"{tmp_path}/out")
         .option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
         .awaitTermination())
        found = spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").collect()
        return [(r.log_file, r.reason) for r in found]

    assert errors() == []  # it may still grow
    write_file(logs, 2, events)
    assert errors() == [(P.log_name(1), "truncated_event")]
    write_file(logs, 3, events)
    assert errors() == [(P.log_name(1), "truncated_event")]


def test_tap(spark):
    seen = Observation("feed")
    df = tap(spark.range(1000), seen, F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    assert df.count() == 1000
    assert seen.get == {"n": 1000, "top": 999}
    assert tap(spark.range(3), "named").count() == 3


def test_target_stays_small(spark, tmp_path):
    """Twelve batches, merged beyond three folders: few folders, and the state of all of them."""
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for n in range(12):
        spark.createDataFrame([(str(n % 5), "INSERT", n, (n,))],
                              "key string, op string, seq bigint, after struct<v: int>") \
            .coalesce(1).write.mode("append").parquet(source)
    stream = (spark.readStream.schema(spark.read.parquet(source).schema)
              .option("maxFilesPerTrigger", "1").parquet(source))
    sizes = []
    apply_stream(stream, target, str(tmp_path / "check"), max_batches=3, rocksdb=False,
                 on_batch=lambda df, i: sizes.append(len(list((tmp_path / "out").iterdir()))),
                 availableNow=True).awaitTermination()
    assert len(sizes) == 12 and max(sizes) <= 14
    got = {r.key: r.v for r in read_state(spark, target).collect()}
    want = {}
    for n in range(12):
        want[str(n % 5)] = n
    assert got == want
    with pytest.raises(FileNotFoundError):
        read_state(spark, str(tmp_path / "none"))


def test_merged_folders_are_not_written_again_each_time(spark, tmp_path):
    """Twenty-five batches, merged beyond two folders: levels of merged folders, few files, and
    the newest row of each key."""
    target = str(tmp_path / "out")
    write = keep_batches(spark, target, ("key",), ("v",), max_batches=2)
    merged, folders = [], []
    for n in range(25):
        write(spark.createDataFrame([(n % 7, n), (100 + n, n)], "key int, v int"), n)
        folders.append(len(list((tmp_path / "out").iterdir())))
        if (tmp_path / "out" / f"base_id={n}").exists():
            merged.append(spark.read.parquet(f"{target}/base_id={n}").count())
    got = {r.key: r.v for r in read_kept(spark, target, ("key",), ("v",)).collect()}
    assert got == {n % 7: n for n in range(25)} | {100 + n: n for n in range(25)}
    assert len(merged) == 8 and sorted(merged)[:5] == [6] * 5 and max(folders) <= 16


def test_state_fills_whole_waves_of_tasks(spark, monkeypatch):
    context, name = type(spark.sparkContext), "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, "40")
    try:
        for cores, partitions in ((1, 16), (4, 16), (6, 12), (12, 12), (24, 24), (64, 40)):
            monkeypatch.setattr(context, "defaultParallelism", cores)
            with state_per_core(spark):
                assert spark.conf.get(name) == str(partitions)
    finally:
        spark.conf.set(name, before)


def test_state_has_a_partition_per_core(spark, tmp_path):
    """Not one per shuffle partition of the session, which keeps its setting."""
    source, name = str(tmp_path / "in"), "spark.sql.shuffle.partitions"
    spark.createDataFrame([(str(n), "INSERT", n, (n,)) for n in range(100)],
                          "key string, op string, seq bigint, after struct<v: int>").write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    before = spark.conf.get(name)
    spark.conf.set(name, "40")
    try:
        apply_stream(stream, str(tmp_path / "out"), str(tmp_path / "check"),
                     availableNow=True).awaitTermination()
        assert spark.conf.get(name) == "40"
    finally:
        spark.conf.set(name, before)
    assert len(list((tmp_path / "check" / "state" / "0").glob("[0-9]*"))) == 16
    assert read_state(spark, str(tmp_path / "out")).count() == 100
