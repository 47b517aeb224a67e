"""Metrics of a stream equal those of the whole feed; observed totals and sketches are kept."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark import schemas as S
from tidemark.operators import change_metrics, tap
from tidemark.operators.sketches import (
    key_sketches, merge_key_sketches, read_key_sketches, write_key_sketches,
)
from tidemark.streaming import ObservedTotals, read_metrics, read_observed, stream_metrics

FEED = "database string, table string, key string, op string, seq bigint"


def feed(seed, n, keys):
    rng = random.Random(seed)
    # Key 0 holds about a third of all changes.
    return [("d", rng.choice(("t", "u")), "0" if rng.random() < 1 / 3 else str(rng.randrange(keys)),
             rng.choice((S.INSERT, S.UPDATE, S.UPDATE, S.DELETE)), seq * 3) for seq in range(n)]


def plain(rows):
    """(changes, duplicate INSERTs, changes of missing keys) per table and op, one by one."""
    live, n = {}, Counter()
    for _, table, key, op, _ in sorted(rows, key=lambda r: r[4]):
        was = live.get((table, key), False)
        n[table, op, 0] += 1
        n[table, op, 1] += op == S.INSERT and was
        n[table, op, 2] += op != S.INSERT and not was
        if op != S.UPDATE:
            live[table, key] = op == S.INSERT
    return {(t, o): tuple(n[t, o, i] for i in range(3)) for t, o, _ in n}


def totals(df):
    return {(r.table, r.op): (r.n_changes, r.duplicate_inserts, r.missing_key_changes)
            for r in df.collect()}


@pytest.mark.parametrize("bits", [2, 5, 14])
def test_stream_metrics_of_shuffled_and_repeated_changes(spark, tmp_path, bits):
    rows = feed(bits, 400, 12)
    want = plain(rows)
    assert totals(change_metrics(spark.createDataFrame(rows, FEED))) == want
    source, target, check = (str(tmp_path / d) for d in ("in", "out", "check"))
    mixed = rows + random.Random(1).sample(rows, 150)
    random.Random(2).shuffle(mixed)
    mixed += [("d", "t", "1", S.UPDATE, None), ("d", "t", "1", "OTHER", 5)]
    seen = []

    def run():
        stream = spark.readStream.schema(FEED).option("maxFilesPerTrigger", "1").parquet(source)
        stream_metrics(stream, target, check, bits=bits, max_batches=3,
                       on_batch=lambda df, i: seen.append(i), availableNow=True).awaitTermination()

    for part in (mixed[:200], mixed[200:]):  # with a restart between
        spark.createDataFrame(part, FEED).repartition(3).write.mode("append").parquet(source)
        run()
    assert totals(read_metrics(spark, target)) == want
    assert seen == sorted(set(seen)) and len(seen) >= 4


def test_observed_totals_are_kept_over_a_restart(spark, tmp_path):
    source, kept, check = (str(tmp_path / d) for d in ("in", "kept", "check"))
    listener = ObservedTotals(spark, kept, max_batches=2)
    spark.streams.addListener(listener)
    try:
        for at in (0, 50):
            spark.range(at, at + 50).selectExpr("id", "cast(id AS decimal(20, 2)) / 4 AS x") \
                .repartition(3).write.mode("append").parquet(source)
            stream = spark.readStream.schema("id bigint, x decimal(24,6)").option(
                "maxFilesPerTrigger", "1").parquet(source)
            query = (tap(stream, "seen", F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))
                     .writeStream.format("noop").option("checkpointLocation", check)
                     .trigger(availableNow=True).start())
            query.awaitTermination()
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    found = read_observed(spark, kept, query.id).collect()
    assert {r.name for r in found} == {"seen"}
    assert len({r.batch for r in found}) >= 4
    assert sum(int(r.value) for r in found if r.metric == "n") == 100
    assert sum(int(r.value or 0) for r in found if r.metric == "ids") == sum(range(100))


def test_sketches_merge_to_those_of_all_files(spark, tmp_path):
    rows = [(d, t, k, op, (1 + i % 4 << 32) + i) for i, (d, t, k, op, _)
            in enumerate(feed(3, 6000, 2500))] + [("d", "t", None, S.UPDATE, (2 << 32) + 9)]
    changes = spark.createDataFrame(rows, FEED)
    path = str(tmp_path / "sketches")
    write_key_sketches(changes, path)
    write_key_sketches(changes.filter("seq >> 32 = 3"), path)  # a file scanned again
    stored = spark.read.parquet(path)
    groups = {(r[4] >> 32, r[1], r[3]) for r in rows}
    assert stored.count() == len(groups)
    got = {(r.table, r.op): r for r in read_key_sketches(spark, path, top=1).collect()}
    for (table, op), r in got.items():
        mine = [x[2] for x in rows if x[1] == table and x[3] == op]
        distinct = len({k for k in mine if k is not None})
        assert r.n_changes == len(mine)
        assert abs(r.distinct_keys - distinct) <= 0.05 * distinct
        assert r.top_keys[0].item == "0"
        # Tracked keys are fewer than keys: an estimate is off by at most 3.5 changes a thousand.
        assert abs(r.top_keys[0]["count"] - mine.count("0")) <= max(1, 0.0035 * len(mine))
    assert {(r.table, r.op) for r in merge_key_sketches(key_sketches(changes)).collect()} == set(got)
    assert read_key_sketches(spark, path).filter("database = 'x'").count() == 0


def test_state_of_metrics_has_a_partition_per_core(spark, tmp_path):
    source, name = str(tmp_path / "in"), "spark.sql.shuffle.partitions"
    rows = feed(7, 100, 9)
    spark.createDataFrame(rows, FEED).write.parquet(source)
    before = spark.conf.get(name)
    spark.conf.set(name, "40")
    try:
        stream_metrics(spark.readStream.schema(FEED).parquet(source), str(tmp_path / "out"),
                       str(tmp_path / "check"), availableNow=True).awaitTermination()
    finally:
        spark.conf.set(name, before)
    assert len(list((tmp_path / "check" / "state" / "0").glob("[0-9]*"))) == 16
    assert totals(read_metrics(spark, str(tmp_path / "out"))) == plain(rows)
