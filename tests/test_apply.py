"""Applying changes: order-free aggregate against sequential replay written out here."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark import schemas as S
from tidemark.operators import (
    apply_changes, apply_deletes, apply_inserts, apply_multi_table, apply_updates, carry_last,
    change_metrics, live_row_timeline, running_total, state_as_of,
)

FEED = (StructType().add("database", "string").add("table", "string").add("key", "string")
        .add("op", "string").add("seq", "long")
        .add("after", StructType().add("a", "integer").add("b", "string")))


def random_feed(rng, keys=3, size=12, case="t"):
    """Distinct positions in random gaps; images may hold NULLs."""
    seqs = sorted(rng.sample(range(4 * size), size))
    out = []
    for seq in seqs:
        op = rng.choice([S.INSERT, S.UPDATE, S.UPDATE, S.DELETE])
        image = None if op == S.DELETE else (
            rng.choice([None, rng.randrange(9)]), rng.choice([None, "x", "y"]))
        out.append(("d", case, f"k{rng.randrange(keys)}", op, seq, image))
    return out


def replay(feed, state=None):
    rows = dict(state or {})
    for _, table, key, op, seq, image in sorted(feed, key=lambda r: r[4]):
        at = (table, key)
        if op == S.INSERT or (op == S.UPDATE and at in rows):
            rows[at] = (*image, seq)
        elif op == S.DELETE:
            rows.pop(at, None)
    return rows


def cases(n=150, seed=1, **kwargs):
    rng = random.Random(seed)
    return rng, [random_feed(rng, case=f"t{i}", **kwargs) for i in range(n)]


def rows_of(df):
    return {(r.table, r.key): (r.a, r.b, r.last_seq) for r in df.collect()}


@pytest.mark.parametrize("strategy", ["aggregate", "join_back"])
def test_equals_replay_shuffled_and_repeated(spark, strategy):
    rng, feeds = cases()
    flat = [r for f in feeds for r in f]
    messy = flat + rng.sample(flat, len(flat) // 3)
    rng.shuffle(messy)
    df = spark.createDataFrame(messy, FEED).repartition(7)
    want = {}
    for feed in feeds:
        want.update(replay(feed))
    assert rows_of(apply_multi_table(df, strategy)) == want


def test_state_plus_rest_equals_all(spark):
    _, feeds = cases(100, seed=2)
    flat = [r for f in feeds for r in f]
    df = spark.createDataFrame(flat, FEED)
    by, cut = ("database", "table", "key"), 20
    state = apply_changes(df.filter(F.col("seq") <= cut), by=by)
    # Everything is delivered again: what is at or below the high-water mark must not count.
    assert rows_of(apply_changes(df, state, high_water=cut, by=by)) == rows_of(
        apply_changes(df, by=by))


def test_state_as_of(spark):
    _, feeds = cases(60, seed=3)
    df = spark.createDataFrame([r for f in feeds for r in f], FEED)
    want = {}
    for feed in feeds:
        want.update(replay([r for r in feed if r[4] <= 25]))
    assert rows_of(state_as_of(df, 25, by=("database", "table", "key"))) == want


def test_single_operation_operators(spark):
    state = spark.createDataFrame(
        [("k1", 1, "x", 5), ("k2", 2, "y", 5)], "key string, a int, b string, last_seq bigint")
    changes = spark.createDataFrame([
        ("d", "t", "k1", S.UPDATE, 8, (None, "late")), ("d", "t", "k1", S.UPDATE, 7, (9, "early")),
        ("d", "t", "k9", S.UPDATE, 7, (9, "none")), ("d", "t", "k2", S.DELETE, 9, None),
        ("d", "t", "k2", S.DELETE, 10, None), ("d", "t", "k3", S.INSERT, 11, (3, None)),
        ("d", "t", "k3", S.INSERT, 12, (4, None))], FEED)

    def got(df):
        return sorted((r.key, r.a, r.b, r.last_seq) for r in df.collect())

    assert got(apply_inserts(state, changes)) == [
        ("k1", 1, "x", 5), ("k2", 2, "y", 5), ("k3", 4, None, 12)]
    assert got(apply_deletes(state, changes)) == [("k1", 1, "x", 5)]
    assert got(apply_updates(state, changes)) == [("k1", None, "late", 8), ("k2", 2, "y", 5)]


@pytest.mark.parametrize("bits", [1, 3, 18])
def test_carry_last(spark, bits):
    rng = random.Random(bits)
    rows = [(f"g{rng.randrange(3)}", s, rng.choice([None, s])) for s in rng.sample(range(400), 120)]
    df = spark.createDataFrame(rows, "g string, s bigint, v bigint").repartition(5)
    df = carry_last(df, ["g"], "s", F.col("v"), "upto", bits=bits)
    df = carry_last(df, ["g"], "s", F.col("v"), "before", strict=True, bits=bits, levels=3)
    df = carry_last(df, ["g"], "s", F.col("v"), "whole", bits=None)
    for g, s, v, upto, before, whole in df.collect():
        assert whole == upto
        seen = [(t, w) for h, t, w in rows if h == g and w is not None]
        assert upto == max((w for t, w in seen if t <= s), default=None)
        assert before == max((w for t, w in seen if t < s), default=None)


@pytest.mark.parametrize("bits", [1, 2, 18])
def test_running_total(spark, bits):
    rng = random.Random(bits)
    rows = [(s, rng.randrange(-3, 4)) for s in rng.sample(range(300), 100)]
    df = running_total(spark.createDataFrame(rows, "s bigint, d bigint"), "s", F.col("d"), "total",
                       bits=bits)
    for s, _, total in df.collect():
        assert total == sum(d for t, d in rows if t <= s)


@pytest.mark.parametrize("bits", [2, 18])
def test_timeline_and_metrics(spark, bits):
    rng = random.Random(5)
    feed = random_feed(rng, keys=4, size=80)
    df = spark.createDataFrame(feed, FEED)
    live, want, counts = set(), {}, {}
    for _, _, key, op, seq, _ in sorted(feed, key=lambda r: r[4]):
        count = counts.setdefault(op, [0, 0, 0])
        count[0] += 1
        count[1] += op == S.INSERT and key in live
        count[2] += op != S.INSERT and key not in live
        live = live | {key} if op == S.INSERT else live - {key} if op == S.DELETE else live
        want[seq] = len(live)
    assert {r.seq: r.live_rows for r in live_row_timeline(df, bits=bits).collect()} == want
    assert {r.op: [r.n_changes, r.duplicate_inserts, r.missing_key_changes]
            for r in change_metrics(df, bits=bits).collect()} == counts


def test_hot_key_is_reduced_before_the_shuffle(spark):
    """A key with a third of all rows: the exchange carries one row per key and input task."""
    rows = spark.range(0, 90_000, numPartitions=6).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7))
        .alias("key"), F.when(F.col("id") < 100, S.INSERT).otherwise(S.UPDATE).alias("op"),
        F.col("id").alias("seq"), F.struct(F.col("id").alias("a")).alias("after"))
    state = apply_changes(rows)
    assert {r.key: r.a for r in state.collect()}["hot"] == 89_997
    plan = state._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("partial_max_by") == 1
