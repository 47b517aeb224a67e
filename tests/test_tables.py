"""Targets, key rules, casts and the scratch folder."""

import decimal

import pytest
from pyspark.sql import functions as F

from tidemark import schemas as S
from tidemark.functions import (
    build_document, cast_columns, char_pad, document_field, format_key, int24_sign, null_mask,
)
from tidemark.operators import reject_types, split_valid, unmatched_rows, validate_key
from tidemark.sources import tables
from tidemark.sources.scratch import new_path, shared_folder

MIXED = ("database string, table string, key string, op string, seq bigint, "
         "after struct<a: int, b: string>")


def mixed(spark):
    return spark.createDataFrame([
        ("d1", "t", "k1", S.INSERT, 1, (1, "x")), ("d1", "t", "k1", S.UPDATE, 2, (2, None)),
        ("d1", "u", "k1", S.INSERT, 3, (3, "y")), ("d2", "t", "k1", S.INSERT, 4, (4, "z")),
        ("d2", "t", "k1", S.DELETE, 5, None)], MIXED)


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert new_path(spark, "x").startswith(shared_folder(spark) + "/x-")


def test_route_and_typed_targets(spark, tmp_path):
    root = str(tmp_path / "feed")
    tables.route_changes(mixed(spark).select(
        "database", "table", "key", "op", "seq", build_document("after.*").alias("after")), root)
    tables.route_changes(mixed(spark).limit(0).select(
        "database", "table", "key", "op", "seq", build_document("after.*").alias("after")), root)
    routed = spark.read.parquet(root)
    counts = {(r.database, r.table): r["count"]
              for r in routed.groupBy("database", "table").count().collect()}
    assert counts == {("d1", "t"): 2, ("d1", "u"): 1, ("d2", "t"): 2}
    typed = [document_field("after", "a", "int").alias("a"),
             document_field("after", "b", "string").alias("b")]
    tables.route_typed(routed, {k: typed for k in counts}, str(tmp_path / "targets"))
    assert [tuple(r) for r in tables.snapshot_scan(spark, "d1", "t").collect()] == [
        ("k1", 2, None, 2)]
    assert [tuple(r) for r in tables.snapshot_scan(spark, "d1", "u").collect()] == [
        ("k1", 3, "y", 3)]
    assert tables.snapshot_scan(spark, "d2", "t").count() == 0
    assert spark.catalog.tableExists("d2.t")
    for database in ("d1", "d2"):
        spark.sql(f"DROP DATABASE {database} CASCADE")


def test_refresh_lookup_json(spark, tmp_path):
    feed = mixed(spark).filter("database = 'd1' AND table = 't'")
    path = str(tmp_path / "state")
    tables.full_refresh(feed, path)
    state = tables.full_refresh(feed, path)  # a second refresh replaces the first
    assert [tuple(r) for r in tables.key_lookup(state, "k1").collect()] == [("k1", 2, None, 2)]
    assert tables.key_lookup(state, "' OR 1=1 --").count() == 0
    assert tables.state_to_json(state).first().doc == '{"key":"k1","a":2,"b":null,"last_seq":2}'


def test_scalar_functions(spark):
    row = spark.sql("SELECT 18446744073709551615bd AS big, 12 AS small, 8388607 AS top, "
                    "8388608 AS neg, 16777215 AS last, 5 AS mask, 'né' AS text").select(
        format_key("big"), format_key("small"), int24_sign("top"), int24_sign("neg"),
        int24_sign("last"), null_mask("mask", 3), char_pad("text", 4)).first()
    assert tuple(row) == ("000018446744073709551615", "12".rjust(24, "0"), 8388607, -8388608, -1,
                          [True, False, True], "né  ")


def test_cast_columns(spark):
    text = ["-129", "-128", "127", "128", "255", "256", "1.5", " 7 ", "", None, "x"]
    df = spark.createDataFrame([(t, t, t) for t in text], "s string, u string, f string")
    typed = cast_columns(df, [
        {"name": "s", "type_code": S.TINY}, {"name": "u", "type_code": S.TINY, "unsigned": True},
        {"name": "f", "type_code": S.DOUBLE, "meta": 8}])
    assert [f.dataType.simpleString() for f in typed.schema] == ["tinyint", "smallint", "double"]
    got = [tuple(r) for r in typed.collect()]
    assert [r[0] for r in got] == [None, -128, 127] + [None] * 4 + [7, None, None, None]
    assert [r[1] for r in got] == [None, None, 127, 128, 255, None, None, 7, None, None, None]
    assert [r[2] for r in got][6:] == [1.5, 7.0, None, None, None]
    big = spark.createDataFrame([('{"n": 18446744073709551615, "c": "ab", "y": 1}',)], "doc string")
    row = cast_columns(big, [
        {"name": "n", "type_code": S.LONGLONG, "unsigned": True},
        {"name": "c", "type_code": S.STRING, "meta": (16 << 8) | S.STRING},
        {"name": "y", "type_code": S.BOOL}], source="doc").drop("doc").first()
    assert tuple(row) == (decimal.Decimal(2 ** 64 - 1), "ab  ", True)


def test_validate_key(spark):
    df = spark.createDataFrame([
        (["_id"], 7, 8, True), ([], 7, 8, True), (None, 7, 8, True), (["_id", "b"], 7, 8, True),
        (["id"], 7, 8, True), (["_id"], None, 8, True), (["_id"], 7, 3, True),
        (["_id"], 7, 8, False)],
        "pk_names array<string>, key_value bigint, pk_type int, pk_unsigned boolean")
    assert [r.reason for r in validate_key(df).collect()] == [
        None, "primary_key_count", "primary_key_count", "primary_key_count", "primary_key_name",
        "null_key", "key_type", "key_type"]
    good, bad = split_valid(validate_key(df))
    assert [r.key for r in good.collect()] == ["7".rjust(24, "0")] and bad.count() == 7
    assert validate_key(df, expected="id").filter("reason is null").count() == 1
    with pytest.raises(Exception, match="bad key: "):
        validate_key(df, strict=True).collect()


def test_strict_unmatched_rows(spark):
    paired = spark.createDataFrame([(1, "s"), (2, None)], "seq bigint, schema string")
    assert [(r.seq, r.reason) for r in unmatched_rows(paired).collect()] == [(2, "no_schema")]
    with pytest.raises(Exception, match="without an earlier table map"):
        unmatched_rows(paired, strict=True).collect()


def test_reject_types(spark):
    codes = spark.range(256).select(F.col("id").cast("int").alias("type_code"))
    assert codes.count() - reject_types(codes).count() == len(S.ACCEPTED_TYPES) == 10


def test_clean_removes_what_queries_made(spark, tmp_path, monkeypatch):
    from tidemark.sources import scratch
    monkeypatch.setattr(scratch, "_made", [])
    path = scratch.new_path(spark, "x")
    spark.range(3).write.parquet(path)
    spark.sql("CREATE DATABASE tidemark_test_of_clean")
    scratch.clean(spark)
    assert scratch._made == []
    assert "tidemark_test_of_clean" not in [d.name for d in spark.catalog.listDatabases()]
    with pytest.raises(Exception):
        spark.read.parquet(path)
