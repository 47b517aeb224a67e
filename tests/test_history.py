"""Folded types over random chains of schema versions, and rows of all versions in one type."""

import decimal
import random
import struct

import pytest
from pyspark.sql import functions as F, types as T

from logs import KEY, rows, table_map, write_file
from tidemark import schemas as S
from tidemark.operators import (
    apply_changes, column_catalog, conform, folded_types, misfits, schema_history, split_valid,
)
from tidemark.sources import folded_targets, read_changes, route_typed, snapshot_scan
from tidemark.sources.binlog import binlog_scan, table_maps

CATALOG = ("database string, table string, file_seq int, byte_off bigint, ordinal int, "
           "name string, type_code int, meta int, unsigned boolean")
WIDTH = {S.TINY: 8, S.SHORT: 16, S.INT24: 24, S.LONG: 32, S.LONGLONG: 64}


def extremes(code, meta, unsigned):
    """Values at the ends of what a logged type holds."""
    if code == S.BOOL:
        return [True, False]
    if code in WIDTH:
        bits = WIDTH[code]
        return [0, 2 ** bits - 1] if unsigned else [-2 ** (bits - 1), 2 ** (bits - 1) - 1]
    if code in (S.FLOAT, S.DOUBLE):
        return [0.5, 16777215.0] if meta == 4 else [0.1, float(2 ** 53 - 1)]
    return ["x", "1"]


def holds(target, value):
    """Whether a Spark type holds a value, by a plain reading of what the type is."""
    if target == "string":
        return True
    if isinstance(value, str):
        return False
    if target == "boolean":
        return isinstance(value, bool)
    whole = {"tinyint": 7, "smallint": 15, "int": 31, "bigint": 63}
    if target in whole:
        return not isinstance(value, float) and -2 ** whole[target] <= value < 2 ** whole[target]
    if target == "decimal(20,0)":
        return not isinstance(value, float) and abs(value) < 10 ** 20
    if target == "float":
        return struct.unpack("<f", struct.pack("<f", value))[0] == value
    return float(value) == value


def random_chains(n):
    draw = random.Random(3)
    kinds = [S.BOOL, *WIDTH, S.FLOAT, S.DOUBLE, S.VARCHAR, S.STRING]
    made = []
    for t in range(n):
        some = draw.sample(kinds, draw.randint(1, 4))
        for version in range(draw.randint(1, 5)):
            names = draw.sample("abcd", draw.randint(1, 4))
            for ordinal, name in enumerate(names):
                made.append(("d", f"t{t}", version // 2, version * 100, ordinal, name,
                             draw.choice(some), draw.choice([4, 8]), draw.random() < 0.5))
    return made


def test_folded_types_hold_every_version(spark):
    chains = random_chains(300)
    found = {(r.table, r.name): r
             for r in schema_history(spark.createDataFrame(chains, CATALOG)).collect()}
    columns = {}
    for row in chains:
        columns.setdefault((row[1], row[5]), []).append(row)
    assert set(found) == set(columns)
    narrow = ["boolean", "tinyint", "smallint", "int", "bigint", "decimal(20,0)"]
    for place, logged in columns.items():
        got, place_of = found[place], {(r[2], r[3]) for r in chains if r[1] == place[0]}
        values = [v for r in logged for v in extremes(*r[6:9])]
        assert all(holds(got.data_type, v) for v in values), (got, logged)
        if got.data_type in narrow[1:]:  # and no narrower whole number does
            less = narrow[narrow.index(got.data_type) - 1]
            assert not all(holds(less, v) for v in values)
        here = {(r[2], r[3]) for r in logged}
        assert (got.n_maps, got.of_maps) == (len(here), len(place_of))
        assert got.added == (min(place_of) not in here) and got.dropped == (max(place_of) not in here)
        assert got.ordinal == max(logged, key=lambda r: (r[2], r[3]))[4]
        text = [r[6] in (S.VARCHAR, S.STRING) for r in logged]
        assert got.reason == ("mixed_kinds" if got.data_type == "string" and not all(text) else None)


def test_fold_is_the_same_in_any_order_and_for_repeated_versions(spark):
    chains = random_chains(40)
    def types(data):
        return {(r.table, r.name): (r.data_type, r.types) for r in schema_history(
            spark.createDataFrame(data, CATALOG).repartition(7)).collect()}
    assert types(chains) == types(chains[::-1] + chains[::3])


def test_unsupported_and_empty(spark):
    data = [("d", "t", 0, 0, 0, "a", S.LONG, None, None), ("d", "t", 0, 9, 0, "a", 252, 2, False),
            ("d", "t", 0, 9, 1, "b", S.TINY, None, None)]
    history = schema_history(spark.createDataFrame(data, CATALOG))
    assert [(r.name, r.data_type, r.types, r.reason) for r in misfits(history).collect()] == [
        ("a", None, ["int"], "unsupported_type")]
    assert folded_types(history) == {("d", "t"): T.StructType([T.StructField("b", T.ByteType())])}
    assert schema_history(spark.createDataFrame([], CATALOG)).count() == 0


VERSIONS = [
    ([KEY, ("a", S.TINY, b"", False, False), ("f", S.FLOAT, b"\x04", False, False),
      ("old", S.BOOL, b"", False, False)], (1, -128, 0.5, 1)),
    ([KEY, ("f", S.SHORT, b"", False, False), ("a", S.LONG, b"", True, False)],
     (2, -32768, 2 ** 32 - 1)),
    ([KEY, ("a", S.LONGLONG, b"", True, False), ("f", S.DOUBLE, b"\x08", False, False),
      ("new", S.VARCHAR, struct.pack("<H", 40), False, False)], (3, 2 ** 64 - 1, 0.1, "x")),
    ([KEY, ("a", S.SHORT, b"", False, False), ("new", S.LONG, b"", False, False)], (4, 7, -5)),
]


@pytest.fixture(scope="module")
def versions(tmp_path_factory):
    """A log of one table whose columns widen, come and go, a file for each version."""
    folder = tmp_path_factory.mktemp("versions")
    for n, (columns, values) in enumerate(VERSIONS):
        write_file(folder, n + 1, [table_map(columns), rows(columns, S.WRITE_ROWS_V1, [values])])
    return str(folder)


def test_rows_of_all_versions_read_with_the_folded_type(spark, versions):
    history = schema_history(column_catalog(table_maps(binlog_scan(spark, versions))))
    row = folded_types(history)["d", "t"]
    assert [(f.name, f.dataType.simpleString()) for f in row] == [
        ("_id", "decimal(20,0)"), ("a", "decimal(20,0)"), ("new", "string"), ("f", "double"),
        ("old", "boolean")]
    assert [r.name for r in misfits(history).collect()] == ["new"]
    good, bad = split_valid(read_changes(spark, versions, row, "d", "t"))
    assert bad.count() == 0
    got = [(r.a, r.new, r.f, r.old) for r in apply_changes(good).orderBy("key").collect()]
    assert got == [(decimal.Decimal(-128), None, 0.5, True),
                   (decimal.Decimal(2 ** 32 - 1), None, -32768.0, None),
                   (decimal.Decimal(2 ** 64 - 1), "x", 0.1, None),
                   (decimal.Decimal(7), "-5", None, None)]


def test_documents_of_all_versions_get_the_folded_type(spark, versions, tmp_path):
    targets = folded_targets(schema_history(column_catalog(table_maps(
        binlog_scan(spark, versions)))))
    good, _ = split_valid(read_changes(spark, versions))
    route_typed(good, targets, str(tmp_path), prefix="history_")
    got = [(r.a, r.new, r.f, r.old)
           for r in snapshot_scan(spark, "history_d", "t").orderBy("key").collect()]
    spark.sql("DROP DATABASE history_d CASCADE")
    assert got == [(decimal.Decimal(-128), None, 0.5, True),
                   (decimal.Decimal(2 ** 32 - 1), None, -32768.0, None),
                   (decimal.Decimal(2 ** 64 - 1), "x", 0.1, None),
                   (decimal.Decimal(7), "-5", None, None)]


def test_booleans_beside_other_kinds_in_a_log(spark, tmp_path):
    for n, (kind, value) in enumerate([(S.BOOL, 1), (S.LONGLONG, 2 ** 64 - 1)]):
        columns = [KEY, ("a", kind, b"", True, False)]
        write_file(tmp_path, n + 1, [
            table_map(columns), rows(columns, S.WRITE_ROWS_V1, [(n, value)])])
    row = folded_types(schema_history(column_catalog(table_maps(
        binlog_scan(spark, str(tmp_path))))))["d", "t"]
    changes = read_changes(spark, str(tmp_path), row, "d", "t")
    assert [(r.reason, r.a) for r in changes.orderBy("key").select("reason", "after.a").collect()] \
        == [(None, decimal.Decimal(1)), (None, decimal.Decimal(2 ** 64 - 1))]


def test_conform(spark):
    target = T.StructType.fromDDL("a bigint, b string, c double")
    assert [tuple(r) for r in conform(spark.sql("SELECT 2S AS c, 1Y AS a"), target).collect()] == [
        (1, None, 2.0)]
    with pytest.raises(ValueError, match="z"):
        conform(spark.range(1).select(F.lit(1).alias("z")), target)
