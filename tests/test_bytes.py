"""Literal event bytes, and logs with everything a decoder can meet."""

import datetime
import decimal
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from logs import KEY, rows, table_map, write_file
from tidemark import schemas as S
from tidemark.operators import (
    apply_changes, column_catalog, format_events, rotate_events, schema_asof, split_valid,
)
from tidemark.plans import packing as P
from tidemark.sources import codec
from tidemark.sources.binlog import (
    bad_events, binlog_scan, build_changes, decode_rows, read_changes, table_maps, table_row_type,
    tables_row_type,
)

# ---- fixed values: recorded events, one line per field ------------------------------------
FORMAT = bytes.fromhex(
    "c9e44168"  # when
    "0f"  # type
    "01000000"  # server id
    "fc000000"  # size
    "00010000"  # end position
    "0000"  # flags
    "0400"  # version
    "31312e342e352d4d6172696144422d756275323430342d6c6f"
    "67000000000000000000000000000000000000000000000000"  # server version, 50 bytes
    "c9e44168"  # created
    "13"  # header length
    "380d000800120004040404120000e400041a08000000080808020000000a0a0a"
    "0000000000000a0a0a0000000000000000000000000000000000000000000000"
    "0000000000000000000000000000000000000000000000000000000000000000"
    "0000000000000000000000000000000000000000000000000000000000000000"
    "0000000000000000000000000000000000000000000000000000000000000000"
    "00041304000d08080a0a0a"  # header lengths by type
    "00"  # checksum algorithm
    "bff4eac1"  # checksum
)
ROTATE = bytes.fromhex(
    "01010101"  # when
    "04"  # type
    "05000000"  # server id
    "2b000000"  # size
    "01200340"  # end position
    "2000"  # flags
    "0400000100000000"  # next position
    "6d7973716c2d62696e2e303030313231"  # next file
)
TABLE_MAP = bytes.fromhex(
    "590e4268"  # when
    "13"  # type
    "010a0000"  # server id
    "49000000"  # size
    "00000000"  # end position
    "0000"  # flags
    "1200000000ff"  # table id
    "0100"  # flags
    "07"  # database length
    "655f73746f7265"  # database
    "00"  # end of name
    "06"  # table length
    "6272616e6473"  # table
    "00"  # end of name
    "02"  # column count
    "080f"  # column types
    "02"  # metadata length
    "e803"  # metadata
    "00"  # null bits
    "010180"  # field 1: signedness
    "0203fc0009"  # field 2: character set
    "0409035f6964046e616d65"  # field 4: column names
    "080100"  # field 8: primary key
)
WRITE_ROWS = bytes.fromhex(
    "590e4268"  # when
    "17"  # type
    "010a0b0c"  # server id
    "2f000000"  # size
    "05000000"  # end position
    "0000"  # flags
    "120a0102030f"  # table id
    "0100"  # flags
    "02"  # column count
    "03"  # columns present
    "fc"  # null bits
    "0100000000000000"  # first column
    "0700"  # length of the second
    "53616d73756e67"  # second column
)
# --------------------------------------------------------------------------------------------


def one_event(data):
    return next(codec.split_events([data], magic=False))


def test_format_event():
    _, head, body = one_event(FORMAT)
    assert len(FORMAT) == 252
    assert head == (1749148873, 15, 1, 252, 256, 0)
    version, server, created, header_bytes = struct.unpack_from("<H50sIB", body)
    assert (version, created, header_bytes) == (4, 1749148873, 19)
    assert server.rstrip(b"\0") == b"11.4.5-MariaDB-ubu2404-log"
    state = codec.LogState()
    assert state.format(body) is None
    assert not state.checksum  # the algorithm byte says off
    assert (state.map_id_bytes, state.rows_id_bytes) == (6, 6)


def test_rotate_event():
    _, head, body = one_event(ROTATE)
    assert head == (16843009, 4, 5, 43, 1073946625, 32)
    assert struct.unpack_from("<Q", body)[0] == 16777220
    assert body[8:] == b"mysql-bin.000121"


def test_rotate_and_format_columns(spark, tmp_path):
    (tmp_path / "bare.000001").write_bytes(FORMAT + ROTATE)
    events = binlog_scan(spark, str(tmp_path), magic=False)
    row = rotate_events(events).first()
    assert (row.next_file, row.next_pos) == ("mysql-bin.000121", 16777220)
    row = format_events(events).first()
    assert (row.log_version, row.server_version, row.created, row.header_length, row.checksum) == (
        4, "11.4.5-MariaDB-ubu2404-log", 1749148873, 19, 0)
    assert row.header_lengths[:4] == [56, 13, 0, 8] and len(row.header_lengths) == 171


def test_table_map_event():
    _, head, body = one_event(TABLE_MAP)
    assert head == (1749159513, 19, 2561, 73, 0, 0)
    found = codec.parse_table_map(body)
    assert found["table_id"] == 280375465082898
    assert (found["database"], found["table"]) == ("e_store", "brands")
    assert found["type_codes"] == [8, 15] and found["metas"] == [0, 1000]
    assert found["names"] == ["_id", "name"] and found["pk"] == [0]
    assert found["signedness"][0] and codec.unsigned_flags(found) == [True, False]


def test_write_rows_event():
    _, head, body = one_event(WRITE_ROWS)
    assert head == (1749159513, 23, 202050049, 47, 5, 0)
    assert int.from_bytes(body[:6], "little") == 16505592941074
    buf, event, offset, sides, reason = codec.read_images(
        [body], [(S.LONGLONG, 0, True), (S.VARCHAR, 1000, False)], 23, 6)
    (key, key_nulls), (name, name_nulls) = sides[0]
    assert key.tolist() == [1] and not key_nulls.any() and not name_nulls.any()
    assert codec.arrow_column(buf, name, name_nulls, S.VARCHAR, 1000).to_pylist() == ["Samsung"]
    assert reason.tolist() == [None] and offset.tolist() == [10]


def test_bare_event_stream(spark, tmp_path):
    (tmp_path / "bare.000001").write_bytes(ROTATE + TABLE_MAP)
    for reader in ("stream", "binaryFile"):
        events = binlog_scan(spark, str(tmp_path), reader, magic=False)
        assert [r.type_code for r in events.orderBy("byte_off").collect()] == [4, 19]


# ---- fixed values: the end-to-end scenario --------------------------------------------------

STORE = [
    KEY, ("s_tinyint", S.TINY, b"", False, False), ("s_smallint", S.SHORT, b"", False, False),
    ("s_medium", S.INT24, b"", False, False), ("s_int", S.LONG, b"", False, False),
    ("s_bigint", S.LONGLONG, b"", False, False), ("double", S.DOUBLE, b"\x08", False, False),
    ("bool", S.TINY, b"", False, False),
    ("small_varchar", S.VARCHAR, struct.pack("<H", 80), False, False),
    ("big_varchar", S.VARCHAR, struct.pack("<H", 1200), False, False),
    ("char", S.STRING, bytes([S.STRING, 64]), False, False),
]
FIRST = [
    [1, -128, -32768, -8388608, -2147483648, -9223372036854775808, -1.7e308, 0, "min", "minimal",
     "char_min"],
    [2, 127, 32767, 8388607, 2147483647, 9223372036854775807, 1.7e308, 1, "max",
     "maximal value test string", "char_max"],
    [3, 0, 0, 0, 0, 0, 0.0, 0, "", "", ""],
    [4, -1, -1, -1, -1, -1, 0.5, 1, "neg1", "negative 1", "neg"],
    [5, 64, 1024, 2048, 65536, 999999999, 9.9, 0, "val", "value mid", "mid_val"],
    [6, 100, 300, 500, 700, 900, 0.0000001, 1, "a", "b", "c"],
]
SIXTH = [6, 100, 300, 500, 700, 900, 0.12345, 0, "upd", "b", "c"]
SEVENTH = [7, 42, 1024, 123456, 1000000, 1234567890123456, 2.718281828, 1, "test",
           "arbitrary data", "test_string"]
# --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("checksum", [False, True])
def test_golden_state(spark, tmp_path, checksum):
    schema = table_map(STORE, database="e_store", table="table")
    write_file(tmp_path, 1, [schema, rows(STORE, S.WRITE_ROWS_V1, FIRST),
                             rows(STORE, S.UPDATE_ROWS_V1, [FIRST[5], SIXTH])], checksum)
    write_file(tmp_path, 2, [schema, rows(STORE, S.DELETE_ROWS_V1, [FIRST[4]]),
                             rows(STORE, S.WRITE_ROWS_V1, [SEVENTH])], checksum)
    maps = table_maps(binlog_scan(spark, str(tmp_path), codes=(S.TABLE_MAP_EVENT,)))
    shape = table_row_type(maps, "e_store", "table")
    with pytest.raises(LookupError):
        table_row_type(maps, "e_store", "other")
    assert [f.dataType.simpleString() for f in shape] == [
        "decimal(20,0)", "tinyint", "smallint", "int", "int", "bigint", "double", "tinyint",
        "string", "string", "string"]
    changes, bad = split_valid(read_changes(spark, str(tmp_path), shape, "e_store", "table"))
    assert bad.count() == 0
    got = {int(r.key): list(r)[1:-1] for r in apply_changes(changes).collect()}
    want = {v[0]: v[1:-1] + [v[-1].ljust(16)] for v in FIRST[:4] + [SIXTH, SEVENTH]}
    assert got == want
    assert {len(r.key) for r in apply_changes(changes).collect()} == {24}


# ---- what the recorded events do not cover -------------------------------------------------

WIDE = [
    KEY, ("t", S.TINY, b"", True, False), ("name", S.VARCHAR, struct.pack("<H", 100), False, False),
    ("s", S.SHORT, b"", True, False), ("m", S.INT24, b"", True, False),
    ("l", S.LONG, b"", True, False), ("b", S.LONGLONG, b"", True, False),
    ("f", S.FLOAT, b"\x04", False, False), ("yes", S.BOOL, b"", False, False),
    ("c", S.STRING, bytes([S.STRING, 16]), False, False), ("last", S.SHORT, b"", False, False),
]
FULL = [2 ** 64 - 1, 255, "naïve", 65535, 16777215, 2 ** 32 - 1, 2 ** 64 - 2, 1.5, True, "é", -2]
EMPTY = [5] + [None] * 9 + [-3]


def shape_of(spark, folder, table="t"):
    return table_row_type(table_maps(binlog_scan(spark, str(folder))), "d", table)


def test_nulls_unsigned_multibyte_and_reused_map(spark, tmp_path):
    write_file(tmp_path, 1, [
        table_map(WIDE), rows(WIDE, S.WRITE_ROWS_V1, [FULL, EMPTY]),
        rows(WIDE, S.DELETE_ROWS_V1, [EMPTY]),
        rows(WIDE, S.UPDATE_ROWS_V1, [FULL, [2 ** 64 - 1] + EMPTY[1:]])])
    images = decode_rows(binlog_scan(spark, str(tmp_path)), shape_of(spark, tmp_path))
    got = images.orderBy("seq").collect()
    full = [decimal.Decimal(2 ** 64 - 1), 255, "naïve", 65535, 16777215, 2 ** 32 - 1,
            decimal.Decimal(2 ** 64 - 2), 1.5, True, "é   ", -2]
    assert [list(r.after) if r.after else None for r in got] == [
        full, [5] + EMPTY[1:], None, [2 ** 64 - 1] + EMPTY[1:]]
    assert [list(r.before) if r.before else None for r in got] == [
        None, None, [5] + EMPTY[1:], full]
    assert len({r.seq for r in got}) == 4
    changes, _ = split_valid(build_changes(binlog_scan(spark, str(tmp_path)),
                                           shape_of(spark, tmp_path)))
    state = apply_changes(changes).collect()
    # The update sets every column but one to NULL, and the NULLs stay.
    assert [(r.key, r.t, r.name, r["last"]) for r in state] == [
        ("000018446744073709551615".rjust(24, "0"), None, None, -3)]


def test_documents_of_many_tables(spark, tmp_path):
    other = [KEY, ("note", S.VARCHAR, struct.pack("<H", 900), False, False)]
    write_file(tmp_path, 1, [
        table_map(WIDE), table_map(other, 8, table="u"),
        rows(WIDE, S.WRITE_ROWS_V1, [FULL]),
        rows(other, S.WRITE_ROWS_V1, [[1, 'a "quoted"\\ \n line'], [2, None]], 8)])
    got = read_changes(spark, str(tmp_path)).select(
        "table", "key", F.variant_get("after", "$.note", "string").alias("note"),
        F.variant_get("after", "$.b", "decimal(20,0)").alias("b")).orderBy("table", "key")
    assert [tuple(r) for r in got.collect()] == [
        ("t", str(2 ** 64 - 1).rjust(24, "0"), None, decimal.Decimal(2 ** 64 - 2)),
        ("u", "1".rjust(24, "0"), 'a "quoted"\\ \n line', None),
        ("u", "2".rjust(24, "0"), None, None)]


def reasons(spark, folder, **kwargs):
    changes = build_changes(binlog_scan(spark, str(folder)), **kwargs)
    return sorted((r.reason or "", r.key or "") for r in changes.collect())


def test_quarantine(spark, tmp_path):
    date = [KEY, ("day", 10, b"", False, False)]
    two = [KEY, ("x", S.LONG, b"", False, True)]
    named = [("id", S.LONGLONG, b"", True, True)]
    signed = [("_id", S.LONGLONG, b"", False, True)]
    plain = [KEY, ("x", S.LONG, b"", False, False)]
    write_file(tmp_path, 1, [
        rows(plain, S.WRITE_ROWS_V1, [[1, 1]], 99),
        table_map(date, 1), (S.WRITE_ROWS_V1, P.rows_body(
            1, S.WRITE_ROWS_V1, date, [b"\xfc" + bytes(8) + b"\x01\x02\x03"])),
        table_map(two, 2), rows(two, S.WRITE_ROWS_V1, [[1, 2]], 2),
        table_map(named, 3), rows(named, S.WRITE_ROWS_V1, [[1]], 3),
        table_map(signed, 4), rows(signed, S.WRITE_ROWS_V1, [[1]], 4),
        table_map(plain, 5), rows(plain, S.WRITE_ROWS_V1, [[None, 1], [8, 1]], 5),
        rows(plain, S.WRITE_ROWS_V1, [[1, 1]], 5, present=b"\x01"),
        (S.WRITE_ROWS_V1, P.rows_body(5, S.WRITE_ROWS_V1, plain, [P.image(plain, [9, 9])[:-2]])),
        rows(plain, S.DELETE_ROWS_V1, [[8, None]], 5)])
    key = "8".rjust(24, "0")
    assert reasons(spark, tmp_path) == sorted([
        ("", key), ("", key), ("no_schema", ""), ("unsupported_type", ""),
        ("primary_key_count", ""), ("primary_key_name", ""), ("key_type", ""), ("null_key", ""),
        ("partial_image", ""), ("bad_image", "")])
    # An unaccepted type that is NULL in the row is no obstacle.
    write_file(tmp_path, 2, [table_map(date, 1), rows(date, S.WRITE_ROWS_V1, [[8, None]], 1)])
    assert reasons(spark, tmp_path).count(("", key)) == 3
    # A declared row that the logged types do not fit.
    narrow = StructType.fromDDL("_id decimal(20,0), x boolean")
    assert ("type_mismatch", "") in reasons(spark, tmp_path, row=narrow, table="t")


def test_schema_change_in_one_log(spark, tmp_path):
    old, new = [KEY, ("a", S.TINY, b"", False, False)], [
        KEY, ("b", S.LONG, b"", False, False), ("a", S.SHORT, b"", False, False)]
    write_file(tmp_path, 1, [
        table_map(old), rows(old, S.WRITE_ROWS_V1, [[1, 7]]),
        table_map(new), rows(new, S.WRITE_ROWS_V1, [[2, 70000, 300]])])
    shape = shape_of(spark, tmp_path)
    assert shape.fieldNames() == ["_id", "b", "a"]
    got = decode_rows(binlog_scan(spark, str(tmp_path)), shape).orderBy("seq").collect()
    assert [(r.after.a, r.after.b) for r in got] == [(7, None), (300, 70000)]


def test_scan_and_operator_resolve_alike(spark, tmp_path):
    plain = [KEY]
    write_file(tmp_path, 1, [
        rows(plain, S.WRITE_ROWS_V1, [[1]]), table_map(plain), rows(plain, S.WRITE_ROWS_V1, [[2]]),
        table_map(plain, table="renamed"), rows(plain, S.WRITE_ROWS_V1, [[3]]),
        rows(plain, S.WRITE_ROWS_V1, [[4]])])
    write_file(tmp_path, 2, [rows(plain, S.WRITE_ROWS_V1, [[5]])])  # file-local
    events = binlog_scan(spark, str(tmp_path))
    scanned = {(r.seq, r.table, r.reason) for r in decode_rows(events).collect()}
    resolved = {(r.seq, r.table, r.reason)
                for r in decode_rows(events.drop("table_map")).collect()}
    assert scanned == resolved and len(scanned) == 5
    assert sum(reason == "no_schema" for _, _, reason in scanned) == 2
    spread = {(r.seq, r.table, r.reason) for r in decode_rows(events, spread=3).collect()}
    assert spread == scanned


def test_bad_files(spark, tmp_path):
    path = write_file(tmp_path, 1, [table_map([KEY]), rows([KEY], S.WRITE_ROWS_V1, [[1]])])
    data = open(path, "rb").read()
    (tmp_path / "mysql-bin.000002").write_bytes(data[:-3])
    (tmp_path / "mysql-bin.000003").write_bytes(b"not a log at all, really")
    (tmp_path / "mysql-bin.000004").write_bytes(data[:4] + bytes(40))
    (tmp_path / "mysql-bin.000005").write_bytes(b"")
    (tmp_path / "mysql-bin.index").write_bytes(b"mysql-bin.000001\n")
    for reader in ("stream", "binaryFile"):
        events = binlog_scan(spark, str(tmp_path), reader)
        # Spark's own file sources never show an empty file to the reader.
        empty = [("5", "bad_magic")] if reader == "stream" else []
        assert sorted((r.log_file[-1], r.reason) for r in bad_events(events).collect()) == [
            ("2", "truncated_event"), ("3", "bad_magic"), ("4", "bad_event_size"), *empty]
        assert events.filter("error is null").count() == 3 + 2
    events = binlog_scan(spark, str(tmp_path))
    for changes in (read_changes(spark, str(tmp_path)), build_changes(events),
                    build_changes(events.drop("table_map"))):
        good, bad = split_valid(changes)
        assert sorted((r.log_file[-1], r.reason) for r in bad.collect()) == [
            ("2", "truncated_event"), ("3", "bad_magic"), ("4", "bad_event_size"),
            ("5", "bad_magic")]
        assert [r.key for r in good.collect()] == ["1".rjust(24, "0")]
    pruned = binlog_scan(spark, str(tmp_path), start_file=4)
    assert {r.log_file for r in pruned.collect()} == {"mysql-bin.000004", "mysql-bin.000005"}


@pytest.mark.parametrize("reader", ["stream", "binaryFile"])
def test_scan_of_some_types_or_headers_only(spark, tmp_path, reader):
    write_file(tmp_path, 1, [table_map(STORE), rows(STORE, S.WRITE_ROWS_V1, FIRST)])
    rows_only = binlog_scan(spark, str(tmp_path), reader, codes=S.ROWS_EVENTS).collect()
    assert [r.type_code for r in rows_only] == [23] and rows_only[0].table_map is not None
    heads = binlog_scan(spark, str(tmp_path), reader, bodies=False).orderBy("byte_off").collect()
    assert [r.type_code for r in heads] == [15, 19, 23]
    assert all(r.body is None and r.table_map is None for r in heads)


def test_column_catalog(spark, tmp_path):
    write_file(tmp_path, 1, [table_map(WIDE)])
    catalog = column_catalog(table_maps(binlog_scan(spark, str(tmp_path)))).orderBy("ordinal")
    got = [(r.name, r.type_code, r.unsigned, r.is_pk) for r in catalog.collect()]
    assert got == [(c[0], c[1], c[3], c[4]) for c in WIDE]


def test_four_byte_table_ids():
    state = codec.LogState()
    lengths = bytearray(171)
    lengths[S.TABLE_MAP_EVENT - 1] = 6
    lengths[S.WRITE_ROWS_V1 - 1] = 6
    body = struct.pack("<H50sIB", 4, b"5.1", 0, 19) + bytes(lengths) + bytes(5)
    assert state.format(body) is None
    assert (state.map_id_bytes, state.rows_id_bytes) == (4, 4)
    assert state.format(body[:60]) == "bad_format_event"


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_split_does_not_depend_on_chunks(tmp_path, size):
    path = write_file(tmp_path, 1, [table_map(STORE), rows(STORE, S.WRITE_ROWS_V1, FIRST)])
    data = open(path, "rb").read()
    whole = list(codec.log_rows([data], "x.1", 1))
    parts = list(codec.log_rows([data[i:i + size] for i in range(0, len(data), size)], "x.1", 1))
    assert parts == whole and len(whole) == 3


def test_packed_integers():
    cases = {b"\xfa": 250, b"\xfb": None, b"\xfc\x01\x02": 513, b"\xfd\x01\x02\x03": 197121,
             b"\xfe" + bytes([1] + [0] * 7): 1}
    for data, value in cases.items():
        assert codec.packed_int(data, 0) == (value, len(data))


def test_header_times(spark, tmp_path):
    write_file(tmp_path, 1, [(*table_map([KEY]), 1749159513)])
    event = binlog_scan(spark, str(tmp_path)).filter("type_code = 19").collect()[0]
    assert event.event_ts == datetime.datetime(2025, 6, 5, 21, 38, 33)
    assert event.log_pos == event.byte_off + event.event_size


def test_schema_asof_on_events(spark, tmp_path):
    write_file(tmp_path, 1, [table_map([KEY]), rows([KEY], S.WRITE_ROWS_V1, [[1]])])
    events = binlog_scan(spark, str(tmp_path)).filter(F.col("type_code").isin(19, 23))
    paired = schema_asof(events, ["log_file", "table_id"], "byte_off", F.col("type_code") == 19,
                         F.col("byte_off"), "map_off")
    assert [r.map_off for r in paired.collect()] == [events.agg(F.min("byte_off")).collect()[0][0]]


def test_events_of_many_images():
    """One event is read as many are, whatever its images hold, and to its end or not at all."""
    columns = [(S.LONGLONG, 0, True), (S.VARCHAR, 400, False), (S.SHORT, 0, False)]
    logged = [KEY, ("v", S.VARCHAR, struct.pack("<H", 400), False, False),
              ("s", S.SHORT, b"", False, False)]
    values = [[i, None if i % 7 == 0 else "é" * (i % 9), None if i % 5 == 0 else i % 100]
              for i in range(3000)]

    def body(images, code=S.WRITE_ROWS_V1):
        return P.rows_body(7, code, logged, [P.image(logged, v) for v in images])
    one = codec.read_images([body(values)], columns, S.WRITE_ROWS_V1, 6)
    many = codec.read_images([body([v]) for v in values], columns, S.WRITE_ROWS_V1, 6)
    for (buf, _, _, sides, reason), n in ((one, 1), (many, 3000)):
        assert reason.tolist() == [None] * n
        got = [codec.arrow_column(buf, c, nulls, k, m).to_pylist()
               for (c, nulls), (k, m, _) in zip(sides[0], columns)]
        assert [list(r) for r in zip(*got)] == values
    pairs = codec.read_images([body(values[:10], S.UPDATE_ROWS_V1)], columns, S.UPDATE_ROWS_V1, 6)
    assert pairs[3][0][0][0].tolist() == [0, 2, 4, 6, 8]
    assert pairs[3][1][0][0].tolist() == [1, 3, 5, 7, 9]
    cut = codec.read_images([body(values)[:-1], body(values[:2])], columns, S.WRITE_ROWS_V1, 6)
    assert cut[4].tolist() == ["bad_image", None] and cut[1].tolist() == [1, 1]


def test_several_tables_in_one_pass(spark, tmp_path):
    other = [KEY, ("note", S.VARCHAR, struct.pack("<H", 900), False, False)]
    write_file(tmp_path, 1, [
        table_map(WIDE), table_map(other, 8, table="u"), table_map(other, 9, table="skipped"),
        rows(WIDE, S.WRITE_ROWS_V1, [FULL]), rows(other, S.WRITE_ROWS_V1, [[1, "x"]], 8),
        rows(other, S.WRITE_ROWS_V1, [[1, "x"]], 9)])
    tables = [("d", "t"), ("d", "u")]
    shape = tables_row_type(table_maps(binlog_scan(spark, str(tmp_path))), tables)
    assert shape.fieldNames() == [c[0] for c in WIDE] + ["note"]
    got = read_changes(spark, str(tmp_path), shape, tables=tables).orderBy("table").collect()
    assert [(r.table, r.after.name, r.after.note) for r in got] == [
        ("t", "naïve", None), ("u", None, "x")]


def test_a_file_is_packed_with_one_writer_per_table(monkeypatch):
    """What depends on a table alone is worked out once per file, not once per row."""
    import pandas as pd
    made = []
    writer = P.image_writer
    monkeypatch.setattr(P, "image_writer", lambda columns: made.append(len(columns)) or writer(columns))
    frame = pd.DataFrame([(n, n % 5, ("signup", "view", "error")[n % 3], n / 2, "{}", 7, n % 9, 1)
                          for n in range(300)], columns=[
        "event_id", "user_id", "event_type", "value", "props", "when", "k", "number"])
    whole = P.pack_file(frame, 1)
    assert sorted(made) == sorted([len(P.USERS), len(P.GUESTS)])
    assert P.image(P.GUESTS, [4, 8, None, "x"]) in writer(P.GUESTS)([4, 8, None, "x"]) and whole
