"""What must never be cut, mixed up or left out without a word."""

import pytest
from pyspark.sql import functions as F, types as T

from logs import KEY, rows, table_map, write_file
from tidemark import schemas as S
from tidemark.functions import cast_columns, char_pad, format_key, null_mask
from tidemark.operators import apply_changes, late_changes, resume_from, validate_key
from tidemark.plans import packing as P
from tidemark.sources import binlog_scan, codec, read_changes, table_maps, table_row_type
from tidemark.sources.binlog import changes_of, read_images
from tidemark.sources.datasource import (
    LogReader, LogStreamReader, filesystem, list_logs, qualified, without_holes,
)
from tidemark.sources.decode import decoded_type

TWO = [KEY, ("x", S.LONG, b"", False, False)]


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_long_text_is_not_cut(spark):
    assert one(spark, char_pad(F.lit("abcdef"), 4), char_pad(F.lit("ab"), 4),
               char_pad(F.lit(None).cast("string"), 4)) == ("abcdef", "ab  ", None)
    table = [{"name": "c", "type_code": S.STRING, "meta": 16 << 8}]
    df = spark.createDataFrame([("abcdef",), ("ab",)], "c string")
    assert [r.c for r in cast_columns(df, table).collect()] == [None, "ab  "]


def test_keys_that_are_no_unsigned_64_bit_numbers(spark):
    top = str(2 ** 64 - 1)
    texts = [top, str(2 ** 64), "1" * 25, "-5", "1.5", "", "x", None, "0"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    assert [r[0] for r in df.select(format_key("v")).collect()] == [
        top.rjust(24, "0"), None, None, None, None, None, None, None, "0" * 24]
    keyed = df.select(F.col("v").alias("key_value"), F.array(F.lit("_id")).alias("pk_names"),
                      F.lit(S.LONGLONG).alias("pk_type"), F.lit(True).alias("pk_unsigned"))
    assert [r.reason for r in validate_key(keyed).collect()] == [
        None, *["key_value"] * 6, "null_key", None]


def test_masks_of_wide_tables(spark):
    bits = bytes([0b101] + [0] * 11 + [0b1000])
    got = one(spark, null_mask(F.lit(bytearray(bits)), 100, binary=True))[0]
    assert [i for i, b in enumerate(got) if b] == [0, 2, 99]
    with pytest.raises(ValueError):
        null_mask(F.lit(1), 65)


def folder_of(path, *numbers, base=None):
    for n in numbers:
        name = write_file(path, n, [table_map(TWO), rows(TWO, S.WRITE_ROWS_V1, [[n, n]])])
        if base:
            from pathlib import Path
            Path(name).rename(path / f"{base}.{n:06d}")
    return str(path)


def test_missing_files_are_reported(spark, tmp_path):
    folder = folder_of(tmp_path, 1, 3, 5)
    with pytest.raises(Exception, match="missing: 2, 4"):
        binlog_scan(spark, folder).count()
    assert binlog_scan(spark, folder, holes="skip").count() == 9
    assert binlog_scan(spark, folder, start_file=5).count() == 3
    stream = LogStreamReader({"path": qualified(spark, folder)})
    with pytest.raises(FileNotFoundError, match="missing: 2, 4"):
        stream.partitions({"file": 1, "position": 50}, {"file": 5, "position": 99})
    with pytest.raises(FileNotFoundError):
        without_holes([(3, "", 0)], 2, 3)


def test_logs_of_two_names_are_not_mixed(spark, tmp_path):
    folder_of(tmp_path, 1, base="other-bin")
    folder = folder_of(tmp_path, 1, 2)
    (tmp_path / "mysql-bin.000001.gz").write_bytes(b"no log")
    with pytest.raises(ValueError, match="several names"):
        list_logs(qualified(spark, folder))
    names = {r.log_file for r in binlog_scan(spark, folder, base="other-bin").collect()}
    assert names == {"other-bin.000001"}
    for reader in ("stream", "binaryFile"):
        events = binlog_scan(spark, folder, reader, base=P.log_name(1).rsplit(".", 1)[0])
        assert {r.file_seq for r in events.collect()} == {1, 2}


def test_paths_name_their_file_system(spark, tmp_path):
    assert qualified(spark, str(tmp_path)) == f"file:{tmp_path}"
    assert qualified(spark, "s3a://bucket/x") == "s3a://bucket/x"
    with pytest.raises(ValueError):
        filesystem("/no/scheme")


def test_positions_over_four_gigabytes():
    code, body = table_map(TWO)
    event = P.event(code, body, 0, 0)
    far = [(off + (1 << 32), head, data) for off, head, data in codec.split_events([event], False)]
    original = codec.split_events
    codec.split_events = lambda *_: iter(far)
    try:
        row = list(codec.log_rows([], "x.000001", 1))[0]
    finally:
        codec.split_events = original
    assert row[-1] == "position_over_4gib"


def test_a_state_needs_its_high_water(spark):
    feed = spark.createDataFrame(
        [("a", "INSERT", 5, (1,)), ("a", "DELETE", 10, (1,)), ("b", "INSERT", 7, (2,))],
        "key string, op string, seq bigint, after struct<v: int>")
    state = apply_changes(feed)
    with pytest.raises(ValueError):
        apply_changes(feed.filter("seq = 5"), state)
    again = apply_changes(feed, state, high_water=10)
    assert [tuple(r) for r in again.collect()] == [("b", 2, 7)]
    late = late_changes(feed, 7).orderBy("seq").collect()
    assert [(r.seq, r.reason) for r in late] == [(5, "not_after_high_water"),
                                                 (7, "not_after_high_water")]


def test_broken_documents_are_set_aside(spark):
    schema = decoded_type(None)
    row = {f.name: None for f in schema}
    row |= {"type_code": S.WRITE_ROWS_V1, "seq": 1, "pk_names": ["_id"], "pk_type": S.LONGLONG,
            "pk_unsigned": True, "key_value": "1"}
    df = spark.createDataFrame([{**row, "after": text} for text in ('{"v":nan}', '{"v":1}')], schema)
    assert [r.reason for r in changes_of(df).collect()] == ["bad_document", None]


def test_infinite_numbers_are_null_in_documents(spark, tmp_path):
    table = [KEY, ("d", S.DOUBLE, b"\x08", False, False)]
    write_file(tmp_path, 1, [table_map(table), rows(
        table, S.WRITE_ROWS_V1, [[1, float("inf")], [2, float("nan")], [3, 0.5]])])
    got = read_changes(spark, str(tmp_path)).select(
        "reason", F.variant_get("after", "$.d", "double").alias("d")).collect()
    assert sorted((r.d or 0, r.reason) for r in got) == [(0, None), (0, None), (0.5, None)]


def test_filters_choose_files_and_events(spark, tmp_path):
    folder = folder_of(tmp_path, 1, 2, 3, 4)
    opened = LogReader({"path": qualified(spark, folder), "parallelism": "9"})
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual
    list(opened.pushFilters([GreaterThan(("file_seq",), 1), LessThanOrEqual(("file_seq",), 3),
                             EqualTo(("type_code",), S.TABLE_MAP_EVENT)]))
    files = [f[0] for part in opened.partitions() for f in part.files]
    assert files == [2, 3] or files == [1, 2, 3]
    assert {r[4] for p in opened.partitions() for b in opened.read(p)
            for r in zip(*[c.to_pylist() for c in b.columns])} == {S.TABLE_MAP_EVENT}
    # A file that cannot be read shows that it was not opened.
    (tmp_path / P.log_name(1)).write_bytes(b"broken")
    images = resume_from(read_images(spark, folder), 2, 0)
    assert sorted(r.seq >> 32 for r in images.collect()) == [2, 3, 4]
    scan = binlog_scan(spark, folder).filter("file_seq >= 3 AND type_code = 19")
    assert scan.count() == 2


def test_text_that_is_not_utf8_is_replaced_in_both_kinds(spark, tmp_path):
    """Broken bytes reach Spark as U+FFFD, never as text that is none; good rows stay as they are."""
    shape = [KEY, ("v", S.VARCHAR, (40).to_bytes(2, "little"), False, False),
             ("w", S.VARCHAR, (400).to_bytes(2, "little"), False, False)]
    texts = [(b"caf\xe9", b"plain"), (b"\xff\x01", b"\xc3"), ("é𐍈".encode(), "ü".encode())]
    # The packer writes UTF-8: it gets letters in the place of the raw bytes.
    stand = {raw: bytes([65 + n]) * len(raw) for n, raw in enumerate(sum(texts, ()))}
    images = [[i, *[stand[t].decode() for t in pair]] for i, pair in enumerate(texts)]
    path = write_file(tmp_path, 1, [table_map(shape), rows(shape, S.WRITE_ROWS_V1, images)])
    data = open(path, "rb").read()
    for raw, letters in stand.items():
        assert data.count(bytes([len(raw)]) + letters) + data.count(
            len(raw).to_bytes(2, "little") + letters) == 1
        data = data.replace(bytes([len(raw)]) + letters, bytes([len(raw)]) + raw).replace(
            len(raw).to_bytes(2, "little") + letters, len(raw).to_bytes(2, "little") + raw)
    open(path, "wb").write(data)
    maps = table_maps(binlog_scan(spark, str(tmp_path), codes=(S.TABLE_MAP_EVENT,)))
    typed = read_changes(spark, str(tmp_path), table_row_type(maps, "d", "t"))
    documents = read_changes(spark, str(tmp_path)).withColumn(
        "after", F.struct(F.variant_get("after", "$.v", "string").alias("v"),
                          F.variant_get("after", "$.w", "string").alias("w")))
    for changes in (typed, documents):
        got = {int(r.key): (r.after.v, r.after.w, r.reason) for r in changes.collect()}
        for i, (v, w) in enumerate(texts):
            assert got[i][2] is None
            for value, raw in zip(got[i], (v, w)):
                assert value == raw.decode("utf-8", "replace")
