"""Streams that keep schemas and tables: maps resolved in state, targets made at first sight."""

import random

import pandas as pd
from pyspark.sql import functions as F

from logs import KEY, rows, table_map, write_file
from tidemark import schemas as S
from tidemark.operators import split_valid
from tidemark.operators.schema import attach_table_map
from tidemark.plans import packing as P
from tidemark.sources import binlog_scan, read_changes
from tidemark.streaming import (
    binlog_stream, publish, read_target, resolve_stream, route_stream, targets,
)
from tidemark.streaming.resolve import _Resolver

A = [KEY, ("a", S.LONG, b"", False, False)]
AB = [KEY, ("a", S.LONGLONG, b"", False, False), ("b", S.VARCHAR, (40).to_bytes(2, "little"), False, False)]


def log_of(seed, n):
    """Events of two tables whose maps change now and then; the first rows have no map."""
    rng = random.Random(seed)
    events = [rows(A, S.WRITE_ROWS_V1, [[0, 0]], table_id=3)]
    shape = {}
    for i in range(n):
        table = rng.choice((3, 4))
        if table not in shape or rng.random() < 0.3:
            shape[table] = rng.choice((A, AB))
            events.append(table_map(shape[table], table, "d", f"t{table}-{i}"))
        if rng.random() < 0.2:
            events.append((S.QUERY_EVENT, b"BEGIN"))
        values = [i, i] if shape[table] is A else [i, i, "x"]
        events.append(rows(shape[table], S.WRITE_ROWS_V1, [values], table_id=table))
    return events


def resolved(df):
    got = [(r.log_file, r.byte_off, r.type_code, r.table_map and bytes(r.table_map), bytes(r.body),
            r.event_ts, r.server_id) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def stream_of(spark, source, schema, path):
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(source)
    (resolve_stream(events).writeStream.format("parquet").option("path", f"{path}/out")
     .option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start()
     .awaitTermination())
    return spark.read.parquet(f"{path}/out")


def test_maps_and_rows_in_any_order(spark, tmp_path):
    """Events of two logs in random micro-batches, some twice, with a restart half way."""
    logs, source = tmp_path / "logs", str(tmp_path / "in")
    logs.mkdir()
    for number in (1, 2):
        write_file(logs, number, log_of(number, 25))
    events = binlog_scan(spark, str(logs)).drop("table_map")
    every = events.collect()
    random.Random(5).shuffle(every)

    def land(part):
        spark.createDataFrame(part, events.schema).coalesce(1).write.mode("append").parquet(source)

    cut = [every[i:i + 20] for i in range(0, len(every), 20)]
    for part in cut[:2]:
        land(part)
    first = resolved(stream_of(spark, source, events.schema, tmp_path))
    for part in [cut[0], *cut[2:], cut[1]]:
        land(part)
    got = resolved(stream_of(spark, source, events.schema, tmp_path))
    want = resolved(attach_table_map(events))
    assert first < got == want
    assert any(m is None for _, _, _, m, *_ in want) and len({m for _, _, _, m, *_ in want}) > 5


def test_rows_wait_for_what_is_missing_before_them(spark, tmp_path):
    logs, source = tmp_path / "logs", str(tmp_path / "in")
    logs.mkdir()
    write_file(logs, 1, [table_map(A), rows(A, S.WRITE_ROWS_V1, [[1, 1]]), table_map(AB),
                         rows(AB, S.WRITE_ROWS_V1, [[2, 2, "y"]])])
    events = binlog_scan(spark, str(logs)).drop("table_map")
    every = sorted(events.collect(), key=lambda r: r.byte_off)
    broken = every[0].asDict() | {"log_file": "other.000001", "type_code": None, "error": "bad_magic",
                                  "event_size": None}

    def land(part):
        spark.createDataFrame(part, events.schema).coalesce(1).write.mode("append").parquet(source)

    land([every[4], every[1], every[0], broken])  # the second rows event before its map
    got = stream_of(spark, source, events.schema, tmp_path).collect()
    assert [(r.log_file, r.error) for r in got] == [("other.000001", "bad_magic")]
    land([every[2]])
    assert stream_of(spark, source, events.schema, tmp_path).filter("error IS NULL").count() == 1
    land([every[3]])
    got = stream_of(spark, source, events.schema, tmp_path).filter("error IS NULL").collect()
    maps = {r.byte_off: bytes(r.table_map) for r in got}
    assert maps == {every[2].byte_off: bytes(every[1].body), every[4].byte_off: bytes(every[3].body)}


def run(spark, logs, root, seen=None):
    route_stream(binlog_stream(spark, str(logs), max_files=1), root, f"{root}/check", buckets=3,
                 on_batch=None if seen is None else lambda df, i: seen.append(
                     (i, [t for _, t in targets(spark, root)])),
                 availableNow=True).awaitTermination()


def test_targets_are_made_when_first_seen(spark, tmp_path):
    logs, root = tmp_path / "logs", str(tmp_path / "root")
    logs.mkdir()
    odd = "o'clock/a %"
    seen = []
    write_file(logs, 1, [table_map(A, 7), rows(A, S.WRITE_ROWS_V1, [[1, 10], [2, 20]])])
    run(spark, logs, root, seen)
    write_file(logs, 2, [table_map(A, 7), rows(A, S.UPDATE_ROWS_V1, [[2, 20], [2, 21]])])
    run(spark, logs, root, seen)
    write_file(logs, 3, [
        table_map(A, 8, "d", odd), rows(A, S.WRITE_ROWS_V1, [[1, -1]], table_id=8),
        table_map(AB, 7), rows(AB, S.WRITE_ROWS_V1, [[3, 1 << 40, "new"]]),
        rows(A, S.WRITE_ROWS_V1, [[9, 9]], table_id=99)])
    run(spark, logs, root, seen)
    assert [t for _, t in seen] == [["t"], ["t"], [odd, "t"]]
    write_file(logs, 4, [table_map(AB, 7), rows(AB, S.DELETE_ROWS_V1, [[1, 10, None]])])
    run(spark, logs, root, seen)
    table = read_target(spark, root, "d", "t")
    assert [f.simpleString() for f in table.schema][1:3] == ["a:bigint", "b:string"]
    assert {int(r.key): (r.a, r.b) for r in table.collect()} == {2: (21, None), 3: (1 << 40, "new")}
    assert [(int(r.key), r.a) for r in read_target(spark, root, "d", odd).collect()] == [(1, -1)]
    bad = spark.read.parquet(f"{root}/quarantine").select("batch", "reason").distinct().collect()
    assert [tuple(r) for r in bad] == [(2, "no_schema")]
    # Equal to the batch path, and made as catalog tables.
    good, _ = split_valid(read_changes(spark, str(logs)))
    assert good.filter("table = 't'").count() == 5
    names = publish(spark, root, str(tmp_path / "tables"), prefix="tidemark_pub_")
    assert (("tidemark_pub_d", "t") in names) and spark.table("tidemark_pub_d.t").count() == 2
    assert spark.table("tidemark_pub_d.o_27_clock_2f_a_20__25_").first().a == -1
    for _, name in names:
        spark.sql(f"DROP TABLE tidemark_pub_d.`{name}`")
    spark.sql("DROP DATABASE tidemark_pub_d")


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    """The last batch runs again, as after a driver that died before its commit was noted."""
    logs, root = tmp_path / "logs", str(tmp_path / "root")
    logs.mkdir()
    for n in (1, 2, 3):
        write_file(logs, n, [table_map(A), rows(A, S.WRITE_ROWS_V1, [[n, n]]),
                             rows(A, S.DELETE_ROWS_V1, [[n - 1, 0]])])
    run(spark, logs, root)
    before = sorted(tuple(r) for r in read_target(spark, root, "d", "t").collect())
    commits = tmp_path / "root" / "check" / "commits"
    (commits / "2").unlink()
    (commits / ".2.crc").unlink(missing_ok=True)
    seen = []
    run(spark, logs, root, seen)
    assert [i for i, _ in seen] == [2]
    assert sorted(tuple(r) for r in read_target(spark, root, "d", "t").collect()) == before
    assert [r[1] for r in before] == [3]


def test_a_micro_batch_is_split_once(spark, tmp_path):
    """Schemas, quarantine and changes come from one pass over the events."""
    logs, passes = tmp_path / "logs", spark.sparkContext.accumulator(0)
    logs.mkdir()
    for n in (1, 2):
        write_file(logs, n, [table_map(A), rows(A, S.WRITE_ROWS_V1, [[n, n]])])

    def count(batches):
        for batch in batches:
            passes.add(sum(name.endswith(P.log_name(n)) for n in (1, 2)
                           for name in batch.column("log_file").to_pylist()))
            yield batch

    events = binlog_stream(spark, str(logs), max_files=1)
    route_stream(events.mapInArrow(count, events.schema), str(tmp_path / "root"),
                 str(tmp_path / "check"), buckets=3, availableNow=True).awaitTermination()
    assert read_target(spark, str(tmp_path / "root"), "d", "t").count() == 2
    assert passes.value == 2 * 3  # format event, map and rows of each file


def test_targets_are_merged_after_some_batches(spark, tmp_path):
    """A micro-batch leaves the stores as they are until enough wait; its changes count at once."""
    logs, root = tmp_path / "logs", str(tmp_path / "root")
    logs.mkdir()
    manifests, states = tmp_path / "root" / "tables" / "d" / "t" / "manifest", []

    def state(df, i):
        there = sorted(int(f.name.split("=")[1]) for f in manifests.iterdir()) \
            if manifests.exists() else []
        states.append((there, targets(spark, root),
                       sorted(int(r.key) for r in read_target(spark, root, "d", "t").collect())))

    for n in range(1, 8):
        write_file(logs, n, [table_map(A), rows(A, S.WRITE_ROWS_V1, [[n, n], [100 + n, n]]),
                             rows(A, S.DELETE_ROWS_V1, [[n - 1, 0]])])
        route_stream(binlog_stream(spark, str(logs), max_files=1), root, f"{root}/check", buckets=2,
                     on_batch=state, merge_every=3, availableNow=True).awaitTermination()
    assert [s[0] for s in states] == [[], [], [2], [2], [2], [2, 5], [2, 5]]
    for i, (_, names, keys) in enumerate(states):
        assert names == [("d", "t")]
        assert keys == [i + 1, *range(101, 102 + i)]
    # What is merged goes with the merge after it.
    assert sorted(p.name for p in (tmp_path / "root" / "staged").iterdir()) == [
        f"batch={n}" for n in (3, 4, 5, 6)]


class _State(dict):
    """State of one key as a plain dictionary that counts its writes; a value is that of ()."""
    writes = 0

    def exists(self):
        return () in self

    def get(self):
        return self[()]

    def update(self, value):
        self.updateValue((), value)

    def updateValue(self, key, value):
        self[key], self.writes = value, self.writes + 1

    def getValue(self, key):
        return self[key]

    def containsKey(self, key):
        return key in self

    def removeKey(self, key):
        del self[key]

    def iterator(self):
        return iter(list(self.items()))


class _Handle:
    def __init__(self):
        self.states = {}

    def getValueState(self, name, *schemas):
        return self.states.setdefault(name, _State())

    getMapState = getValueState


def test_waiting_events_share_cells_of_the_state():
    """Two thousand events that wait are a few cells, however often they are delivered."""
    handle, resolver = _Handle(), _Resolver()
    resolver.init(handle)
    size = 40
    events = pd.DataFrame([{
        "file_seq": 1, "byte_off": S.FIRST_POSITION + size * n, "event_us": n,
        "type_code": S.TABLE_MAP_EVENT if n % 50 == 0 else S.WRITE_ROWS_V1, "server_id": 1,
        "event_size": size, "id_bytes": 6, "table_id": 7, "body": b"%d" % n, "error": None}
        for n in range(2001)])

    def give(part):
        return [r for out in resolver.handleInputRows(("log.000001",), iter([part]), None)
                for r in out[["byte_off", "table_map"]].itertuples(index=False)]

    for again in range(40):
        assert give(events.iloc[1:].sample(frac=1, random_state=again)) == []
    held = handle.states["held"]
    assert 1 <= len(held) <= 17 and held.writes <= 60
    got = give(events.iloc[:1])
    assert len(got) == 2001 - 41 and not held
    assert all(r.table_map == b"%d" % ((r.byte_off - S.FIRST_POSITION) // size // 50 * 50)
               for r in got)
