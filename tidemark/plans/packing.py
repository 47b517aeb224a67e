"""The events table as log files, for round trips through the scan and the decoder.

A Spark job packs ranges of event ids to files, one bounded range per file. Even users live in
``e_store.users``, odd ones in ``e_store.guests``; consecutive changes of the same table and
kind form one rows event. A table map is written at the start of a file for each table and again
before every 16th rows event.
"""

from __future__ import annotations

import itertools
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas as S
from ..sources.datasource import filesystem, qualified
from ..sources.scratch import new_path
from . import feeds

ROWS_PER_FILE = 4096
MAPS_EVERY = 16
# name, type, metadata, unsigned, primary key
USERS = [
    ("_id", S.LONGLONG, b"", True, True), ("event_id", S.LONGLONG, b"", False, False),
    ("event_type", S.VARCHAR, struct.pack("<H", 80), False, False),
    ("value", S.DOUBLE, b"\x08", False, False), ("k", S.SHORT, b"", False, False),
    ("props", S.VARCHAR, struct.pack("<H", 1200), False, False),
    ("label", S.STRING, bytes([S.STRING, 64]), False, False),
    ("medium", S.INT24, b"", False, False), ("counter", S.LONG, b"", True, False),
]
GUESTS = [
    ("_id", S.LONGLONG, b"", True, True), ("event_id", S.LONGLONG, b"", False, False),
    ("value", S.DOUBLE, b"\x08", False, False), ("event_type", S.VARCHAR, struct.pack("<H", 80),
                                                 False, False),
]
TABLES = {0: (64, "users", USERS), 1: (65, "guests", GUESTS)}
_FORMATS = {S.TINY: "b", S.SHORT: "h", S.LONG: "i", S.LONGLONG: "q"}
_NUMBER = {S.TINY: 1, S.SHORT: 2, S.INT24: 3, S.LONG: 4, S.LONGLONG: 8}


def event(code: int, body: bytes, at: int, when: int = 0, server_id: int = 1,
          checksum: bool = False) -> bytes:
    size = S.HEADER_BYTES + len(body) + (S.CHECKSUM_BYTES if checksum else 0)
    out = struct.pack("<IBIIIH", when, code, server_id, size, at + size, 0) + body
    return out + struct.pack("<I", zlib.crc32(out)) if checksum else out


def format_event(at: int, checksum: bool = False) -> bytes:
    lengths = bytearray(171)
    for code, size in ((S.ROTATE_EVENT, 8), (S.TABLE_MAP_EVENT, 8), (S.WRITE_ROWS_V1, 8),
                       (S.UPDATE_ROWS_V1, 8), (S.DELETE_ROWS_V1, 8)):
        lengths[code - 1] = size
    body = struct.pack("<H50sIB", 4, b"11.4.5-MariaDB-log", 0, S.HEADER_BYTES) + bytes(lengths)
    return event(S.FORMAT_EVENT, body + bytes([int(checksum)]) + bytes(4), at)


def rotate_event(at: int, name: str, position: int = S.FIRST_POSITION) -> bytes:
    return event(S.ROTATE_EVENT, struct.pack("<Q", position) + name.encode(), at)


def _length(n: int) -> bytes:
    return bytes([n]) if n < 251 else b"\xfc" + struct.pack("<H", n)


def table_map_body(table_id: int, database: str, table: str, columns) -> bytes:
    meta = b"".join(c[2] for c in columns)
    flags = [c[3] for c in columns if c[1] in S.SIGNED_TYPES]
    bits = np.packbits(np.array(flags, bool)).tobytes()
    names = b"".join(_length(len(c[0].encode())) + c[0].encode() for c in columns)
    keys = b"".join(_length(i) for i, c in enumerate(columns) if c[4])
    return b"".join([
        table_id.to_bytes(6, "little"), struct.pack("<H", 1),
        _length(len(database)), database.encode(), b"\0",
        _length(len(table)), table.encode(), b"\0",
        _length(len(columns)), bytes(c[1] for c in columns), _length(len(meta)), meta,
        bytes((len(columns) + 7) // 8),
        bytes([S.SIGNEDNESS_FIELD]), _length(len(bits)), bits,
        bytes([S.COLUMN_NAME_FIELD]), _length(len(names)), names,
        bytes([S.SIMPLE_PK_FIELD]), _length(len(keys)), keys])


def _cell(kind: int, meta: bytes, unsigned: bool):
    """The function that packs a value of a column."""
    if kind in _FORMATS:
        form = _FORMATS[kind].upper() if unsigned else _FORMATS[kind]
        pack_number = struct.Struct(f"<{form}").pack
        return lambda value: pack_number(int(value))
    if kind in _NUMBER:
        return lambda value: int(value).to_bytes(_NUMBER[kind], "little", signed=not unsigned)
    if kind in (S.FLOAT, S.DOUBLE):
        return struct.Struct("<f" if meta == b"\x04" else "<d").pack
    if kind == S.BOOL:
        return lambda value: bytes([bool(value)])
    long = kind == S.VARCHAR and struct.unpack("<H", meta)[0] > 255
    pack_length = struct.Struct("<H" if long else "<B").pack

    def text(value):
        value = value if isinstance(value, bytes) else value.encode()
        return pack_length(len(value)) + value
    return text


def image_writer(columns):
    """The function that packs rows of ``columns``; unused bits of the null bitmap are set, as
    servers do."""
    cells = [_cell(kind, meta, unsigned) for _, kind, meta, unsigned, _ in columns]

    def write(values) -> bytes:
        width = (len(values) + 7) // 8
        mask, out = (1 << 8 * width) - (1 << len(values)), []
        for i, value in enumerate(values):
            if value is None:
                mask |= 1 << i
            else:
                out.append(cells[i](value))
        return mask.to_bytes(width, "little") + b"".join(out)

    return write


def image(columns, values) -> bytes:
    """One packed row."""
    return image_writer(columns)(values)


def rows_body(table_id: int, code: int, columns, images: list[bytes], present=None) -> bytes:
    count = len(columns)
    bitmap = b"\xff" * -(-count // 8) if present is None else present
    return b"".join([table_id.to_bytes(6, "little"), struct.pack("<H", 1), _length(count),
                     bitmap * (2 if code == S.UPDATE_ROWS_V1 else 1), *images])


_CODES = {"signup": S.WRITE_ROWS_V1, "error": S.DELETE_ROWS_V1}


def _values(table: int, r) -> list:
    if table == 1:
        return [r.user_id, r.event_id, r.value, r.event_type]
    return [r.user_id, r.event_id, r.event_type, r.value, None if r.k % 7 == 0 else r.k, r.props,
            r.event_type, (r.event_id * 7919) % 16777216 - 8388608, 4294967295 - r.event_id]


def pack_file(rows, number: int) -> bytes:
    """One log file from a pandas frame of events in id order."""
    out = bytearray(S.LOG_MAGIC)
    out += format_event(len(out))

    maps = [table_map_body(table_id, feeds.DATABASE, name, columns)
            for table_id, name, columns in TABLES.values()]
    writers = {which: image_writer(columns) for which, (_, _, columns) in TABLES.items()}

    def write_maps(when):
        for body in maps:
            out.extend(event(S.TABLE_MAP_EVENT, body, len(out), when))

    def change(r):
        return r.user_id % 2, _CODES.get(r.event_type, S.UPDATE_ROWS_V1)

    runs = itertools.groupby(rows.itertuples(index=False), key=change)
    for ordinal, ((which, kind), run) in enumerate(runs):
        table_id, _, columns = TABLES[which]
        images, when, write = [], None, writers[which]
        for r in run:
            when = r.when if when is None else when
            values = _values(which, r)
            if kind == S.UPDATE_ROWS_V1:  # before: the key and the event id only
                images.append(write(values[:2] + [None] * (len(values) - 2)))
            images.append(write(values))
        if ordinal % MAPS_EVERY == 0:
            out += event(S.QUERY_EVENT, b"BEGIN", len(out), when)
            write_maps(when)
        out += event(kind, rows_body(table_id, kind, columns, images), len(out), when)
    out += rotate_event(len(out), log_name(number + 1))
    return bytes(out)


def log_name(number: int) -> str:
    return f"mysql-bin.{number:06d}"


def packed_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content) of each log file. Ids are unique, so a file holds at most
    ``ROWS_PER_FILE`` events."""
    events = feeds.read(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "value", "props",
        F.floor(feeds.utc_micros(F.col("ts")) / 1_000_000).alias("when"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        (F.floor(F.col("event_id") / ROWS_PER_FILE) + 1).cast("int").alias("number"))

    def pack(frame):
        import pandas as pd
        number = int(frame.number.iloc[0])
        content = pack_file(frame.sort_values("event_id").reset_index(drop=True), number)
        return pd.DataFrame({"path": [log_name(number)], "content": [content]})

    return events.groupBy("number").applyInPandas(pack, "path string, content binary")


def write_logs(logs: DataFrame, folder: str) -> None:
    """Write (path, content) rows as files. A file appears whole under its final name, so a
    repeated task does no harm."""
    def write(batches):
        import uuid
        fs, root = filesystem(folder)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = f"{root}/.{name}-{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as stream:
                    stream.write(content.as_buffer())
                fs.move(part, f"{root}/{name}")
            yield batch.select(["path"])

    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    logs.mapInArrow(write, "path string").write.format("noop").mode("overwrite").save()


_written: dict[tuple[str, str], str] = {}


def log_folder(spark: SparkSession, sf_dir: str) -> str:
    """Folder with the packed events, written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        folder = qualified(spark, new_path(spark, "logs"))
        write_logs(packed_logs(spark, sf_dir), folder)
        _written[key] = folder
    return _written[key]
