"""Blocks of rows events to Arrow batches of row images."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T

from .. import schemas as S
from . import codec


def decoded_type(row: T.StructType | None) -> T.StructType:
    """Schema of decoded images: typed structs, or JSON text without ``row``."""
    image = row if row is not None else T.StringType()
    return T.StructType([
        T.StructField("database", T.StringType()),
        T.StructField("table", T.StringType()),
        T.StructField("type_code", T.IntegerType()),
        T.StructField("seq", T.LongType()),
        T.StructField("log_file", T.StringType()),
        T.StructField("event_ts", T.TimestampType()),
        T.StructField("server_id", T.LongType()),
        T.StructField("pk_names", T.ArrayType(T.StringType())),
        T.StructField("pk_type", T.IntegerType()),
        T.StructField("pk_unsigned", T.BooleanType()),
        T.StructField("key_value", T.StringType()),
        T.StructField("before", image),
        T.StructField("after", image),
        T.StructField("reason", T.StringType()),
    ])


class Events(NamedTuple):
    """Rows events as columns: bodies and maps as Python bytes, the rest as arrays."""

    log_file: pa.Array
    file_seq: np.ndarray
    byte_off: np.ndarray
    event_ts: pa.Array
    code: list
    server_id: pa.Array
    id_bytes: list
    body: list
    table_map: list
    error: list

    @classmethod
    def from_rows(cls, rows: list[tuple]) -> Events:
        """From tuples of ``LOG_EVENTS``."""
        c = list(zip(*rows))
        return cls(pa.array(c[0]), np.array(c[1], np.int64), np.array(c[2], np.int64),
                   pa.array(c[3], pa.int64()), c[4], pa.array(c[5], pa.int64()), c[9], c[11],
                   c[12], c[13])

    @classmethod
    def from_batch(cls, batch: pa.RecordBatch) -> Events:
        def number(name):
            return batch.column(name).cast(pa.int64())

        def plain(name):
            return batch.column(name).to_pylist()

        maps = pc.dictionary_encode(batch.column("table_map"))
        known = maps.dictionary.to_pylist() + [None]
        return cls(
            batch.column("log_file"), number("file_seq").to_numpy(), number("byte_off").to_numpy(),
            number("event_ts"), plain("type_code"), number("server_id"), plain("id_bytes"),
            plain("body"), [known[-1 if i is None else i] for i in maps.indices.to_pylist()],
            plain("error"))


def is_wanted(found: dict, wanted) -> bool:
    """Whether a table map is of a wanted table: ``wanted`` is (database or None, table or None,
    a set of (database, table) or None)."""
    database, table, tables = wanted
    return ((database is None or found["database"] == database)
            and (table is None or found["table"] == table)
            and (tables is None or (found["database"], found["table"]) in tables))


def decode_events(events: Events, schema: pa.Schema, typed: bool, wanted):
    """Images of a block of events, one batch per table map and kind of event."""
    groups: dict[tuple, list[int]] = {}
    keys = zip(events.table_map, events.code, events.id_bytes, events.error)
    for i, group in enumerate(keys):
        groups.setdefault(group, []).append(i)
    for (table_map, code, id_bytes, error), members in groups.items():
        index = np.array(members)
        if error is not None:
            yield _output(schema, events, index, code, reason=error)
            continue
        if table_map is None:
            yield _output(schema, events, index, code, reason="no_schema")
            continue
        try:
            found = codec.parse_table_map(table_map, id_bytes)
        except (ValueError, IndexError, TypeError):
            yield _output(schema, events, index, code, reason="bad_table_map")
            continue
        if not is_wanted(found, wanted):
            continue
        if len(found["names"]) != len(found["type_codes"]):
            yield _output(schema, events, index, code, found, reason="no_column_names")
            continue
        yield from _decode_group(schema, events, index, code, id_bytes, found, typed)


def _decode_group(schema, events, index, code, id_bytes, found, typed):
    columns = list(zip(found["type_codes"], found["metas"], codec.unsigned_flags(found)))
    buf, event, offset, sides, reason = codec.read_images(
        [events.body[i] for i in index], columns, code, id_bytes)
    if len(event):
        try:
            images = [_image(schema.field("after").type, typed, found, columns, buf, side)
                      for side in sides]
        except pa.ArrowInvalid:
            # A logged type does not fit the declared row.
            reason[np.unique(event)] = "type_mismatch"
        else:
            yield _output(
                schema, events, index[event], code, found, offset,
                key_value=_key_value(found, columns, buf, sides[0]),
                before=None if code == S.WRITE_ROWS_V1 else images[0],
                after=None if code == S.DELETE_ROWS_V1 else images[-1])
    failed = np.flatnonzero(reason != None)  # noqa: E711 (element-wise)
    if len(failed):
        yield _output(schema, events, index[failed], code, found, reason=reason[failed])


def _key_value(found, columns, buf, side):
    """The key of each row as text, from its first image: the row before an update."""
    if len(found["pk"]) != 1 or found["pk"][0] >= len(columns):
        return None
    (kind, meta, _), (values, nulls) = columns[found["pk"][0]], side[found["pk"][0]]
    return codec.arrow_column(buf, values, nulls, kind, meta).cast(pa.string())


def _image(image_type, typed, found, columns, buf, side) -> pa.Array:
    arrays = {
        name: codec.arrow_column(buf, values, nulls, kind, meta)
        for name, (kind, meta, _), (values, nulls) in zip(found["names"], columns, side)}
    if not typed:
        return _json(arrays)
    size = len(side[0][1])
    fields = [image_type.field(i) for i in range(image_type.num_fields)]
    for f in fields:
        if f.name in arrays and not _holds(f.type, arrays[f.name].type):
            raise pa.ArrowInvalid(f"{f.name}: {arrays[f.name].type} does not fit {f.type}")
    return pa.StructArray.from_arrays(
        [_cast(arrays[f.name], f.type) if f.name in arrays else pa.nulls(size, f.type)
         for f in fields], fields=fields)


def _cast(values: pa.Array, target: pa.DataType) -> pa.Array:
    if pa.types.is_boolean(values.type) and pa.types.is_decimal(target):
        values = values.cast(pa.int8())
    return values.cast(target)


def _holds(target: pa.DataType, logged: pa.DataType) -> bool:
    """Whether ``target`` has room for every value of ``logged``. Decided by type alone, so that
    an event's fate does not depend on the values it shares a batch with. Text holds any value."""
    if target.equals(logged) or pa.types.is_null(logged) or pa.types.is_string(target):
        return True
    if pa.types.is_boolean(logged):
        return (pa.types.is_integer(target) or pa.types.is_floating(target)
                or pa.types.is_decimal(target))
    if pa.types.is_integer(logged):
        spare = 0 if pa.types.is_signed_integer(logged) else 1
        if pa.types.is_signed_integer(target):
            return target.bit_width >= logged.bit_width + spare
        if pa.types.is_floating(target):  # whole numbers a fraction holds exactly
            return logged.bit_width <= (16 if pa.types.is_float32(target) else 32)
        return (pa.types.is_decimal(target)
                and target.precision - target.scale >= {8: 3, 16: 5, 32: 10, 64: 20}[
                    logged.bit_width])
    return pa.types.is_float32(logged) and pa.types.is_float64(target)


def _json(arrays: dict[str, pa.Array]) -> pa.Array:
    """Columns as one JSON text per row, put together column-wise."""
    parts, lead = [], "{"
    for name, values in arrays.items():
        parts.append(lead + _quote(pa.array([name]))[0].as_py() + ":")
        lead = ","
        if pa.types.is_boolean(values.type):
            text = pc.if_else(values, "true", "false")
        elif pa.types.is_string(values.type):
            text = _quote(values)
        elif pa.types.is_floating(values.type):
            # JSON has no form for infinities and NaN: they are written as null.
            text = pc.if_else(pc.is_finite(values), values.cast(pa.string()), None)
        else:
            text = values.cast(pa.string())
        parts.append(pc.fill_null(text, "null"))
    parts.append("}")
    return pc.binary_join_element_wise(*parts, "")


def _quote(text: pa.Array) -> pa.Array:
    text = pc.replace_substring(text, "\\", "\\\\")
    text = pc.replace_substring(text, '"', '\\"')
    if pc.any(pc.match_substring_regex(text, "[\\x00-\\x1f]")).as_py():
        for control in range(0x20):
            text = pc.replace_substring(text, chr(control), f"\\u{control:04x}")
    return pc.binary_join_element_wise('"', text, '"', "")


def _output(schema, events: Events, index, code, found=None, offset=None, reason=None,
            key_value=None, before=None, after=None) -> pa.RecordBatch:
    size = len(index)
    start = 0 if offset is None else offset + S.HEADER_BYTES
    found = found or {}
    names, pk = found.get("names", []), found.get("pk", [])
    key = pk[0] if pk and pk[0] < len(names) else None
    same = {
        "database": found.get("database"), "table": found.get("table"), "type_code": code,
        "pk_names": [names[i] for i in pk if i < len(names)],
        "pk_type": None if key is None else found["type_codes"][key],
        "pk_unsigned": None if key is None else codec.unsigned_flags(found)[key],
        "reason": reason if isinstance(reason, str) else None,
    }
    varying = {
        "seq": pa.array((events.file_seq[index] << 32) + events.byte_off[index] + start,
                        mask=events.byte_off[index] >> 32 > 0),
        "log_file": events.log_file.take(pa.array(index)),
        "event_ts": events.event_ts.take(pa.array(index)),
        "server_id": events.server_id.take(pa.array(index)),
        "key_value": key_value, "before": before, "after": after,
    }
    if isinstance(reason, np.ndarray):
        varying["reason"] = pa.array(reason, pa.string())
    columns = []
    for field in schema:
        column = varying.get(field.name)
        if column is None:
            column = pa.repeat(pa.scalar(same.get(field.name), field.type), size)
        columns.append(column.cast(field.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)
