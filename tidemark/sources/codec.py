"""Bytes of a row-format log to Arrow columns, run inside tasks on one log file or one batch.

Splitting follows the chain of event sizes through a file. Decoding is columnar: all events of
a batch that share a table map are read in lock-step, the n-th image of every event at once, so
the work per image is a few array operations and not a Python loop over fields.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .. import schemas as S

_HEADER = "<IBIIIH"  # when, type, server id, size, end position, flags
_FORMAT = "<H50sIB"  # version, server version, created, header length
_FIXED = {  # (type, unsigned) -> numpy type
    (S.TINY, False): "i1", (S.TINY, True): "u1", (S.SHORT, False): "<i2", (S.SHORT, True): "<u2",
    (S.LONG, False): "<i4", (S.LONG, True): "<u4", (S.LONGLONG, False): "<i8",
    (S.LONGLONG, True): "<u8", (S.BOOL, False): "u1", (S.BOOL, True): "u1",
}


def packed_int(data, at: int) -> tuple[int | None, int]:
    """Length-prefixed integer at ``at``: (value, next position)."""
    first = data[at]
    if first < 251:
        return first, at + 1
    if first == 251:
        return None, at + 1
    width = {252: 2, 253: 3}.get(first, 8)
    return int.from_bytes(data[at + 1:at + 1 + width], "little"), at + 1 + width


# ---- splitting ----------------------------------------------------------------------------

def split_events(chunks, magic: bool = True, start: int = 0):
    """Yield (offset, header fields, body) per event of a file given as byte chunks, in order.
    With ``start`` the chunks begin there, where an event begins.

    Ends with (offset, None, reason) when the file is not a log or stops inside an event.
    """
    buf, base, at, started = b"", start, 0, not magic or start > 0
    for chunk in chunks:
        buf, base, at = buf[at:] + chunk, base + at, 0
        if not started and len(buf) >= len(S.LOG_MAGIC):
            if buf[:len(S.LOG_MAGIC)] != S.LOG_MAGIC:
                yield 0, None, "bad_magic"
                return
            started, at = True, len(S.LOG_MAGIC)
        while started and len(buf) - at >= S.HEADER_BYTES:
            head = struct.unpack_from(_HEADER, buf, at)
            size = head[3]
            if size < S.HEADER_BYTES:
                yield base + at, None, "bad_event_size"
                return
            if len(buf) - at < size:
                break
            yield base + at, head, buf[at + S.HEADER_BYTES:at + size]
            at += size
    if not started:
        yield 0, None, "bad_magic"
    elif at < len(buf):
        yield base + at, None, "truncated_event"


class LogState:
    """What later events of a file depend on: checksum, id widths, table maps by id."""

    def __init__(self):
        self.checksum = False
        self.map_id_bytes = self.rows_id_bytes = 6
        self.maps: dict[int, bytes] = {}

    def as_dict(self) -> dict:
        return {"checksum": self.checksum, "widths": [self.map_id_bytes, self.rows_id_bytes],
                "maps": {str(t): bytes(body).hex() for t, body in self.maps.items()}}

    @classmethod
    def from_dict(cls, known: dict) -> LogState:
        state = cls()
        state.checksum = known["checksum"]
        state.map_id_bytes, state.rows_id_bytes = known["widths"]
        state.maps = {int(t): bytes.fromhex(body) for t, body in known["maps"].items()}
        return state

    def format(self, body) -> str | None:
        fixed = struct.calcsize(_FORMAT)
        if (len(body) < fixed + S.CHECKSUM_BYTES + 1
                or struct.unpack_from(_FORMAT, body)[3] < S.HEADER_BYTES):
            return "bad_format_event"
        # The checksum algorithm is the fifth byte from the end, before the event's own checksum.
        lengths = body[fixed:-(S.CHECKSUM_BYTES + 1)]
        self.checksum = body[-(S.CHECKSUM_BYTES + 1)] == S.CHECKSUM_CRC32
        width = [4 if code <= len(lengths) and lengths[code - 1] == 6 else 6
                 for code in (S.TABLE_MAP_EVENT, S.WRITE_ROWS_V1)]
        self.map_id_bytes, self.rows_id_bytes = width
        return None


def log_rows(chunks, log_file: str, file_seq: int, magic: bool = True, begin: int = 0,
             limit: int | None = None, codes=None, bodies: bool = True,
             mark: tuple[int, dict] | None = None, every: int = 0, marks: list | None = None):
    """Rows of ``LOG_EVENTS`` for one file. With ``begin``/``limit`` only events that end in
    (begin, limit] are given; earlier ones still update the state, so their maps apply. A broken
    end is reported once the file is read without a limit: until then it may still grow. ``codes``
    keeps events of these types only, ``bodies=False`` their headers only.

    A mark is an event's offset and the state there: with ``mark`` the chunks begin at it, and
    ``marks`` gets one for every ``every`` bytes that are read."""
    state, last = LogState(), 0
    if mark is not None:
        last, state = mark[0], LogState.from_dict(mark[1])
    for off, head, body in split_events(chunks, magic, last):
        if head is None:
            if limit is None:
                yield (log_file, file_seq, off, None, None, None, None, None, None, None, None,
                       None, None, body)
            return
        when, code, server_id, size, log_pos, flags = head
        if limit is not None and off + size > limit:
            return
        if marks is not None and off - last >= every:
            marks.append((off, state.as_dict()))
            last = off
        # Positions are 32-bit numbers in the log and in ``seq``.
        error = "position_over_4gib" if off >> 32 else None
        table_id = table_map = id_bytes = None
        if code == S.FORMAT_EVENT:
            error = state.format(body) or error
        elif state.checksum:
            body = body[:-S.CHECKSUM_BYTES]
        if code == S.TABLE_MAP_EVENT:
            id_bytes = state.map_id_bytes
            table_id = int.from_bytes(body[:id_bytes], "little")
            state.maps[table_id] = body
        elif code in S.ROWS_EVENTS:
            id_bytes = state.rows_id_bytes
            table_id = int.from_bytes(body[:id_bytes], "little")
            table_map = state.maps.get(table_id)
        elif code not in S.SUPPORTED_EVENTS:
            body = None  # counted, never decoded
        if not bodies:
            body = table_map = None
        if off + size > begin and (codes is None or code in codes or error):
            yield (log_file, file_seq, off, when * 1_000_000, code, server_id, size, log_pos,
                   flags, id_bytes, table_id, body, table_map, error)


def blocks(rows, max_bytes: int = 8 << 20, max_rows: int = 50_000):
    """Lists of event rows of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += (row[6] or 0) + len(row[12] or b"")
        if size >= max_bytes or len(held) >= max_rows:
            yield held
            held, size = [], 0
    if held:
        yield held


def event_batches(rows, schema: pa.Schema):
    """Arrow batches from event rows."""
    for held in blocks(rows):
        yield _batch(held, schema)


def _batch(rows, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(values, type=field.type) for values, field in zip(zip(*rows), schema)],
        schema=schema)


# ---- table maps ---------------------------------------------------------------------------

def parse_table_map(body, id_bytes: int = 6) -> dict:
    """A schema message: names, types, metadata, null bits and the optional fields in use."""
    at = id_bytes + 2
    out = {"table_id": int.from_bytes(body[:id_bytes], "little")}
    for part in ("database", "table"):
        size, at = packed_int(body, at)
        out[part] = bytes(body[at:at + size]).decode("utf-8", "replace")
        at += size + 1  # the name's closing zero
    count, at = packed_int(body, at)
    types = list(body[at:at + count])
    at += count
    metas, nulls = [0] * count, [True] * count
    if at < len(body):
        size, at = packed_int(body, at)
        if size > 4 * count or size != sum(S.META_BYTES.get(t, 0) for t in types):
            raise ValueError("bad_metadata_size")
        for i, t in enumerate(types):
            width = S.META_BYTES.get(t, 0)
            metas[i] = int.from_bytes(body[at:at + width], "little")
            at += width
        nulls = [bool(body[at + i // 8] >> i % 8 & 1) for i in range(count)]
        at += (count + 7) // 8
    out.update(type_codes=types, metas=metas, nulls=nulls, names=[], pk=[], signedness=[])
    while at < len(body):
        field = body[at]
        size, start = packed_int(body, at + 1)
        at = start + size
        if field == S.SIGNEDNESS_FIELD:  # most significant bit first
            out["signedness"] = [bool(b >> 7 - i & 1) for b in body[start:at] for i in range(8)]
        elif field == S.COLUMN_NAME_FIELD:
            while start < at:
                size, start = packed_int(body, start)
                out["names"].append(bytes(body[start:start + size]).decode("utf-8", "replace"))
                start += size
        elif field == S.SIMPLE_PK_FIELD:
            while start < at:
                ordinal, start = packed_int(body, start)
                out["pk"].append(ordinal)
    return out


def unsigned_flags(table_map: dict) -> list[bool]:
    """Unsigned or not per column: the n-th bit belongs to the n-th numeric column."""
    bits = iter(table_map["signedness"])
    return [next(bits, False) if t in S.SIGNED_TYPES else False
            for t in table_map["type_codes"]]


# ---- row images ---------------------------------------------------------------------------

def _take(buf, at, width):
    return buf[np.minimum(at, len(buf) - width)[:, None] + np.arange(width)]


def _read_column(buf, at, nulls, kind, meta, unsigned):
    """Values of one column at ``at``: (column, bytes used, accepted)."""
    if kind in (S.VARCHAR, S.STRING):
        if kind == S.STRING and meta & 0xFF != S.STRING:
            return None, 0, False
        prefix = 2 if kind == S.VARCHAR and meta > 255 else 1
        length = _take(buf, at, prefix).view("u1" if prefix == 1 else "<u2").ravel()
        length = np.where(nulls, 0, length).astype(np.int64)
        return (at + prefix, length), length + prefix, True
    if kind == S.INT24:
        raw = _take(buf, at, 3).astype(np.int32)
        value = raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16
        return (value if unsigned else (value ^ 0x800000) - 0x800000), 3, True
    if kind in (S.FLOAT, S.DOUBLE):
        width = 4 if meta == 4 else 8
        return _take(buf, at, width).view(f"<f{width}").ravel(), width, meta in (4, 8)
    dtype = _FIXED.get((kind, unsigned))
    if dtype is None:
        return None, 0, False
    width = np.dtype(dtype).itemsize
    value = _take(buf, at, width).view(dtype).ravel()
    return (value != 0 if kind == S.BOOL else value), width, True


def _read_image(buf, at, columns):
    """One image per position: ([(column, nulls)], next positions, hit an unaccepted type)."""
    count = len(columns)
    bits = np.unpackbits(_take(buf, at, (count + 7) // 8), axis=1, bitorder="little")
    at = at + (count + 7) // 8
    refused = np.zeros(len(at), bool)
    image = []
    for i, (kind, meta, unsigned) in enumerate(columns):
        nulls = bits[:, i] == 1
        column, used, accepted = _read_column(buf, at, nulls, kind, meta, unsigned)
        if not accepted:
            refused |= ~nulls
        image.append((column, nulls))
        at = at + np.where(nulls, 0, used)
    return image, at, refused


def _headers(buf, base, sizes, columns, code: int, id_bytes: int):
    """(start of the images, reason) per event. All events of a table have headers of one
    length: id, flags, column count, one bitmap of present columns per image of a pair."""
    count, n = len(columns), len(base)
    packed = bytes([count]) if count < 251 else b"\xfc" + struct.pack("<H", count)
    width = (count + 7) // 8
    maps = 2 if code == S.UPDATE_ROWS_V1 else 1
    at = id_bytes + 2
    start = at + len(packed) + maps * width
    reason = np.full(n, None, object)
    present = _take(buf, base + at + len(packed), maps * width).reshape(n * maps, width)
    bits = np.unpackbits(present, axis=1, bitorder="little")[:, :count]
    reason[~bits.all(axis=1).reshape(n, maps).all(axis=1)] = "partial_image"
    counted = (_take(buf, base + at, len(packed)) == np.frombuffer(packed, np.uint8)).all(axis=1)
    reason[~counted | (sizes < start)] = "bad_width"
    return base + start, reason


#: Fewer unread events than this are walked one by one to find where their images begin.
_FEW = 8


def _column_widths(columns) -> list[tuple[int, int]]:
    """(bytes, length prefix) per column: one of them is not 0; both are for a refused type."""
    widths = []
    for kind, meta, unsigned in columns:
        if kind in (S.VARCHAR, S.STRING):
            fits = kind == S.VARCHAR or meta & 0xFF == S.STRING
            widths.append((0, (2 if kind == S.VARCHAR and meta > 255 else 1) if fits else 0))
        elif kind == S.INT24:
            widths.append((3, 0))
        elif kind in (S.FLOAT, S.DOUBLE):
            widths.append((meta if meta in (4, 8) else 0, 0))
        else:
            dtype = _FIXED.get((kind, unsigned))
            widths.append((np.dtype(dtype).itemsize if dtype else 0, 0))
    return widths


def _image_starts(data: bytes, at: int, end: int, widths, per_row: int) -> list[int]:
    """Where the images (pairs) of one event begin; the last one may be unreadable."""
    mask = (len(widths) + 7) // 8
    starts = []
    while at < end:
        starts.append(at)
        for _ in range(per_row):
            nulls = int.from_bytes(data[at:at + mask], "little")
            at += mask
            for i, (width, prefix) in enumerate(widths):
                if nulls >> i & 1:
                    continue
                if prefix:
                    at += prefix + int.from_bytes(data[at:at + prefix], "little")
                elif width:
                    at += width
                else:
                    return starts
            if at > end:
                return starts
    return starts


def read_images(bodies, columns: list[tuple], code: int, id_bytes: int):
    """All images of events that share ``columns``: (buffer, event index, offset in the event,
    [images], reason per event). An event that cannot be read to its end gives no images."""
    pairs = code == S.UPDATE_ROWS_V1
    sizes = np.array([len(b) for b in bodies], np.int64)
    base = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    data = b"".join(bodies) + bytes(16 + 2 * len(columns))
    buf = np.frombuffer(data, np.uint8)
    at, reason = _headers(buf, base, sizes, columns, code, id_bytes)
    end = base + sizes
    at = np.where(reason == None, at, end)  # noqa: E711 (element-wise)
    steps = []
    while True:
        live = np.flatnonzero(at < end)
        if not len(live):
            break
        here = at[live]
        if len(live) < _FEW:
            # An event of many images would be read image by image: find them first instead.
            widths = _column_widths(columns)
            found = [_image_starts(data, int(at[e]), int(end[e]), widths, 2 if pairs else 1)
                     for e in live]
            at[live] = end[live]
            live = np.repeat(live, [len(x) for x in found])
            here = np.array([start for x in found for start in x], np.int64)
        images, refused, after = [], np.zeros(len(live), bool), here
        for _ in range(2 if pairs else 1):
            image, after, bad = _read_image(buf, after, columns)
            images.append(image)
            refused |= bad
        overrun = after > end[live]
        reason[live[overrun]] = "bad_image"
        reason[live[refused]] = "unsupported_type"
        at[live] = np.maximum(at[live], np.where(refused | overrun, end[live], after))
        steps.append((live, here - base[live], images))
    keep = [np.array([r is None for r in reason[s[0]]], bool) for s in steps]
    event = np.concatenate([s[0][k] for s, k in zip(steps, keep)] or [np.zeros(0, np.int64)])
    offset = np.concatenate([s[1][k] for s, k in zip(steps, keep)] or [np.zeros(0, np.int64)])
    joined = [
        [_join_column([s[2][side][i] for s in steps], keep) for i in range(len(columns))]
        for side in range(2 if pairs else 1)
    ]
    return buf, event, offset, joined, reason


def _join_column(parts, keep):
    """One column over all steps, without the images of unreadable events."""
    nulls = np.concatenate([n[k] for (_, n), k in zip(parts, keep)] or [np.zeros(0, bool)])
    columns = [c for c, _ in parts]
    if not columns or columns[0] is None:
        return None, nulls
    if isinstance(columns[0], tuple):
        return tuple(np.concatenate([c[j][k] for c, k in zip(columns, keep)])
                     for j in range(2)), nulls
    return np.concatenate([c[k] for c, k in zip(columns, keep)]), nulls


def _text(buf, start, length, nulls) -> pa.Array:
    """Gather (start, length) slices of the buffer into one string array."""
    ends = np.zeros(len(start) + 1, np.int64)
    np.cumsum(length, out=ends[1:])
    data = buf[np.repeat(start - ends[:-1], length) + np.arange(ends[-1])]
    valid = np.packbits(~nulls, bitorder="little")
    return pa.Array.from_buffers(
        pa.string(), len(start),
        [pa.py_buffer(valid), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def arrow_column(buf, column, nulls, kind: int, meta: int) -> pa.Array:
    """A decoded column as Arrow. Text bytes that are not UTF-8 are replaced by U+FFFD, in both
    kinds of text; fixed-width text is then padded to its length in characters."""
    if column is None:
        return pa.nulls(len(nulls))
    if not isinstance(column, tuple):
        return pa.array(column, mask=nulls)
    text = _text(buf, *column, nulls)
    try:
        text.validate(full=True)
    except pa.ArrowInvalid:
        text = pa.array([None if b is None else b.decode("utf-8", "replace")
                         for b in text.cast(pa.binary()).to_pylist()], pa.string())
    return pc.utf8_rpad(text, (meta >> 8) // 4, " ") if kind == S.STRING else text
