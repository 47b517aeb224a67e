"""Small log files for tests."""

import os

from tidemark import schemas as S
from tidemark.plans import packing as P


def write_file(folder, number, events, checksum=False, fmt=True):
    """A log file of (code, body[, when]) events; gives its path."""
    out = bytearray(S.LOG_MAGIC)
    if fmt:
        out += P.format_event(len(out), checksum)
    for code, body, *when in events:
        out += P.event(code, body, len(out), when[0] if when else 0, checksum=checksum)
    path = os.path.join(str(folder), P.log_name(number))
    with open(path, "wb") as f:
        f.write(bytes(out))
    return path


def table_map(columns, table_id=7, database="d", table="t"):
    return (S.TABLE_MAP_EVENT, P.table_map_body(table_id, database, table, columns))


def rows(columns, code, images, table_id=7, present=None):
    """A rows event; for an update ``images`` alternates before and after values."""
    packed = [P.image(columns, v) for v in images]
    return (code, P.rows_body(table_id, code, columns, packed, present))


KEY = ("_id", S.LONGLONG, b"", True, True)
