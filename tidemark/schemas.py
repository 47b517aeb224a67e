"""Canonical DataFrame schemas and the fixed values of the log format."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values of the row-format log -------------------------------------------------
LOG_MAGIC = b"\xfebin"
HEADER_BYTES = 19
CHECKSUM_BYTES = 4
CHECKSUM_CRC32 = 1
FIRST_POSITION = 4

QUERY_EVENT = 2
ROTATE_EVENT = 4
FORMAT_EVENT = 15
TABLE_MAP_EVENT = 19
WRITE_ROWS_V1 = 23
UPDATE_ROWS_V1 = 24
DELETE_ROWS_V1 = 25
ROWS_EVENTS = (WRITE_ROWS_V1, UPDATE_ROWS_V1, DELETE_ROWS_V1)
SUPPORTED_EVENTS = (ROTATE_EVENT, FORMAT_EVENT, TABLE_MAP_EVENT) + ROWS_EVENTS

TINY, SHORT, LONG, FLOAT, DOUBLE = 1, 2, 3, 4, 5
LONGLONG, INT24, VARCHAR, BOOL, STRING = 8, 9, 15, 244, 254
NEWDECIMAL = 246
ACCEPTED_TYPES = (TINY, SHORT, LONG, FLOAT, DOUBLE, LONGLONG, INT24, VARCHAR, BOOL, STRING)
# One signedness bit is logged per column of these types, none for the others.
SIGNED_TYPES = (TINY, SHORT, LONG, FLOAT, DOUBLE, LONGLONG, INT24, BOOL, NEWDECIMAL)
# Bytes of type metadata per column; types not listed carry none.
META_BYTES = {
    4: 1, 5: 1, 15: 2, 16: 2, 17: 1, 18: 1, 19: 1, 242: 1, 245: 1, 246: 2, 247: 2,
    248: 2, 249: 1, 250: 1, 251: 1, 252: 1, 253: 2, 254: 2, 255: 1,
}
SIGNEDNESS_FIELD, COLUMN_NAME_FIELD, SIMPLE_PK_FIELD = 1, 4, 8
# ------------------------------------------------------------------------------------------

KEY_COLUMN = "_id"
KEY_DIGITS = 24

INSERT, UPDATE, DELETE = "INSERT", "UPDATE", "DELETE"

# log_pos is the position the event claims to end at; byte_off is where it was read.
# table_id and table_map are filled for rows events: the map in force at that position.
LOG_EVENTS = T.StructType([
    T.StructField("log_file", T.StringType()),
    T.StructField("file_seq", T.IntegerType()),
    T.StructField("byte_off", T.LongType()),
    T.StructField("event_ts", T.TimestampType()),
    T.StructField("type_code", T.IntegerType()),
    T.StructField("server_id", T.LongType()),
    T.StructField("event_size", T.LongType()),
    T.StructField("log_pos", T.LongType()),
    T.StructField("flags", T.IntegerType()),
    T.StructField("id_bytes", T.IntegerType()),
    T.StructField("table_id", T.LongType()),
    T.StructField("body", T.BinaryType()),
    T.StructField("table_map", T.BinaryType()),
    T.StructField("error", T.StringType()),
])

COLUMN_INFO = T.StructType([
    T.StructField("ordinal", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("type_code", T.IntegerType()),
    T.StructField("meta", T.IntegerType()),
    T.StructField("unsigned", T.BooleanType()),
    T.StructField("is_pk", T.BooleanType()),
    T.StructField("nullable", T.BooleanType()),
])


def spark_type(type_code: int, meta: int = 0, unsigned: bool = False) -> T.DataType:
    """Spark type that holds every value of a logged column type."""
    plain = {
        TINY: (T.ByteType(), T.ShortType()),
        SHORT: (T.ShortType(), T.IntegerType()),
        INT24: (T.IntegerType(), T.IntegerType()),
        LONG: (T.IntegerType(), T.LongType()),
        LONGLONG: (T.LongType(), T.DecimalType(20, 0)),
        BOOL: (T.BooleanType(), T.BooleanType()),
        VARCHAR: (T.StringType(), T.StringType()),
        STRING: (T.StringType(), T.StringType()),
    }
    if type_code in (FLOAT, DOUBLE):
        return T.FloatType() if meta == 4 else T.DoubleType()
    if type_code not in plain:
        raise ValueError(f"column type {type_code} is not accepted")
    return plain[type_code][bool(unsigned)]


def row_type(columns) -> T.StructType:
    """Row struct of a table from its column descriptions (``COLUMN_INFO`` rows)."""
    return T.StructType([
        T.StructField(c["name"], spark_type(c["type_code"], c["meta"], c["unsigned"]))
        for c in columns
    ])
