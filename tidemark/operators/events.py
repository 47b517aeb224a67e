"""Event-level projections, filters and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import schemas as S
from ..functions import log_seq
from .carry import RANGE_BITS, carry_last


def event_headers(log_events: DataFrame) -> DataFrame:
    """Typed header columns of every event; bodies are not carried along."""
    return log_events.select("log_file", "file_seq", "byte_off", "event_ts", "type_code",
                             "server_id", "event_size", "log_pos", "flags")


def _little_endian(body: Column, at: int, width: int) -> Column:
    """Unsigned number of ``width`` bytes from byte ``at`` (from 0) of a binary column; NULL if
    the body is shorter."""
    digits = F.hex(F.substring(body, at + 1, width))
    swapped = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(width))])
    return F.when(F.octet_length(body) >= at + width, F.conv(swapped, 16, 10).try_cast("bigint"))


def rotate_events(log_events: DataFrame) -> DataFrame:
    """The file and position that follow each rotate event: ``next_file``, ``next_pos`` (the first
    position of a file where it is 0 or missing) with the event's own place. A body that is too
    short gives a NULL ``next_file``."""
    position = F.coalesce(F.nullif(_little_endian(F.col("body"), 0, 8), F.lit(0)),
                          F.lit(S.FIRST_POSITION).cast("bigint"))
    name = F.decode(F.substring(F.col("body"), 9, 1 << 16), "utf-8")
    return log_events.filter(F.col("type_code") == S.ROTATE_EVENT).select(
        "log_file", "file_seq", "byte_off", F.nullif(name, F.lit("")).alias("next_file"),
        position.alias("next_pos"))


def format_events(log_events: DataFrame) -> DataFrame:
    """What each format event says about its file: ``log_version``, ``server_version``,
    ``created`` (seconds), ``header_length``, ``header_lengths`` (of the event types from 1 on) and
    ``checksum`` (0: none, 1: CRC32). Numbers of a body that is too short are NULL."""
    body, size = F.col("body"), F.octet_length("body")
    # Version, server version, created, header length; at the end the checksum's kind and value.
    fixed, tail = 2 + 50 + 4 + 1, 1 + S.CHECKSUM_BYTES
    lengths = F.transform(
        F.sequence(F.lit(fixed), size - tail - 1),
        lambda i: F.conv(F.hex(F.substring(body, i + 1, F.lit(1))), 16, 10).cast("int"))
    version = F.decode(F.substring(body, 3, 50), "utf-8")
    kind = F.conv(F.hex(F.substring(body, size - tail + 1, F.lit(1))), 16, 10).cast("int")
    return log_events.filter(F.col("type_code") == S.FORMAT_EVENT).select(
        "log_file", "file_seq", "byte_off",
        _little_endian(body, 0, 2).cast("int").alias("log_version"),
        F.rtrim(F.translate(version, "\0", " ")).alias("server_version"),
        _little_endian(body, 52, 4).alias("created"),
        _little_endian(body, 56, 1).cast("int").alias("header_length"),
        F.when(size > fixed + tail, lengths).alias("header_lengths"),
        F.when(size >= fixed + tail, kind).alias("checksum"))


def supported_events(events: DataFrame, code: str = "type_code") -> DataFrame:
    """Keep format, rotate, table-map and rows events (v1); drop the rest."""
    return events.filter(F.col(code).isin(*S.SUPPORTED_EVENTS))


def carry_position(events: DataFrame, by: list[str], order: str, position: str = "log_pos",
                   out: str = "position", bits: int = RANGE_BITS, levels: int = 2) -> DataFrame:
    """Position of each event; a "virtual" event (0) takes the last real one of its source."""
    return carry_last(events, by, order, F.nullif(F.col(position), F.lit(0)), out, bits=bits,
                      levels=levels)


def assign_segment(events: DataFrame, by: list[str], order: str, is_rotate: Column,
                   next_file: Column, next_pos: Column, first_file: str,
                   bits: int = RANGE_BITS, levels: int = 2) -> DataFrame:
    """Label the events of a concatenated feed with the log file they belong to.

    A rotate names the file that follows it; it is itself the last event of the file before.
    Adds ``segment`` and ``segment_start``.
    """
    target = F.when(is_rotate, F.struct(
        next_file.alias("segment"),
        F.coalesce(next_pos.cast("bigint"), F.lit(S.FIRST_POSITION).cast("bigint")).alias("start")))
    labelled = carry_last(events, by, order, target, "__segment", strict=True, bits=bits,
                          levels=levels)
    return labelled.select(
        *events.columns,
        F.coalesce(F.col("__segment.segment"), F.lit(first_file)).alias("segment"),
        F.coalesce(F.col("__segment.start"),
                   F.lit(S.FIRST_POSITION).cast("bigint")).alias("segment_start"))


def event_profile(events: DataFrame, code: str = "type_code", size: str = "event_size",
                  ts: str = "event_ts") -> DataFrame:
    """Count, bytes and time span per event type, including types that are never decoded."""
    return events.groupBy(code).agg(
        F.count("*").alias("n_events"), F.sum(size).alias("total_bytes"),
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def resume_from(df: DataFrame, file_seq: int, position: int, seq: str = "seq") -> DataFrame:
    """Rows after a (file, position): a plain comparison on ``seq``. A stored feed skips by it; of
    log files give ``start_file`` too, so that earlier ones are not opened."""
    return df.filter(F.col(seq) > F.lit((file_seq << 32) + position))


def with_seq(events: DataFrame) -> DataFrame:
    return events.withColumn("seq", log_seq("file_seq", "byte_off"))
