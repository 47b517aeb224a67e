"""One query per operator, over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas as S
from ..functions import (
    build_document, cast_columns, char_pad, classify_op, document_field, format_key,
    int24_sign, log_seq, masked, null_mask,
)
from ..operators import (
    LOG_RANGE_BITS, apply_changes, apply_deletes, apply_inserts, apply_multi_table, apply_updates,
    assign_segment, carry_position, change_metrics, column_catalog, event_headers,
    event_profile, format_events, live_row_timeline, read_key_sketches,
    reject_types, resume_from, rotate_events, schema_asof, schema_history, split_valid, state_as_of,
    supported_events, tap, unmatched_rows, validate_key, write_key_sketches,
)
from ..sources.binlog import (
    binlog_scan, decode_rows, read_changes, read_images, table_maps, tables_row_type,
)
from ..sources.datasource import list_logs
from ..sources.ranges import range_lookup, range_scan, write_ranges
from ..sources.scratch import drop, new_path, shared_folder
from ..sources.store import (
    apply_late, create_store, merge_changes, read_store, state_from_snapshots, store_lookup,
    take_snapshot,
)
from ..sources.tables import (
    create_target, full_refresh, key_lookup, route_changes, route_typed, snapshot_scan,
    state_to_json, typed_targets,
)
from ..streaming import (
    apply_stream, binlog_stream, change_stream, maintain_store, publish, read_metrics, read_state,
    resolve_stream, route_stream, state_per_core, stream_metrics,
)
from . import feeds
from .packing import log_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn
    return register


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def _event_code() -> Column:
    """Log event code for an event type of ``events``; purchases stand for QUERY events."""
    kind = F.col("event_type")
    return (F.when(kind == "signup", S.WRITE_ROWS_V1).when(kind == "error", S.DELETE_ROWS_V1)
            .when(kind == "purchase", S.QUERY_EVENT).otherwise(S.UPDATE_ROWS_V1))


# ---- scans, sources, sinks ----------------------------------------------------------------

@query("resume_from")
def _resume_from(spark, sf_dir):
    feed = feeds.user_changes(spark, sf_dir)
    middle = _middle(feed)
    feed = feed.withColumn(
        "seq", log_seq(F.floor(F.col("seq") / 1000), S.FIRST_POSITION + F.col("seq") % 1000))
    return resume_from(feed, middle // 1000, S.FIRST_POSITION + middle % 1000).select(
        "key", "op", "seq", F.col("after.value").alias("value"))


@query("snapshot_scan")
def _snapshot_scan(spark, sf_dir):
    database = f"tidemark_{uuid.uuid4().hex}"
    create_target(apply_changes(feeds.user_changes(spark, sf_dir)), database, "users",
                  shared_folder(spark))
    return snapshot_scan(spark, database, "users")


@query("route_changes")
def _route_changes(spark, sf_dir):
    root = new_path(spark, "routed")
    route_changes(feeds.mixed_feed(spark, sf_dir), root)
    # One folder per target: count per folder, which also shows the pruned partition columns.
    return spark.read.parquet(root).groupBy("database", "table", "op").agg(
        F.count("*").alias("n_changes"), F.count_distinct("key").alias("n_keys"))


@query("route_typed")
def _route_typed(spark, sf_dir):
    """The log's tables, made from its own schema messages; counted per catalog table."""
    root = new_path(spark, "typed")
    good, _ = split_valid(read_changes(spark, log_folder(spark, sf_dir)))
    route_changes(good.select("database", "table", "key", "op", "seq", "after"), f"{root}/feed")
    maps = table_maps(_log_events(spark, sf_dir, codes=(S.TABLE_MAP_EVENT,)))
    made = route_typed(spark.read.parquet(f"{root}/feed"), typed_targets(column_catalog(maps)),
                       root, prefix=f"tidemark_{uuid.uuid4().hex}_")
    counts = [snapshot_scan(spark, *name).groupBy(F.lit(name[1]).alias("table")).agg(
        F.count("*").alias("n_rows"), F.sum("event_id").alias("event_ids"),
        F.count("value").alias("n_values")) for name in made]
    return counts[0].unionByName(counts[1])


@query("route_stream")
def _route_stream(spark, sf_dir):
    """As ``route_typed``, from a stream of log files; tables are made in the batch that shows them."""
    root = new_path(spark, "routed")
    route_stream(binlog_stream(spark, log_folder(spark, sf_dir), max_files=8), root,
                 f"{root}/checkpoint", buckets=8, availableNow=True).awaitTermination()
    made = publish(spark, root, f"{root}/published", prefix=f"tidemark_{uuid.uuid4().hex}_")
    counts = [snapshot_scan(spark, *name).groupBy(F.lit(name[1]).alias("table")).agg(
        F.count("*").alias("n_rows"), F.sum("event_id").alias("event_ids"),
        F.count("value").alias("n_values")) for name in made]
    return counts[0].unionByName(counts[1])


@query("full_refresh")
def _full_refresh(spark, sf_dir):
    return full_refresh(feeds.user_changes(spark, sf_dir), new_path(spark, "state"))


@query("state_to_json")
def _state_to_json(spark, sf_dir):
    docs = state_to_json(apply_changes(feeds.user_changes(spark, sf_dir)))
    return docs.select(
        "key", F.get_json_object("doc", "$.event_type").alias("event_type"),
        F.get_json_object("doc", "$.value").cast("double").alias("value"),
        F.get_json_object("doc", "$.k").cast("int").alias("k"))


# ---- events -------------------------------------------------------------------------------

@query("supported_events")
def _supported_events(spark, sf_dir):
    events = feeds.read(spark, sf_dir, "events").withColumn("type_code", _event_code())
    return supported_events(events).select("event_id", "user_id", "type_code", "value")


@query("carry_position")
def _carry_position(spark, sf_dir):
    events = feeds.read(spark, sf_dir, "events").select(
        "user_id", "event_id",
        F.when(F.col("event_type") == "view", F.lit(0).cast("bigint"))
        .otherwise(F.col("event_id") + S.FIRST_POSITION).alias("log_pos"))
    return carry_position(events, ["user_id"], "event_id")


@query("assign_segment")
def _assign_segment(spark, sf_dir):
    events = feeds.read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    name = F.concat(F.lit("mysql-bin."), F.lpad(F.col("event_id").cast("string"), 12, "0"))
    return assign_segment(
        events, ["user_id"], "event_id", F.col("event_type") == "signup", name,
        F.when(F.col("event_id") % 2 == 0, F.col("event_id")), "mysql-bin.000000000000")


@query("event_profile")
def _event_profile(spark, sf_dir):
    events = feeds.read(spark, sf_dir, "events").select(
        "event_type", F.length("props").cast("bigint").alias("event_size"), "ts")
    profile = event_profile(events, code="event_type", ts="ts")
    return profile.select(
        "event_type", "n_events", "total_bytes",
        feeds.utc_micros(F.col("first_ts")).alias("first_us"),
        feeds.utc_micros(F.col("last_ts")).alias("last_us"))


@query("classify_op")
def _classify_op(spark, sf_dir):
    return feeds.read(spark, sf_dir, "events").select(
        "event_id", classify_op(_event_code()).alias("op"))


@query("key_lookup")
def _key_lookup(spark, sf_dir):
    path = new_path(spark, "state")
    state = full_refresh(feeds.user_changes(spark, sf_dir), path)
    return key_lookup(state, "000000000000000000000001")


# ---- schema resolution --------------------------------------------------------------------

def _paired(spark, sf_dir):
    feed = feeds.schema_feed(spark, sf_dir)
    schema = F.struct(F.col("seq").alias("seq"), F.col("value").alias("value"))
    return schema_asof(feed, ["table_id"], "seq", F.col("is_schema"), schema)


@query("schema_asof")
def _schema_asof(spark, sf_dir):
    return _paired(spark, sf_dir).select(
        "table_id", "seq", "value", F.col("schema.seq").alias("schema_seq"),
        F.col("schema.value").alias("schema_value"))


@query("unmatched_rows")
def _unmatched_rows(spark, sf_dir):
    return unmatched_rows(_paired(spark, sf_dir)).select("table_id", "seq", "value", "reason")


# ---- row images ---------------------------------------------------------------------------

@query("null_mask")
def _null_mask(spark, sf_dir):
    events = feeds.read(spark, sf_dir, "events").withColumn(
        "mask", null_mask(F.col("event_id"), 3))
    return events.select(
        "event_id", *[F.get("mask", F.lit(i)).alias(f"null_{i}") for i in range(3)],
        masked("user_id", "mask", 0).alias("user_id"),
        masked("event_type", "mask", 1).alias("event_type"),
        masked("value", "mask", 2).alias("value"))


@query("cast_columns")
def _cast_columns(spark, sf_dir):
    events = feeds.read(spark, sf_dir, "events").select(
        "event_id", "props", F.col("user_id").cast("string").alias("id"),
        (F.col("event_id") * 7 - 20000).cast("string").alias("s"),
        F.col("value").cast("string").alias("d"), "event_type")
    typed = cast_columns(events, [
        {"name": "id", "type_code": S.LONGLONG, "unsigned": True},
        {"name": "s", "type_code": S.SHORT},
        {"name": "d", "type_code": S.DOUBLE, "meta": 8},
        {"name": "event_type", "type_code": S.VARCHAR, "meta": 80},
    ])
    typed = cast_columns(typed, [{"name": "k", "type_code": S.TINY}], source="props")
    return typed.select(
        "event_id", F.col("id").cast("string").alias("id"), F.col("s").cast("int").alias("s"),
        "d", "event_type", F.col("k").cast("int").alias("k"))


@query("int24_sign")
def _int24_sign(spark, sf_dir):
    events = feeds.read(spark, sf_dir, "events")
    raw = (F.col("event_id") * 7919 % 16777216).cast("int")
    return events.select("event_id", int24_sign(raw).alias("signed_value"))


@query("char_pad")
def _char_pad(spark, sf_dir):
    return feeds.read(spark, sf_dir, "customer").select(
        "c_custkey", char_pad("c_mktsegment", 16).alias("segment"))


@query("format_key")
def _format_key(spark, sf_dir):
    return feeds.read(spark, sf_dir, "events").select(
        "event_id", format_key("event_id").alias("key"))


def _keyed_events(spark, sf_dir):
    """Events with the key description a table map would give, broken for some event kinds."""
    kind = F.col("event_type")
    return feeds.read(spark, sf_dir, "events").select(
        "event_id",
        F.when(kind == "click", F.array(F.lit("_id"), F.lit("part")))
        .when(kind == "view", F.array(F.lit("user_id")))
        .otherwise(F.array(F.lit("_id"))).alias("pk_names"),
        F.when((kind != "error") | (_k() >= 30), F.col("user_id")).alias("key_value"),
        F.when(_k() < 90, S.LONGLONG).otherwise(S.LONG).alias("pk_type"),
        (_k() >= 10).alias("pk_unsigned"))


@query("validate_key")
def _validate_key(spark, sf_dir):
    return validate_key(_keyed_events(spark, sf_dir)).select("event_id", "key", "reason")


@query("validate_key_split")
def _validate_key_split(spark, sf_dir):
    good, bad = split_valid(validate_key(_keyed_events(spark, sf_dir)))
    return good.select("event_id", "key", F.lit(None).cast("string").alias("reason")).unionByName(
        bad.select("event_id", "key", "reason"))


@query("reject_types")
def _reject_types(spark, sf_dir):
    catalog = feeds.read(spark, sf_dir, "events").select(
        F.col("user_id").alias("table_id"), F.col("event_id").alias("ordinal"),
        F.col("event_type").alias("name"), (F.col("event_id") % 256).cast("int").alias("type_code"))
    return reject_types(catalog)


@query("build_document")
def _build_document(spark, sf_dir):
    doc = build_document("user_id", "event_type", F.when(_k() < 50, F.col("value")).alias("value"),
                         k=_k())
    docs = feeds.read(spark, sf_dir, "events").select("event_id", doc.alias("doc"))
    return docs.select(
        "event_id", document_field("doc", "user_id", "bigint").alias("user_id"),
        document_field("doc", "event_type", "string").alias("event_type"),
        document_field("doc", "value", "double").alias("value"),
        document_field("doc", "k", "int").alias("k"),
        document_field("doc", "absent", "int").alias("absent"))


# ---- applying changes ---------------------------------------------------------------------

def _middle(feed) -> int:
    """The middle of the positions of a feed."""
    low, high = feed.agg(F.min("seq"), F.max("seq")).first()
    return ((low or 0) + (high or 0)) // 2


def _current(feed, **kwargs):
    """Current rows of a feed with numeric ids; the key text is made for live rows only."""
    state = apply_changes(feed, by=("id",), **kwargs)
    return state.select(format_key("id", integer=True).alias("key"), *[c for c in state.columns if c != "id"])


def _line_feed(spark, sf_dir):
    """The lines of feed D: everything but the inserts of the orders."""
    return feeds.order_changes(spark, sf_dir).filter(F.col("op") != S.INSERT)


@query("apply_inserts")
def _apply_inserts(spark, sf_dir):
    inserts = _line_feed(spark, sf_dir).withColumn("op", F.lit(S.INSERT))
    return apply_inserts(feeds.order_rows(spark, sf_dir), inserts)


@query("apply_deletes")
def _apply_deletes(spark, sf_dir):
    return apply_deletes(feeds.order_rows(spark, sf_dir), _line_feed(spark, sf_dir))


@query("apply_updates")
def _apply_updates(spark, sf_dir):
    return apply_updates(feeds.order_rows(spark, sf_dir), _line_feed(spark, sf_dir))


@query("apply_changes")
def _apply_changes(spark, sf_dir):
    return _current(feeds.user_changes(spark, sf_dir))


@query("apply_changes_orders")
def _apply_changes_orders(spark, sf_dir):
    return _current(feeds.order_changes(spark, sf_dir))


@query("apply_changes_join_back")
def _apply_changes_join_back(spark, sf_dir):
    return _current(feeds.order_changes(spark, sf_dir), strategy="join_back")


@query("apply_changes_text_key")
def _apply_changes_text_key(spark, sf_dir):
    return apply_changes(feeds.order_changes(spark, sf_dir))


@query("apply_changes_on_state")
def _apply_changes_on_state(spark, sf_dir):
    """The feed in two halves: a stored state, then the rest on top, with some re-delivered."""
    feed = feeds.user_changes(spark, sf_dir)
    middle = _middle(feed)
    state = full_refresh(feed.filter(F.col("seq") <= middle), new_path(spark, "state"))
    return apply_changes(feed, state, high_water=middle)


@query("state_as_of")
def _state_as_of(spark, sf_dir):
    feed = feeds.user_changes(spark, sf_dir)
    return state_as_of(feed, _middle(feed))


@query("state_from_snapshots")
def _state_from_snapshots(spark, sf_dir):
    """Snapshots at quarters of the feed, taken while every seventh change was late; these are put
    in afterwards. The state at five eighths is the second snapshot and what follows it."""
    feed = feeds.user_changes(spark, sf_dir)
    low, high = feed.agg(F.coalesce(F.min("seq"), F.lit(0)), F.coalesce(F.max("seq"), F.lit(0))) \
        .first()
    target = new_path(spark, "snapshots")
    create_store(spark, target, buckets=16)
    late = F.col("seq") % 7 == 3
    for quarter in (1, 2, 3):
        take_snapshot(feed.filter(~late), target, low + (high - low) * quarter // 4)
    apply_late(feed.filter(late), target)
    return state_from_snapshots(feed, target, low + (high - low) * 5 // 8)


@query("merge_changes")
def _merge_changes(spark, sf_dir):
    """Feed D merged into a store of buckets in three parts, the last one delivered twice."""
    target = new_path(spark, "store")
    # The feed is made once; a part reads its own folder of it.
    feed = feeds.order_changes(spark, sf_dir).select(
        "id", "op", "seq", "after", (F.col("seq") % 3).alias("part"))
    feed.write.partitionBy("part").parquet(f"{target}-feed")
    feed = spark.read.schema(feed.schema).parquet(f"{target}-feed")
    create_store(spark, target, by=("id",), buckets=16)
    for part in (2, 0, 1, 1):
        merge_changes(feed.filter(F.col("part") == part), target)
    drop(spark, f"{target}-feed")
    state = read_store(spark, target)
    return state.select(format_key("id", integer=True).alias("key"), "status", "price", "last_seq")


@query("store_lookup")
def _store_lookup(spark, sf_dir):
    target = new_path(spark, "store")
    create_store(spark, target, buckets=16)
    merge_changes(feeds.user_changes(spark, sf_dir), target)
    return store_lookup(spark, target, "000000000000000000000001")


def _ranged(spark, sf_dir) -> str:
    """The state of feed A, refreshed and clustered by its key."""
    target = new_path(spark, "ranges")
    state = full_refresh(feeds.user_changes(spark, sf_dir), new_path(spark, "state"))
    write_ranges(state, target, files=16)
    return target


@query("range_lookup")
def _range_lookup(spark, sf_dir):
    return range_lookup(spark, _ranged(spark, sf_dir), "000000000000000000000001")


@query("range_scan")
def _range_scan(spark, sf_dir):
    return range_scan(spark, _ranged(spark, sf_dir), "000000000000000000000010",
                      "000000000000000000000500")


@query("live_row_timeline")
def _live_row_timeline(spark, sf_dir):
    return live_row_timeline(feeds.user_changes(spark, sf_dir))


@query("apply_multi_table")
def _apply_multi_table(spark, sf_dir):
    state = apply_multi_table(_mixed_images(spark, sf_dir))
    return state.select(
        "database", "table", "key",
        document_field("doc", "event_type", "string").alias("event_type"),
        document_field("doc", "value", "double").alias("value"),
        document_field("doc", "k", "int").alias("k"),
        document_field("doc", "status", "string").alias("status"),
        document_field("doc", "price", "double").alias("price"), "last_seq")


def _mixed_images(spark, sf_dir):
    return feeds.mixed_feed(spark, sf_dir).withColumn(
        "after", F.struct(F.col("after").alias("doc")))


# ---- observation --------------------------------------------------------------------------

@query("change_metrics")
def _change_metrics(spark, sf_dir):
    return change_metrics(feeds.mixed_feed(spark, sf_dir))


@query("stream_metrics")
def _stream_metrics(spark, sf_dir):
    """As ``change_metrics``, from a stream of four files in no order."""
    path = new_path(spark, "metrics")
    feed = feeds.mixed_feed(spark, sf_dir).select("database", "table", "key", "op", "seq")
    feed.repartition(4, "seq", "key").write.parquet(f"{path}/feed")
    changes = (spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", "2")
               .parquet(f"{path}/feed"))
    stream_metrics(changes, f"{path}/target", f"{path}/checkpoint",
                   availableNow=True).awaitTermination()
    return read_metrics(spark, f"{path}/target")


@query("key_sketches")
def _key_sketches(spark, sf_dir):
    """Sketches stored per log file, merged and held against the exact distinct counts."""
    path = new_path(spark, "sketches")
    changes = feeds.user_changes(spark, sf_dir)
    # A file for every 4,096 events.
    write_key_sketches(changes.withColumn("seq", F.shiftleft(F.shiftright("seq", 12), 32)
                                          + F.col("seq") % 4096), path)
    by = ["database", "table", "op"]
    exact = changes.groupBy(*by).agg(F.countDistinct("id").alias("distinct_keys"))
    merged = read_key_sketches(spark, path, top=1).withColumnRenamed("distinct_keys", "estimate")
    return merged.join(exact, by).select(
        *by, "n_changes", "distinct_keys",
        (F.abs(F.col("estimate") - F.col("distinct_keys")) <= 0.1 * F.col("distinct_keys"))
        .alias("estimate_within_a_tenth"))


@query("tap")
def _tap(spark, sf_dir):
    watched = tap(feeds.user_changes(spark, sf_dir), f"users-{uuid.uuid4().hex}",
                  F.count(F.lit(1)).alias("n_records"))
    return apply_changes(watched)


# ---- log files: the events table packed to bytes, scanned and decoded ---------------------

def _log_events(spark, sf_dir, **kwargs):
    return binlog_scan(spark, log_folder(spark, sf_dir), **kwargs)


def _file_profile(events):
    return events.filter(F.col("error").isNull()).groupBy("file_seq", "type_code").agg(
        F.count("*").alias("n_events"), F.count_distinct("byte_off").alias("n_offsets"))


@query("binlog_scan")
def _binlog_scan(spark, sf_dir):
    return _file_profile(_log_events(spark, sf_dir))


@query("binlog_scan_binary_files")
def _binlog_scan_binary_files(spark, sf_dir):
    return _file_profile(binlog_scan(spark, log_folder(spark, sf_dir), reader="binaryFile"))


@query("binlog_stream")
def _binlog_stream(spark, sf_dir):
    events = binlog_stream(spark, log_folder(spark, sf_dir), max_files=2)
    return _file_profile(_run_once(spark, events))


@query("binlog_stream_growing")
def _binlog_stream_growing(spark, sf_dir):
    events = binlog_stream(spark, log_folder(spark, sf_dir), growing=True)
    return _file_profile(_run_once(spark, events))


@query("binlog_scan_indexed")
def _binlog_scan_indexed(spark, sf_dir):
    """A first scan leaves marks, the second one starts tasks at them."""
    index = new_path(spark, "marks")
    _log_events(spark, sf_dir, index=index, index_every=64 << 10).write.format("noop").mode(
        "overwrite").save()
    return _file_profile(_log_events(spark, sf_dir, index=index, index_every=64 << 10))


@query("binlog_stream_bounded")
def _binlog_stream_bounded(spark, sf_dir):
    """A backlog of log files in batches of a third of it, from marks the batches leave."""
    folder, path = log_folder(spark, sf_dir), new_path(spark, "stream")
    total = sum(size for _, _, size in list_logs(folder))
    events = binlog_stream(spark, folder, growing=True, max_bytes=total // 3 + 1,
                           progress=f"{path}/notes", index=f"{path}/marks", index_every=64 << 10)
    running = (events.writeStream.format("parquet").option("path", f"{path}/out")
               .option("checkpointLocation", f"{path}/checkpoint")
               .trigger(processingTime="0 seconds").start())
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return _file_profile(spark.read.schema(events.schema).parquet(f"{path}/out"))


def _run_once(spark, stream):
    """Everything available now, through a file sink with a fresh checkpoint."""
    path = new_path(spark, "stream")
    (stream.writeStream.format("parquet").option("path", f"{path}/out")
     .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
     .awaitTermination())
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


@query("event_headers")
def _event_headers(spark, sf_dir):
    headers = event_headers(_log_events(spark, sf_dir, bodies=False))
    return headers.select(
        "file_seq", "type_code", "server_id", "flags",
        F.unix_seconds("event_ts").alias("event_s"),
        (F.col("log_pos") == F.col("byte_off") + F.col("event_size")).alias("position_agrees"))


@query("rotate_events")
def _rotate_events(spark, sf_dir):
    return rotate_events(_log_events(spark, sf_dir, codes=(S.ROTATE_EVENT,))).select(
        "file_seq", "next_file", "next_pos")


@query("format_events")
def _format_events(spark, sf_dir):
    formats = format_events(_log_events(spark, sf_dir, codes=(S.FORMAT_EVENT,)))
    return formats.select(
        "file_seq", "log_version", "header_length", "checksum",
        F.element_at("header_lengths", S.TABLE_MAP_EVENT).alias("table_map_length"))


@query("assign_segment_log")
def _assign_segment_log(spark, sf_dir):
    """The events of the log, labelled by the file that the rotate before them names."""
    events = _log_events(spark, sf_dir).filter("error IS NULL")
    place = log_seq("file_seq", "byte_off")
    marks = rotate_events(events).select(
        place.alias("seq"), "next_file", "next_pos", F.lit(True).alias("is_rotate"))
    others = events.filter(F.col("type_code") != S.ROTATE_EVENT).select(
        place.alias("seq"), F.lit(False).alias("is_rotate"))
    feed = marks.unionByName(others, allowMissingColumns=True).withColumn("log", F.lit(1))
    labelled = assign_segment(feed, ["log"], "seq", F.col("is_rotate"), F.col("next_file"),
                              F.col("next_pos"), "mysql-bin.000001", bits=LOG_RANGE_BITS)
    return labelled.groupBy("segment", "segment_start", "is_rotate").agg(
        F.count("*").alias("n_events"))


@query("table_maps")
def _table_maps(spark, sf_dir):
    return table_maps(_log_events(spark, sf_dir, codes=(S.TABLE_MAP_EVENT,))).select(
        "file_seq", "table_id", "database", "table",
        F.array_join("names", ",").alias("names"),
        F.array_join(F.transform("type_codes", lambda t: t.cast("string")), ",").alias("types"),
        F.array_join(F.transform("pk", lambda p: p.cast("string")), ",").alias("pk"), "error")


@query("column_catalog")
def _column_catalog(spark, sf_dir):
    catalog = column_catalog(table_maps(
        _log_events(spark, sf_dir, codes=(S.TABLE_MAP_EVENT,))))
    return catalog.groupBy(
        "database", "table", "ordinal", "name", "type_code", "meta", "unsigned", "is_pk",
        "nullable").agg(F.count("*").alias("n_versions"))


#: Logged types by width, from which the versions of ``schema_history`` take theirs.
_BY_WIDTH = (S.BOOL, S.TINY, S.SHORT, S.INT24, S.LONG, S.LONGLONG, S.FLOAT, S.DOUBLE, S.VARCHAR)


@query("schema_history")
def _schema_history(spark, sf_dir):
    """Every event as a schema version of the table of its type: four of six columns, whose types
    change by the user."""
    slot = F.col("user_id") + F.col("ordinal")
    kind = F.length("event_type")
    number = F.pmod(slot, F.lit(6)).cast("int")
    catalog = feeds.read(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type",
        F.explode(F.sequence(F.lit(0), F.lit(3))).alias("ordinal")).select(
        F.lit(feeds.DATABASE).alias("database"), F.col("event_type").alias("table"),
        F.lit(0).alias("file_seq"), F.col("event_id").alias("byte_off"), "ordinal",
        F.concat(F.lit("c"), number.cast("string")).alias("name"),
        F.get(F.array(*[F.lit(t) for t in _BY_WIDTH]),
              number + F.pmod("user_id", 1 + kind % 3).cast("int")).alias("type_code"),
        F.when(F.col("user_id") % 4 != 0, 4).otherwise(8).alias("meta"),
        (F.col("user_id") % 2 == kind % 2).alias("unsigned"))
    return schema_history(catalog).withColumn("types", F.array_join("types", " "))


_TABLES = [(feeds.DATABASE, "users"), (feeds.DATABASE, "guests")]


def _log_shape(spark, sf_dir):
    """One row type for both tables of the log."""
    return tables_row_type(
        table_maps(_log_events(spark, sf_dir, codes=(S.TABLE_MAP_EVENT,))), _TABLES)


def _image_columns(image, shape):
    plain = {"_id": "string", "k": "int"}  # types the check can compare
    return [image[f.name].cast(plain.get(f.name, f.dataType)).alias(f.name)
            for f in shape.fields]


@query("decode_rows")
def _decode_rows(spark, sf_dir):
    shape = _log_shape(spark, sf_dir)
    rows = decode_rows(_log_events(spark, sf_dir), shape, tables=_TABLES,
                       spread=spark.sparkContext.defaultParallelism)
    image = F.coalesce("after", "before")
    return rows.select("table", "type_code", F.shiftright("seq", 32).alias("file_seq"), "reason",
                       *_image_columns(image, shape))


@query("decode_rows_resolved")
def _decode_rows_resolved(spark, sf_dir):
    """As ``decode_rows``, with the table maps resolved by the as-of operator."""
    shape = _log_shape(spark, sf_dir)
    rows = decode_rows(_log_events(spark, sf_dir).drop("table_map"), shape, tables=_TABLES)
    return rows.select("table", "type_code", F.shiftright("seq", 32).alias("file_seq"), "reason",
                       *_image_columns(F.coalesce("after", "before"), shape))


@query("resolve_stream")
def _resolve_stream(spark, sf_dir):
    """As ``decode_rows``, from stored events dealt to four files, one a micro-batch, so that rows
    come before their maps; the table maps are resolved in streaming state."""
    path = new_path(spark, "stored")
    events = _log_events(spark, sf_dir).drop("table_map")
    events.repartition(4, "log_file", "byte_off").write.parquet(path)
    stream = (spark.readStream.schema(events.schema).option("maxFilesPerTrigger", "1")
              .parquet(path))
    shape = _log_shape(spark, sf_dir)
    with state_per_core(spark):
        rows = _run_once(spark, decode_rows(resolve_stream(stream), shape, tables=_TABLES))
    return rows.select("table", "type_code", F.shiftright("seq", 32).alias("file_seq"), "reason",
                       *_image_columns(F.coalesce("after", "before"), shape))


@query("pair_images")
def _pair_images(spark, sf_dir):
    images = read_images(spark, log_folder(spark, sf_dir), _log_shape(spark, sf_dir),
                         tables=_TABLES)
    updates = images.filter(F.col("type_code") == S.UPDATE_ROWS_V1)
    return updates.select(
        F.col("before.event_id").alias("before_event_id"),
        F.col("after.event_id").alias("after_event_id"),
        F.col("before._id").cast("string").alias("before_id"),
        F.col("after._id").cast("string").alias("after_id"),
        F.col("before.value").alias("before_value"), F.col("after.value").alias("after_value"))


@query("build_changes")
def _build_changes(spark, sf_dir):
    changes = read_changes(spark, log_folder(spark, sf_dir))
    image = F.coalesce("after", "before")
    return changes.select(
        "database", "table", "op", "key", "reason", F.shiftright("seq", 32).alias("file_seq"),
        document_field(image, "event_id", "bigint").alias("event_id"),
        document_field(image, "event_type", "string").alias("event_type"),
        document_field(image, "value", "double").alias("value"),
        document_field(image, "label", "string").alias("label"))


@query("resume_log")
def _resume_log(spark, sf_dir):
    """Continue inside the first file: whole files before it are not read, and what is at or
    before the position is dropped once its schema has been used."""
    folder = log_folder(spark, sf_dir)
    first = resume_from(read_images(spark, folder), 1, 0).filter(F.col("seq") < 2 << 32)
    position = first.agg(F.min("seq")).first()[0] & 0xFFFFFFFF
    return resume_from(read_images(spark, folder, start_file=1), 1, position).select(
        "table", "type_code", F.get_json_object(F.coalesce("after", "before"), "$.event_id")
        .cast("bigint").alias("event_id"))


@query("log_profile")
def _log_profile(spark, sf_dir):
    events = _log_events(spark, sf_dir, bodies=False)
    profile = event_profile(events.filter("error IS NULL"))
    return profile.select(
        "type_code", "n_events", F.unix_seconds("first_ts").alias("first_s"),
        F.unix_seconds("last_ts").alias("last_s"))


@query("replay_log")
def _replay_log(spark, sf_dir):
    """Log files to current tables: scan, decode, validate, apply per table."""
    good, _ = split_valid(read_changes(spark, log_folder(spark, sf_dir)))
    state = apply_multi_table(good.withColumn("after", F.struct(F.col("after").alias("doc"))))
    return state.select(
        "database", "table", "key", document_field("doc", "event_id", "bigint").alias("event_id"),
        document_field("doc", "event_type", "string").alias("event_type"),
        document_field("doc", "value", "double").alias("value"))


# ---- streaming apply ----------------------------------------------------------------------

@query("apply_stream")
def _apply_stream(spark, sf_dir):
    path = new_path(spark, "apply")
    source = f"{path}/events"
    feeds.read(spark, sf_dir, "events").repartition(4, "event_id").write.parquet(source)
    events = (spark.readStream.schema(spark.read.parquet(source).schema)
              .option("maxFilesPerTrigger", "2").parquet(source))
    apply_stream(feeds.user_change_columns(events), f"{path}/target", f"{path}/checkpoint",
                 availableNow=True).awaitTermination()
    return read_state(spark, f"{path}/target")


@query("maintain_store")
def _maintain_store(spark, sf_dir):
    """As ``apply_stream``, into hash buckets."""
    path = new_path(spark, "apply")
    source = f"{path}/events"
    feeds.read(spark, sf_dir, "events").repartition(4, "event_id").write.parquet(source)
    events = (spark.readStream.schema(spark.read.parquet(source).schema)
              .option("maxFilesPerTrigger", "2").parquet(source))
    maintain_store(feeds.user_change_columns(events), f"{path}/target", f"{path}/checkpoint",
                   buckets=16, availableNow=True).awaitTermination()
    return read_store(spark, f"{path}/target")


@query("replay_log_stream")
def _replay_log_stream(spark, sf_dir):
    """As ``replay_log``, from a stream of log files."""
    path = new_path(spark, "apply")
    row = _log_shape(spark, sf_dir)
    good, _ = split_valid(change_stream(spark, log_folder(spark, sf_dir), row, max_files=2))
    by = ("database", "table", "key")
    apply_stream(good, f"{path}/target", f"{path}/checkpoint", by=by,
                 availableNow=True).awaitTermination()
    return read_state(spark, f"{path}/target", by).select(
        *by, "event_id", "event_type", "value")
