"""A mixed stream of log events fanned out to one target per table, made when it is first seen."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import quote, unquote

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.apply import apply_changes
from ..operators.schema import column_catalog
from ..operators.validate import split_valid
from ..sources.binlog import bad_events, changes_of, decode_rows, table_maps
from ..sources.store import add_changes, create_store, read_store, vacuum
from ..sources.tables import create_target, route_changes, typed_targets
from ..sources.versions import (
    children, exists, finished, numbers, read_note, remove, write_note,
)

_COLUMNS = ("database", "table", "file_seq", "byte_off", "ordinal", "name", "type_code", "meta",
            "unsigned")
_CHANGES = "key string, op string, seq bigint, after struct<doc: variant>"
_AT_ONCE = 8  # jobs of a micro-batch that the driver submits side by side


def _store(root: str, database: str, table: str) -> str:
    """Names from a log may hold anything; as folder names they are escaped."""
    return f"{root}/tables/{quote(database, safe='')}/{quote(table, safe='')}"


def _catalog(spark: SparkSession, root: str, before: int | None = None) -> str | None:
    """Folder with the columns of the newest schema of every table seen so far (before a batch)."""
    for n in reversed(numbers(spark, f"{root}/columns", "batch")):
        if (before is None or n < before) and finished(spark, f"{root}/columns/batch={n}"):
            return f"{root}/columns/batch={n}"
    return None


def _write_catalog(batch: DataFrame, root: str, batch_id: int, ready) -> None:
    """Of a batch only the newest schema of each table reaches the driver. ``ready`` returns once all
    else that the batch needs to count is there."""
    spark = batch.sparkSession
    seen = column_catalog(table_maps(batch).filter("error IS NULL")).select(*_COLUMNS)
    place = ("file_seq", "byte_off")
    newest = seen.groupBy(*_COLUMNS[:4]).agg(
        F.collect_set(F.struct(*_COLUMNS[4:])).alias("columns")).groupBy(*_COLUMNS[:2]).agg(
        F.max_by(F.struct(*place, "columns"), F.struct(*place)).alias("map")).collect()
    rows = [(r.database, r.table, r.map.file_seq, r.map.byte_off, *c)
            for r in newest for c in r.map.columns]
    old = _catalog(spark, root, before=batch_id)
    if old is not None:
        rows += [tuple(r[c] for c in _COLUMNS) for r in read_note(spark, old)]
    last: dict[tuple, tuple] = {}
    for r in rows:
        last[r[:2]] = max(last.get(r[:2], r[2:4]), r[2:4])
    ready()
    write_note(spark, list(dict.fromkeys(r for r in rows if r[2:4] == last[r[:2]])), seen.schema,
               f"{root}/columns/batch={batch_id}")
    for n in numbers(spark, f"{root}/columns", "batch")[:-2]:
        remove(spark, f"{root}/columns/batch={n}")


def _merged(spark: SparkSession, root: str, before: int | None = None) -> int:
    """The last micro-batch whose changes are in the stores, with all before it; -1 if none is."""
    there = [n for n in numbers(spark, f"{root}/merged", "batch")
             if (before is None or n < before) and finished(spark, f"{root}/merged/batch={n}")]
    return max(there, default=-1)


def _waiting(spark: SparkSession, root: str, after: int, upto: int) -> list[int]:
    return [n for n in numbers(spark, f"{root}/staged", "batch") if after < n <= upto]


def _staged(spark: SparkSession, root: str, batches: list[int]) -> dict[tuple[str, str], list[str]]:
    """Folders with the changes of each (database, table) in some micro-batches, as
    ``route_changes`` wrote them."""
    def below(folder: str, column: str):
        for name in sorted(children(spark, folder)):
            kind, _, value = name.partition("=")
            if kind == column:
                yield unquote(value), f"{folder}/{name}"

    found: dict[tuple[str, str], list[str]] = {}
    for n in batches:
        for database, folder in below(f"{root}/staged/batch={n}", "database"):
            for table, path in below(folder, "table"):
                found.setdefault((database, table), []).append(path)
    return found


def _unmerged(spark: SparkSession, root: str) -> dict[tuple[str, str], list[str]]:
    """Folders of changes that are in no store yet. Should some be, nothing changes: changes may
    come again."""
    last = _catalog(spark, root)
    return {} if last is None else _staged(spark, root, _waiting(
        spark, root, _merged(spark, root), int(last.rsplit("=", 1)[-1])))


def route_stream(log_events: DataFrame, root: str, checkpoint: str, buckets: int = 16,
                 on_batch=None, merge_every: int = 16, **trigger) -> StreamingQuery:
    """Keep a target for every table of a stream of ``log_events`` (with ``table_map``, as
    ``binlog_stream`` and ``resolve_stream`` give them).

    Each micro-batch deals its changes out by table and notes the columns that its schema messages
    declare, with which it counts: ``read_target`` sees its changes. After ``merge_every``
    micro-batches their changes are added to the tables' stores of hash buckets, made when they are
    first needed. A store merges its files by levels, so what a micro-batch costs does not follow
    the size of the targets. The loop is over the tables, some at a time, never over rows; each pass
    reads its table's part only. Rows are kept as documents and get the types of the newest schema
    when they are read (``read_target``), so a table may change its columns at any time. A batch
    that is repeated writes the same versions again. What cannot be applied goes to
    ``quarantine/batch=<n>`` with its reason.
    """
    def merge(spark: SparkSession, batch_id: int) -> None:
        before = _merged(spark, root, before=batch_id)
        waiting = _waiting(spark, root, before, batch_id)
        if len(waiting) < merge_every:
            return

        def add(table):
            store = _store(root, *table[0])
            create_store(spark, store, buckets=buckets)
            add_changes(spark.read.schema(_CHANGES).parquet(*table[1]), store, version=batch_id)
            vacuum(spark, store)

        with ThreadPoolExecutor(_AT_ONCE) as pool:
            for _ in pool.map(inheritable_thread_target(spark)(add),
                              _staged(spark, root, waiting).items()):
                pass
        write_note(spark, [(n,) for n in waiting], "batch bigint", f"{root}/merged/batch={batch_id}")
        # Readers that have begun may still need what this batch merged.
        for n in _waiting(spark, root, -1, before):
            remove(spark, f"{root}/staged/batch={n}")
        for n in numbers(spark, f"{root}/merged", "batch")[:-3]:
            remove(spark, f"{root}/merged/batch={n}")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = batch
        batch = batch.persist()  # the files of a micro-batch are split once, and decoded once
        images = decode_rows(batch).persist()
        good, bad = split_valid(changes_of(images))
        good = good.select("database", "table", "key", "op", "seq",
                           F.struct(F.col("after").alias("doc")).alias("after"))
        quarantine = bad.select("log_file", F.col("seq").alias("place"), "reason").unionByName(
            bad_events(batch).select("log_file", (F.col("file_start") + F.col("byte_off"))
                                     .alias("place"), "reason"))
        try:
            # First of all, so that the jobs side by side find it done.
            images.write.format("noop").mode("overwrite").save()
            with ThreadPoolExecutor(_AT_ONCE) as pool:
                def submit(job, *args):
                    return pool.submit(inheritable_thread_target(spark)(job), *args)

                dealt = submit(route_changes, good, f"{root}/staged/batch={batch_id}", "overwrite")
                for part in (dealt, submit(_write_catalog, batch, root, batch_id, dealt.result),
                             submit(lambda: quarantine.write.mode("overwrite").parquet(
                                 f"{root}/quarantine/batch={batch_id}"))):
                    part.result()
        finally:
            images.unpersist()
            batch.unpersist()
        merge(spark, batch_id)
        if on_batch is not None:
            on_batch(seen, batch_id)

    return (log_events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "5 seconds"})).start())


def targets(spark: SparkSession, root: str) -> list[tuple[str, str]]:
    """(database, table) of the targets that have rows or had some."""
    catalog = _catalog(spark, root)
    if catalog is None:
        return []
    waiting = _unmerged(spark, root)
    names = sorted({(r["database"], r["table"]) for r in read_note(spark, catalog)})
    return [n for n in names if n in waiting
            or numbers(spark, f"{_store(root, *n)}/manifest", "version")]


def read_target(spark: SparkSession, root: str, database: str, table: str) -> DataFrame:
    """Current rows of a target, with the columns and types of its newest schema."""
    columns = typed_targets(spark.read.parquet(_catalog(spark, root)).filter(
        (F.col("database") == database) & (F.col("table") == table)), document="doc")
    waiting = _unmerged(spark, root).get((database, table))
    changes = spark.read.schema(_CHANGES).parquet(*waiting) if waiting else None
    store = _store(root, database, table)
    rows = (read_store(spark, store, changes=changes) if exists(spark, f"{store}/layout")
            else apply_changes(changes))
    return rows.select("key", *columns[database, table], "last_seq")


def _catalog_name(name: str) -> str:
    """A catalog takes letters of ASCII, digits and ``_``: other characters become their code."""
    return re.sub("[^A-Za-z0-9_]", lambda m: f"_{ord(m.group()):x}_", name)


def publish(spark: SparkSession, root: str, folder: str, prefix: str = "") -> list[tuple[str, str]]:
    """Every target as it is now as a typed catalog table below ``folder``; gives their names in the
    catalog."""
    made = []
    for database, table in targets(spark, root):
        name = prefix + _catalog_name(database), _catalog_name(table)
        create_target(read_target(spark, root, database, table), *name, folder)
        made.append(name)
    return made
