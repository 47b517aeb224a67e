"""State by hash buckets, copied on write, with a catalogue of snapshots by position.

A store keeps for each key what its changes add up to: newest INSERT, DELETE and any position, and
the newest image. These merge by max and max_by, so a store takes changes in any order, late and
repeated ones too, and deleted keys stay as tombstones. Rows lie in buckets by the hash of their key:

    layout                              key columns and number of buckets
    data/version=<n>/bucket=<b>         rows of a bucket as version n wrote them
    manifest/version=<n>                for every bucket the versions that wrote its rows

A version writes the buckets its changes touch and shares all others with the version it is based
on. ``merge_changes`` rewrites these buckets; ``add_changes`` adds files to them, which are merged by
levels, so that a row is written again a few times only, however many small batches follow. Its manifest is written last, so a version is there whole or not at all, and writing a version
again (a repeated micro-batch) replaces only its own files. Manifests have a row per bucket; that
and the list of versions is all that reaches the driver.

A version with a ``position`` is a snapshot: everything up to that position. Snapshots share their
untouched buckets as well, and the state at any position is the newest snapshot before it with the
changes since. Late changes go into every snapshot at or after them, again by touched buckets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.apply import apply_changes, change_summary, is_live
from ..operators.grouping import HASH, with_group_hash
from .versions import finished, numbers, read_note, remove, write_note

_MANIFEST = "bucket int, wrote bigint, position bigint, based bigint, level int"
_LAYOUT = "keys array<string>, buckets int"
_NOTHING = -(1 << 62)  # the number of no version


@dataclass(frozen=True)
class Version:
    """``files`` has for each bucket with rows the versions that wrote them, each with its level:
    0 for rows of one batch, one more for each time they were merged."""

    number: int
    position: int | None
    files: dict[int, dict[int, int]]


def create_store(spark: SparkSession, target: str, by: tuple[str, ...] = ("key",),
                 buckets: int = 64) -> None:
    """Fix the key columns and the number of buckets of a new store; an existing one must have the
    same. Choose buckets so that one holds about 128 MB."""
    if finished(spark, f"{target}/layout"):
        if _layout(spark, target) != (list(by), buckets):
            raise ValueError(f"{target} has another layout: {_layout(spark, target)}")
        return
    write_note(spark, [(list(by), buckets)], _LAYOUT, f"{target}/layout")


def _layout(spark: SparkSession, target: str) -> tuple[list[str], int]:
    row = read_note(spark, f"{target}/layout")[0]
    return row["keys"], row["buckets"]


def _bucket(by: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int")


def store_version(spark: SparkSession, target: str, number: int | None = None,
                  before: int | None = None) -> Version | None:
    """A finished version: number ``number``, or the newest (below ``before``)."""
    for n in reversed(numbers(spark, f"{target}/manifest", "version")):
        if (number is not None and n != number) or (before is not None and n >= before):
            continue
        path = f"{target}/manifest/version={n}"
        if finished(spark, path):
            rows = read_note(spark, path)  # a row per bucket and file
            files: dict[int, dict[int, int]] = {}
            for r in rows:
                if r["bucket"] is not None:
                    files.setdefault(r["bucket"], {})[r["wrote"]] = r.get("level") or 0
            return Version(n, rows[0]["position"], files)
    return None


def _write_manifest(spark: SparkSession, target: str, version: int, position: int | None,
                    based: Version | None, files: dict[int, dict[int, int]]) -> None:
    number = based.number if based else None
    rows = [(b, v, position, number, level) for b, found in sorted(files.items())
            for v, level in sorted(found.items())]
    write_note(spark, rows or [(None, None, position, number, None)], _MANIFEST,
               f"{target}/manifest/version={version}")


def _manifests(spark: SparkSession, target: str) -> DataFrame | None:
    """Rows of all finished manifests with their ``version``."""
    there = [n for n in numbers(spark, f"{target}/manifest", "version")
             if finished(spark, f"{target}/manifest/version={n}")]
    if not there:
        return None
    return spark.read.schema(f"{_MANIFEST}, version bigint").option(
        "basePath", f"{target}/manifest").parquet(
        *[f"{target}/manifest/version={n}" for n in there])


def snapshots(spark: SparkSession, target: str) -> list[tuple[int, int]]:
    """(position, version) of the snapshots, by position; the newest version of each position."""
    found = _manifests(spark, target)
    if found is None:
        return []
    rows = found.filter("position IS NOT NULL").groupBy("position").agg(
        F.max("version").alias("version")).collect()
    return sorted((r.position, r.version) for r in rows)


def summarise(changes: DataFrame, by: list[str]) -> DataFrame:
    """What the changes of each key add up to."""
    feed, group = with_group_hash(changes.select(*by, "op", "seq", "after"), by)
    return feed.groupBy(*group).agg(*change_summary()).drop("__hash")


def _merged() -> list[Column]:
    return [*[F.max(c).alias(c) for c in ("last_insert", "last_delete", "last_any")],
            F.max_by("newest", "newest.seq").alias("newest")]


def _rows(spark: SparkSession, target: str, files: dict[int, dict[int, int]],
          schema: T.StructType | None = None) -> DataFrame | None:
    """Rows of some buckets; one path for each file."""
    paths = [f"{target}/data/version={v}/bucket={b}" for b, found in sorted(files.items())
             for v in sorted(found)]
    if not paths:
        return None
    reader = spark.read.option("basePath", f"{target}/data")
    return (reader if schema is None else reader.schema(schema)).parquet(*paths).drop("version")


def _whole(spark: SparkSession, target: str, files: dict[int, dict[int, int]],
           by: list[str]) -> DataFrame | None:
    """One row for each key of some buckets."""
    rows = _rows(spark, target, files)
    if all(len(found) == 1 for found in files.values()):
        return rows
    rows, group = with_group_hash(rows, ["bucket", *by])
    return rows.groupBy(*group).agg(*_merged()).drop(HASH)


def _current(summary: DataFrame, by: list[str]) -> DataFrame:
    return summary.filter(is_live()).select(
        *by, "newest.image.*", F.col("newest.seq").alias("last_seq"))


def merge_changes(changes: DataFrame, target: str, version: int | None = None,
                  position: int | None = None, base: int | None = None) -> list[int]:
    """Write a version with ``changes`` added to version ``base`` (by default the newest before
    it) and give the buckets it wrote.

    The changes' own sums are written first, so that their buckets say which ones to read. Reading and writing then follow the touched buckets, not the store.
    """
    spark = changes.sparkSession
    by, buckets = _layout(spark, target)
    if version is None:
        version = max(numbers(spark, f"{target}/manifest", "version"), default=-1) + 1
    on = (store_version(spark, target, before=version) if base is None
          else store_version(spark, target, number=base))
    files = dict(on.files) if on else {}
    delta = f"{target}/delta/version={version}"
    sums = summarise(changes, by).withColumn("bucket", _bucket(by, buckets))
    sums.write.mode("overwrite").parquet(delta)
    new = spark.read.schema(sums.schema).parquet(delta)
    touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())
    data = f"{target}/data/version={version}"
    if touched:
        old = _rows(spark, target, {b: files[b] for b in touched if b in files})
        both = new if old is None else new.unionByName(old)
        (both.repartition(len(touched), "bucket").groupBy("bucket", *by).agg(*_merged())
         .sortWithinPartitions("bucket", *by).write.mode("overwrite").partitionBy("bucket")
         .option(f"parquet.bloom.filter.enabled#{by[-1]}", "true").parquet(data))
        files |= {b: {version: 1 + max(files.get(b, {}).values(), default=-1)} for b in touched}
    _write_manifest(spark, target, version, position, on, files)
    remove(spark, delta)
    return touched


def add_changes(changes: DataFrame, target: str, version: int, runs: int = 8) -> None:
    """Write a version with ``changes`` added to the newest one before it, by adding a file to each
    bucket they touch: what a small batch costs does not follow what the buckets hold.

    ``runs`` files of a level are merged to one of the next, by the batch that would be the last of
    them; readers merge the rest, at most ``runs - 1`` files a level.
    """
    spark = changes.sparkSession
    by, buckets = _layout(spark, target)
    on = store_version(spark, target, before=version)
    files = {b: dict(found) for b, found in on.files.items()} if on else {}
    full: dict[int, dict[int, int]] = {}
    levels: dict[int, int] = {}
    for b, found in files.items():
        level = 0
        while sum(x == level for x in found.values()) >= runs - 1:
            level += 1
        if level:
            full[b] = {v: x for v, x in found.items() if x < level}
            levels[b] = level
    sums = summarise(changes, by).withColumn("bucket", _bucket(by, buckets))
    old = _rows(spark, target, full, sums.schema)
    if old is None:
        rows = sums.hint("rebalance", "bucket")
    else:
        rows = sums.unionByName(old).repartition(buckets, "bucket").groupBy(
            "bucket", *by).agg(*_merged())
    data = f"{target}/data/version={version}"
    (rows.sortWithinPartitions("bucket", *by).write.mode("overwrite").partitionBy("bucket")
     .option(f"parquet.bloom.filter.enabled#{by[-1]}", "true").parquet(data))
    for b in numbers(spark, data, "bucket"):
        files[b] = {v: x for v, x in files.get(b, {}).items() if v not in full.get(b, {})}
        files[b][version] = levels.get(b, 0)
    _write_manifest(spark, target, version, None, on, files)


def read_store(spark: SparkSession, target: str, version: int | None = None,
               changes: DataFrame | None = None) -> DataFrame:
    """Current rows of a version, by default the newest: key columns, fields of the image and
    ``last_seq``; with ``changes``, those that come on top of it."""
    found = store_version(spark, target, number=version)
    files = found.files if found else {}
    if not files and changes is None:
        raise FileNotFoundError(f"no finished version with rows below {target}")
    by, _ = _layout(spark, target)
    if changes is not None:
        both, old = summarise(changes, by), _rows(spark, target, files)
        both = both if old is None else both.unionByName(old.drop("bucket"))
        both, group = with_group_hash(both, by)
        return _current(both.groupBy(*group).agg(*_merged()), by)
    return _current(_whole(spark, target, files, by), by)


def store_lookup(spark: SparkSession, target: str, *key) -> DataFrame:
    """The current row of one key: only its bucket is opened."""
    by, buckets = _layout(spark, target)
    found = store_version(spark, target)
    if found is None or not found.files:
        raise FileNotFoundError(f"no finished version with rows below {target}")
    some = min(found.files)
    kinds = _rows(spark, target, {some: found.files[some]}).schema
    values = [F.lit(v).cast(kinds[c].dataType) for c, v in zip(by, key)]
    bucket = spark.range(1).select(
        F.pmod(F.xxhash64(*values), F.lit(buckets)).cast("int").alias("b")).first().b
    # Without rows in its bucket the key is in none: any bucket says so.
    one = bucket if bucket in found.files else some
    rows = _whole(spark, target, {one: found.files[one]}, by)
    for c, value in zip(by, values):
        rows = rows.filter(F.col(c) == value)
    return _current(rows, by)


def vacuum(spark: SparkSession, target: str, keep: int = 3) -> None:
    """Remove versions other than snapshots and the ``keep`` newest, and files that no version left
    names. Readers that began before may have to begin again."""
    there = numbers(spark, f"{target}/manifest", "version")
    # The versions that are there: snapshots and those since the last time.
    found = [store_version(spark, target, number=n) for n in there]
    newest_of: dict[int, int] = {}
    for v in found:
        if v is not None and v.position is not None:
            newest_of[v.position] = max(v.number, newest_of.get(v.position, v.number))
    kept = {*newest_of.values(), *there[-keep:]}
    named: dict[int, set[int]] = {}
    for v in found:
        if v is not None and v.number in kept:
            for b, wrote in v.files.items():
                for w in wrote:
                    named.setdefault(w, set()).add(b)
    for n in there:
        if n not in kept:
            remove(spark, f"{target}/manifest/version={n}")
    newest = max(there, default=-1)
    for v in numbers(spark, f"{target}/data", "version"):
        if v > newest:
            continue  # being written
        if v not in named:
            remove(spark, f"{target}/data/version={v}")
            continue
        for b in numbers(spark, f"{target}/data/version={v}", "bucket"):
            if b not in named[v]:
                remove(spark, f"{target}/data/version={v}/bucket={b}")


# ---- snapshots ----------------------------------------------------------------------------

def _newest_before(spark: SparkSession, target: str, seq: int) -> tuple[int, int] | None:
    before = [s for s in snapshots(spark, target) if s[0] <= seq]
    return before[-1] if before else None


def take_snapshot(changes: DataFrame, target: str, seq: int) -> list[int]:
    """Store the state at position ``seq``: the newest snapshot before it and the changes since,
    which is all that is read of ``changes``. Gives the buckets written."""
    spark = changes.sparkSession
    known = _newest_before(spark, target, seq)
    feed = changes.filter(F.col("seq") <= F.lit(seq))
    if known is None:
        # A later version may be there: based on none, this one starts from nothing.
        return merge_changes(feed, target, position=seq, base=_NOTHING)
    return merge_changes(feed.filter(F.col("seq") > F.lit(known[0])), target, position=seq,
                         base=known[1])


def state_from_snapshots(changes: DataFrame, target: str, seq: int) -> DataFrame:
    """State after the change at position ``seq`` (inclusive), as ``state_as_of`` gives it, from the
    newest snapshot up to it and the changes since."""
    spark = changes.sparkSession
    by, _ = _layout(spark, target)
    known = _newest_before(spark, target, seq)
    feed = changes.filter(F.col("seq") <= F.lit(seq))
    if known is None:
        return apply_changes(feed, by=tuple(by))
    since = summarise(feed.filter(F.col("seq") > F.lit(known[0])), by)
    old = _rows(spark, target, store_version(spark, target, number=known[1]).files)
    both = since if old is None else since.unionByName(old.drop("bucket"))
    both, group = with_group_hash(both, by)
    return _current(both.groupBy(*group).agg(*_merged()), by)


def apply_late(late: DataFrame, target: str) -> dict[int, list[int]]:
    """Put changes that came after snapshots had been taken into every snapshot at or after their
    position; gives the buckets written by position. Nothing else is rebuilt, and what a snapshot
    already has changes nothing."""
    spark = late.sparkSession
    first = late.agg(F.min("seq")).first()[0]
    wrote = {}
    if first is not None:
        for position, version in snapshots(spark, target):
            if position >= first:
                wrote[position] = merge_changes(late.filter(F.col("seq") <= F.lit(position)), target,
                                                position=position, base=version)
    return wrote

