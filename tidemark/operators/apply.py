"""Apply row changes to tables: one order-free aggregate per key, no replay loop.

Per key let ``mi`` and ``md`` be the newest INSERT and DELETE positions and ``img`` the newest
after-image. Images are full rows, so the newest one decides; the row is live iff
``mi > md``. max and max_by are associative, commutative and idempotent: partial aggregation,
disorder and re-delivery do not change the result, and a hot key is reduced before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import schemas as S
from .carry import RANGE_BITS, carry_last, running_total
from .grouping import with_group_hash


def image_fields(df: DataFrame, column: str = "after") -> list[str]:
    return df.schema[column].dataType.fieldNames()


def change_summary(seq: str = "seq", after: str = "after") -> list[Column]:
    """The per-key aggregate shared by the batch and the streaming apply."""
    op, pos = F.col("op"), F.col(seq)
    return [
        F.max(F.when(op == S.INSERT, pos)).alias("last_insert"),
        F.max(F.when(op == S.DELETE, pos)).alias("last_delete"),
        F.max(pos).alias("last_any"),
        F.max_by(F.struct(pos.alias("seq"), F.col(after).alias("image")),
                 F.when(op != S.DELETE, pos)).alias("newest"),
    ]


def is_live() -> Column:
    """Live iff the newest INSERT is newer than the newest DELETE."""
    mi, md = F.col("last_insert"), F.col("last_delete")
    return mi.isNotNull() & (md.isNull() | (mi > md))


def _as_changes(state: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    return state.select(
        *by, F.lit(S.INSERT).alias("op"), F.col("last_seq").alias("seq"),
        F.struct(*[F.col(c) for c in fields]).alias("after"))


def _with_state(changes: DataFrame, state: DataFrame | None, by: list[str],
                high_water) -> DataFrame:
    feed = changes.select(*by, "op", "seq", "after")
    if state is None:
        return feed
    # The state holds no tombstones: a change it has already seen must not be applied again.
    if high_water is None:
        raise ValueError("a stored state needs its high-water mark: without it a repeated insert "
                         "would bring a deleted row back")
    feed = feed.filter(F.col("seq") > F.lit(high_water))
    return feed.unionByName(_as_changes(state, by, image_fields(changes)))


def turns_live() -> Column:
    """True for an INSERT, false for a DELETE, NULL for an UPDATE, which changes nothing here."""
    return F.when(F.col("op") == S.INSERT, True).when(F.col("op") == S.DELETE, False)


def apply_changes(changes: DataFrame, state: DataFrame | None = None, high_water=None,
                  by: tuple[str, ...] = ("key",), strategy: str = "aggregate") -> DataFrame:
    """Current rows of a table from its changes, optionally on top of an earlier ``state``.

    ``changes`` has the key columns ``by``, ``op``, ``seq`` (any orderable type) and the struct
    ``after``; the result has the key columns, the fields of ``after`` and ``last_seq``.
    ``high_water`` is the highest position ever applied to ``state`` and goes with it: changes up
    to it are taken as applied. ``late_changes`` gives those that were left out.

    ``strategy="aggregate"`` reduces whole rows in one aggregate. ``"join_back"`` finds the
    winning positions with a hash aggregate over narrow columns and fetches the rows by
    (key, position), which pays when images are wide and few keys stay live.
    """
    by = list(by)
    feed, group = with_group_hash(_with_state(changes, state, by, high_water), by)
    fields = image_fields(changes)
    if strategy == "aggregate":
        return (
            feed.groupBy(*group).agg(*change_summary()).filter(is_live())
            .select(*by, *[F.col(f"newest.image.`{c}`").alias(c) for c in fields],
                    F.col("newest.seq").alias("last_seq"))
        )
    if strategy != "join_back":
        raise ValueError(f"unknown strategy {strategy!r}")
    op, pos = F.col("op"), F.col("seq")
    winners = (
        feed.groupBy(*group).agg(
            F.max(F.when(op == S.INSERT, pos)).alias("last_insert"),
            F.max(F.when(op == S.DELETE, pos)).alias("last_delete"),
            F.max(F.when(op != S.DELETE, pos)).alias("seq"))
        .filter(is_live()).select(*group, "seq")
    )
    images = feed.filter(op != S.DELETE)
    # Re-delivered copies of the winning change are equal, so any one of them stands for all.
    return (
        images.join(winners, [*group, "seq"], "inner").dropDuplicates([*group, "seq"])
        .select(*by, *[F.col(f"after.`{c}`").alias(c) for c in fields],
                F.col("seq").alias("last_seq"))
    )


def late_changes(changes: DataFrame, high_water) -> DataFrame:
    """Changes that ``apply_changes`` with this ``high_water`` leaves out, with ``reason``: repeated
    ones, or such that came after later ones had been applied. To apply the latter, rebuild."""
    return changes.filter(F.col("seq") <= F.lit(high_water)).withColumn(
        "reason", F.lit("not_after_high_water"))


def apply_multi_table(changes: DataFrame, strategy: str = "aggregate") -> DataFrame:
    """``apply_changes`` over a mixed feed, kept apart per (database, table)."""
    return apply_changes(changes, by=("database", "table", "key"), strategy=strategy)


def apply_inserts(state: DataFrame, changes: DataFrame) -> DataFrame:
    """Add the rows of INSERT changes; of several rows for a key the newest stays."""
    fields = image_fields(changes)
    feed = (changes.filter(F.col("op") == S.INSERT).select("key", "op", "seq", "after")
            .unionByName(_as_changes(state, ["key"], fields)))
    feed, group = with_group_hash(feed, ["key"])
    newest = F.max_by(F.struct("seq", "after"), "seq").alias("newest")
    return feed.groupBy(*group).agg(newest).select(
        "key", *[F.col(f"newest.after.`{c}`").alias(c) for c in fields],
        F.col("newest.seq").alias("last_seq"))


def apply_deletes(state: DataFrame, changes: DataFrame) -> DataFrame:
    """Remove the row of each DELETE key; a missing key is a no-op."""
    # Keys are made unique before the join, so a key deleted many times is one row of it.
    gone = changes.filter(F.col("op") == S.DELETE).select("key").distinct()
    return state.join(gone, "key", "left_anti")


def apply_updates(state: DataFrame, changes: DataFrame) -> DataFrame:
    """Set all non-key columns from the newest after-image; a missing key is a no-op."""
    fields = image_fields(changes)
    updates, group = with_group_hash(changes.filter(F.col("op") == S.UPDATE), ["key"])
    newest = (updates.groupBy(*group)
              .agg(F.max_by(F.struct("seq", "after"), "seq").alias("__newest")))
    hit = F.col("__newest").isNotNull()

    def pick(new: str, old: str) -> Column:
        # Not coalesce: an update that sets a column to NULL must keep the NULL.
        return F.when(hit, F.col(new)).otherwise(F.col(old))

    state, _ = with_group_hash(state, ["key"])
    return state.join(newest, group, "left").select(
        "key", *[pick(f"__newest.after.`{c}`", f"`{c}`").alias(c) for c in fields],
        pick("__newest.seq", "last_seq").alias("last_seq"))


def state_as_of(changes: DataFrame, seq, **kwargs) -> DataFrame:
    """State after the change at position ``seq`` (inclusive)."""
    return apply_changes(changes.filter(F.col("seq") <= F.lit(seq)), **kwargs)


def live_row_timeline(changes: DataFrame, by: tuple[str, ...] = ("key",),
                      bits: int = RANGE_BITS, levels: int = 1) -> DataFrame:
    """Number of live rows after each change of one feed: the key columns, ``seq``, ``op`` and
    ``live_rows``. ``seq`` is a BIGINT unique over the feed."""
    op = F.col("op")
    feed = changes.select(*by, "seq", "op")
    seen = carry_last(feed, list(by), "seq", turns_live(), "__live", strict=True, bits=bits,
                      levels=levels)
    was = F.coalesce(F.col("__live"), F.lit(False)).cast("bigint")
    now = (F.when(op == S.INSERT, F.lit(1)).when(op == S.DELETE, F.lit(0))
           .otherwise(was).cast("bigint"))
    return running_total(seen, "seq", now - was, "live_rows", bits=bits).select(
        *by, "seq", "op", "live_rows")
