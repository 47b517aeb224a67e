"""Mixing sources to target weights by Poisson replication, in built-in functions only.

A source with target weight ``w`` and size ``s`` is to be read ``w * total / s`` times. Each
document gets a hash-seeded Poisson count with that mean (uniform number from its hash, put
through the inverted distribution), is exploded by its count and dealt over all partitions by a
hash of document and copy, in whose order every partition is sorted.

Defined cases: a null source is a source of its own; a null or empty text has size 1; rows without
a doc_id of their own (null, or repeated) are also told apart by a digest of their columns and a
number among wholly equal rows, which seed their order keys. The digest seeds their counts too,
and for null ids the number; wholly equal rows with an id get one count each, the same. A source
without weight is left out; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.scratch import new_path

#: Rates are split into parts of at most this mean, each inverted on its own hash.
PART = 8.0
#: Entries of an inverted distribution; beyond the last the chance is under 1e-30 at ``PART``.
ENTRIES = 64
#: Source tables up to this many rows are broadcast; larger ones join by salted keys.
BROADCAST_SOURCES = 10_000
SALTS = 64
#: Wholly equal rows that one task numbers.
NUMBERED = 1024


def uniform(seed: str, *parts, more=()) -> Column:
    """A number in [0, 1) with 52 bits from the MD5 of the parts, and of those of ``more`` that
    are not null."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("null"))
                                           for p in parts], *[m.cast("string") for m in more])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint").cast("double") / 2.0 ** 52


def _source_key() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))


def source_rates(docs: DataFrame, weights: dict | None = None, repeat: float = 1.0) -> DataFrame:
    """Per source key: size, ``__rate``, its parts and the inverted distribution of one part.

    Without ``weights`` the weight of a source is the square root of its size in code points,
    which lifts small sources. ``repeat`` is the size of the result in sizes of the input.
    """
    size = F.greatest(F.coalesce(F.char_length("text"), F.lit(0)), F.lit(1)).cast("bigint")
    sizes = docs.groupBy(_source_key().alias("__key")).agg(F.sum(size).alias("__size"))
    if weights is None:
        weight = F.floor(F.sqrt(F.col("__size").cast("double")) * 1000).cast("double")
    else:
        pairs = [x for s, w in weights.items()
                 for x in (F.lit("n" if s is None else f"s{s}"), F.lit(float(w)))]
        table = F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,double>")
        weight = F.coalesce(F.try_element_at(table, F.col("__key")), F.lit(0.0))
    # The sizes are written once, then their sums are two numbers of the plan.
    path = new_path(docs.sparkSession, "mix")
    sizes.withColumn("__weight", weight).write.parquet(path)
    sizes = docs.sparkSession.read.parquet(path)
    total, weights = sizes.agg(F.sum("__size"), F.sum("__weight")).first()
    rate = F.lit(0.0) if not weights else (
        F.col("__weight") / float(weights) * (F.lit(float(total)) / F.col("__size").cast("double"))
        * repeat)
    rated = sizes.withColumn("__rate", rate).withColumn(
        "__parts", F.greatest(F.ceil(F.col("__rate") / PART), F.lit(1)).cast("int"))
    first = F.exp(-F.col("__rate") / F.col("__parts"))
    mean = F.col("__rate") / F.col("__parts")
    steps = F.aggregate(
        F.sequence(F.lit(1), F.lit(ENTRIES - 1)),
        F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all")),
        lambda acc, k: F.struct(
            (acc.p * mean / k).alias("p"), (acc.c + acc.p * mean / k).alias("c"),
            F.concat(acc["all"], F.array(acc.c + acc.p * mean / k)).alias("all")))
    return rated.select("__key", "__rate", "__parts", steps["all"].alias("__cdf"))


def _told_apart(rows: DataFrame) -> DataFrame:
    """``rows`` with ``__row`` and ``__n``: null where the doc_id is the row's own, else a digest
    of the columns and a number from 0 among wholly equal rows.

    Equal rows cross the shuffle as one row per input task and are numbered in parts, so that a
    group of them never meets in one task.
    """
    columns = rows.columns
    path = new_path(rows.sparkSession, "mix-ids")
    rows.groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("__held")).filter(
        "__id IS NULL OR __held > 1").select("__id", F.lit(True).alias("__odd")).write.parquet(path)
    ids = rows.sparkSession.read.parquet(path)
    found = ids.count()
    none = {"__row": F.lit(None).cast("string"), "__n": F.lit(None).cast("bigint")}
    if not found:
        return rows.withColumns(none)
    ids = F.broadcast(ids) if found <= BROADCAST_SOURCES else ids
    marked = rows.join(ids, F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    own = marked.filter("__odd IS NULL").drop("__id", "__odd").withColumns(none)
    odd = marked.filter("__odd").groupBy(*[F.col(f"`{c}`") for c in columns]).agg(
        F.count("*").alias("__held"))
    digest = F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]),
                             {"ignoreNullFields": "false"}))
    parts = odd.withColumn("__row", digest).withColumn("__part", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.expr(f"(__held - 1) div {NUMBERED}")))).repartition(
        "__row", "__part")
    start = F.col("__part") * NUMBERED
    numbered = parts.withColumn("__n", F.explode(F.sequence(
        start, F.least(start + NUMBERED, F.col("__held")) - 1)))
    return own.unionByName(numbered.select(*own.columns))


def mix_sources(docs: DataFrame, weights: dict | None = None, repeat: float = 1.0,
                seed: str = "mix", copy_column: str | None = None,
                key_column: str | None = None) -> DataFrame:
    """Documents repeated to the target weights, in a global random order.

    Returns the columns of ``docs``; ``copy_column`` and ``key_column`` name columns to add with
    the number of the copy (from 0) and the order key. An input column of such a name is replaced.
    """
    rates = source_rates(docs, weights, repeat)
    keep = [c for c in docs.columns if c not in (copy_column, key_column)]
    rows = _told_apart(docs.select(*[F.col(f"`{c}`") for c in keep],
                                   _source_key().alias("__key")))
    if rates.count() <= BROADCAST_SOURCES:
        rated = rows.join(F.broadcast(rates), "__key")
    else:
        salt = F.pmod(F.xxhash64("doc_id", "__row", "__n"), F.lit(SALTS)).cast("int")
        spread = rates.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rated = rows.withColumn("__salt", salt).join(spread, ["__key", "__salt"]).drop("__salt")
    more = (F.col("__row"), F.when(F.col("doc_id").isNull(), F.col("__n")))
    count = F.aggregate(
        F.sequence(F.lit(0), F.col("__parts") - 1), F.lit(0),
        lambda acc, part: acc + F.size(F.filter(
            F.col("__cdf"), lambda c: c <= uniform(
                seed, F.col("doc_id"), part, more=more))))
    copies = rated.withColumn("__count", count).filter("__count > 0").select(
        *[F.col(f"`{c}`") for c in keep], "__row", "__n",
        F.explode(F.sequence(F.lit(0), F.col("__count") - 1)).alias("__copy"))
    key = F.md5(F.concat_ws(":", F.lit(seed + "-order"),
                            F.coalesce(F.col("doc_id").cast("string"), F.lit("null")),
                            F.col("__copy").cast("string"), F.col("__row"),
                            F.col("__n").cast("string")))
    shuffled = copies.withColumn("__order", key).repartition("__order").sortWithinPartitions(
        "__order")
    extra = [F.col(c).alias(name) for c, name in (("__copy", copy_column),
                                                  ("__order", key_column)) if name]
    return shuffled.select(*[F.col(f"`{c}`") for c in keep], *extra)
