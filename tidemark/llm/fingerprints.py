"""Threshold-scaled sketches of documents, in built-in functions only.

A text's shingles are five words in a row, lowered, as 64-bit hashes; with fewer words the whole
sequence is one shingle. The sketch keeps every hash in the lowest eighth of all hashes, so that
sketches of texts of any two sizes compare and merge. A text with fewer than ``FLOOR`` such hashes
keeps its ``FLOOR`` lowest instead (all, if it has no more). A sketch knows up to which hash it is
complete (``upto``); two sketches are compared up to the lower of the two.

A sketch is a struct of ``upto`` and the ascending ``hashes``. Hashes are signed; "low" is in
signed order.

Defined cases: a null text is empty; a text without words has an empty, complete sketch; two
empty sketches are alike (1), an empty one and another are not (0). In the order of documents
rows with equal doc_id stand in falling order of their texts' hashes and a null doc_id stands last.
A document that is alone is its own next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.scratch import new_path

WORDS, FRACTION, FLOOR = 5, 8, 16
#: Firsts of ranges (two numbers each) are broadcast up to this many; more join by shuffles.
BROADCAST_HEADS = 1 << 20
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1
#: Bits of doc_id that are cut off: documents of 2^12 neighbouring ids share a window.
_BITS = 12
#: Leading bits of a text's hash by which the rows of a repeated id are dealt.
_SLICE_BITS = 16


def _hashes(text: Column, words: int) -> Column:
    """All shingle hashes of a text."""
    parts = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")

    def of(w: Column) -> Column:
        n = F.size(w)
        each = F.transform(F.sequence(F.lit(0), n - words), lambda i: F.xxhash64(
            *[F.get(w, i + k) for k in range(words)]))
        return (F.when(n >= words, each).when(n == 0, F.array().cast("array<bigint>"))
                .otherwise(F.array(F.xxhash64(w))))
    # One-element transforms name a value, so that it is computed once.
    return F.transform(F.array(parts), of)[0]


def sketch(text: Column, words: int = WORDS, fraction: int = FRACTION,
           floor: int = FLOOR) -> Column:
    """The sketch of a text."""
    bound = _LOW + (1 << 64) // fraction - 1

    def of(h: Column) -> Column:
        low = F.sort_array(F.array_distinct(F.filter(h, lambda x: x <= bound)))
        every = F.sort_array(F.array_distinct(h))
        few = F.when(F.size(every) <= floor, F.struct(F.lit(_HIGH).alias("upto"),
                                                      every.alias("hashes"))).otherwise(
            F.struct(F.get(every, F.lit(floor - 1)).alias("upto"),
                     F.slice(every, 1, floor).alias("hashes")))
        return F.transform(F.array(low), lambda kept: F.when(
            F.size(kept) >= floor, F.struct(F.lit(bound).cast("bigint").alias("upto"),
                                            kept.alias("hashes"))).otherwise(few))[0]
    return F.transform(F.array(_hashes(text, words)), of)[0]


def sketch_text(value: Column) -> Column:
    """A sketch as text: ``upto`` and the hashes in hexadecimal digits."""
    return F.lower(F.concat(F.hex(value["upto"]), F.lit(":"), F.concat_ws(
        ".", F.transform(value["hashes"], lambda x: F.hex(x)))))


def _common(a: Column, b: Column) -> tuple[Column, Column]:
    upto = F.least(a["upto"], b["upto"])
    return (F.filter(a["hashes"], lambda x: x <= upto), F.filter(b["hashes"], lambda x: x <= upto))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles (0 to 1)."""
    x, y = _common(a, b)
    both = F.size(F.array_intersect(x, y))
    all_ = F.size(x) + F.size(y) - both
    return F.when(all_ == 0, 1.0).otherwise(both / all_)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has too (0 to 1)."""
    x, y = _common(a, b)
    return F.when(F.size(x) == 0, F.when(F.size(a["hashes"]) == 0, 1.0)).otherwise(
        F.size(F.array_intersect(x, y)) / F.size(x))


def merged(a: Column, b: Column) -> Column:
    """The sketch of both texts' shingles together."""
    x, y = _common(a, b)
    return F.struct(F.least(a["upto"], b["upto"]).alias("upto"),
                    F.sort_array(F.array_union(x, y)).alias("hashes"))


def _next_heads(heads: DataFrame, low: int, high: int) -> DataFrame:
    """For each ``key`` the ``head`` of the next lower key as ``next`` (null for the lowest);
    keys lie between ``low`` and ``high``. Windows hold at most 2^12 keys on every level."""
    last = high - low < 1 << _BITS
    group = F.lit(0).cast("bigint") if last else F.shiftright("key", _BITS)
    lead = F.lead("head").over(Window.partitionBy(group).orderBy(F.desc("key")))
    found = heads.select("key", lead.alias("next"), group.alias("__group"))
    if last:
        return found.select("key", "next")
    upper = heads.groupBy(group.alias("key")).agg(F.max_by("head", "key").alias("head"))
    after = _next_heads(upper, low >> _BITS, high >> _BITS).select(
        F.col("key").alias("__group"), F.col("next").alias("__next"))
    return found.join(after, "__group").select(
        "key", F.coalesce("next", "__next").alias("next"))


def _chained(rows: DataFrame) -> DataFrame:
    """Each of ``rows`` (with ``__id``, one row an id) with text and sketch of the next lower id's
    row as ``next_text`` and ``next_sketch``; after the lowest comes the highest.

    Rows are dealt by ranges of 2^12 ids; the first row of the next lower range is added to each
    range, so texts are shuffled once.
    """
    low, high = rows.agg(F.min("__id"), F.max("__id")).first()
    low, high = (0, 0) if low is None else (low, high)
    bucket = F.shiftright("__id", _BITS)
    heads = rows.groupBy(bucket.alias("key")).agg(F.max("__id").alias("head"))
    path = new_path(rows.sparkSession, "heads")
    _next_heads(heads, low >> _BITS, high >> _BITS).select(
        F.col("key").alias("__bucket"), F.coalesce("next", F.lit(high)).alias("__head")) \
        .write.parquet(path)
    border = rows.join(_small(rows.sparkSession.read.parquet(path)),
                       F.col("__id") == F.col("__head")).select("__bucket", "text")
    return _led(rows.withColumn("__bucket", bucket), border, ["__bucket"], "__id")


def _small(df: DataFrame) -> DataFrame:
    """A stored table, to be broadcast if it is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_HEADS else df


def _led(rows: DataFrame, border: DataFrame, by: list[str], order: str) -> DataFrame:
    """Rows of each group ``by`` with the next one by falling ``order``, and the ``border`` text
    of the group behind the last."""
    names = rows.columns
    both = rows.withColumn("__border", F.lit(False)).unionByName(
        border.withColumn("__border", F.lit(True)), allowMissingColumns=True)
    window = Window.partitionBy(*by).orderBy("__border", F.desc(order), F.desc("text"))
    # Sketches are made behind the shuffle, which then moves texts only.
    sketched = both.repartition(*by).withColumn("sketch", sketch(F.col("text")))
    return sketched.withColumns({
        "next_text": F.lead("text").over(window), "next_sketch": F.lead("sketch").over(window),
    }).filter(~F.col("__border")).select(*names, "sketch", "next_text", "next_sketch")


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and ``sketch`` of each document with ``next_text`` and
    ``next_sketch`` of the next one in falling order of doc_id; after the last comes the first.

    An id on several rows stands in the order of ids by one of them, the first; its rows are dealt
    by ranges of their texts' hashes, in which they follow each other.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.coalesce("text", F.lit("")).alias("text"),
                       F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LOW)).alias("__id"))
    out = ("doc_id", "text", "sketch", "next_text", "next_sketch")
    path = new_path(spark, "repeated")
    rows.groupBy("__id").agg(F.count("*").alias("__n")).filter("__n > 1").select(
        "__id", F.lit(True).alias("__many")).write.parquet(path)
    repeated = spark.read.parquet(path)
    if repeated.isEmpty():
        return _chained(rows).select(*out)
    rows = rows.join(_small(repeated), "__id", "left")
    many = rows.filter("__many").withColumn("__hash", F.xxhash64("text")).withColumn(
        "__slice", F.shiftright("__hash", 64 - _SLICE_BITS))
    firsts = many.groupBy("__id").agg(
        F.first("doc_id").alias("doc_id"), F.max(F.struct("__hash", "text"))["text"].alias("text"),
        F.lit(True).alias("__many"))
    chain = _chained(rows.filter("__many IS NULL").unionByName(firsts))

    # At most 2^16 slices an id, each with its highest hash; behind the last one comes the next id.
    path = new_path(spark, "slices")
    many.groupBy("__id", "__slice").agg(F.max("__hash").alias("top")).withColumn(
        "__top", F.lead("top").over(Window.partitionBy("__id").orderBy(F.desc("__slice")))) \
        .select("__id", "__slice", "__top").write.parquet(path)
    slices = _small(spark.read.parquet(path))
    inner = many.withColumnRenamed("__slice", "__from").join(
        slices.select("__id", "__slice", F.col("__top").alias("__hash")).filter("__hash IS NOT NULL"),
        ["__id", "__hash"]).groupBy("__id", "__slice").agg(F.max("text").alias("text"))
    outer = chain.filter("__many").select("__id", F.col("next_text").alias("text")).join(
        slices.filter("__top IS NULL").select("__id", "__slice"), "__id").select(
        "__id", "__slice", "text")
    led = _led(many, inner.unionByName(outer), ["__id", "__slice"], "__hash")
    return chain.filter("__many IS NULL").select(*out).unionByName(led.select(*out))


def edited_text(text: Column, other: Column) -> Column:
    """The text with its last third of code points (rounded down) replaced by the first as many
    (or all) of the other text."""
    n = F.char_length(text)
    cut = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(other, F.lit(1), cut))
