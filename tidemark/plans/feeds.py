"""Change feeds derived from the given tables.

``id`` is the number behind the 24-digit ``key``. Aggregates go by ``id`` where they can: it is
a third as wide, sorts faster, and the text is then made once per surviving row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from .. import schemas as S
from ..functions import build_document, format_key

DATABASE = "e_store"
#: Lines of an order that one window holds.
MOST_LINES = 1 << 12


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def utc_micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp without zone, read as UTC in any session."""
    return F.unix_micros(F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone()))


def event_op(event_type: Column) -> Column:
    return (F.when(event_type == "signup", S.INSERT).when(event_type == "error", S.DELETE)
            .otherwise(S.UPDATE))


def user_change_columns(events: DataFrame) -> DataFrame:
    """Feed A shape on any ``events`` DataFrame, batch or streaming."""
    return events.select(
        F.lit(DATABASE).alias("database"), F.lit("users").alias("table"),
        F.col("user_id").alias("id"), format_key("user_id", integer=True).alias("key"), event_op(F.col("event_type")).alias("op"),
        F.col("event_id").alias("seq"),
        F.struct("event_type", "value",
                 F.get_json_object("props", "$.k").cast("int").alias("k")).alias("after"))


def user_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed A: the events of each user as inserts (signup), deletes (error) and updates."""
    return user_change_columns(read(spark, sf_dir, "events"))


def schema_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed B: signups as schema messages, every other event as a rows message."""
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("table_id"), F.col("event_id").alias("seq"),
        (F.col("event_type") == "signup").alias("is_schema"), "value")


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a base state: key, status, price, last_seq."""
    return read(spark, sf_dir, "orders").select(
        format_key("o_orderkey", integer=True).alias("key"), F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("price"), F.lit(0).cast("bigint").alias("last_seq"))


def _line_op() -> Column:
    return F.when(F.col("l_returnflag") == "R", S.DELETE).otherwise(S.UPDATE)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag",
        "l_linestatus", "l_extendedprice")


def _labelled(changes: DataFrame) -> DataFrame:
    return changes.select(
        F.lit(DATABASE).alias("database"), F.lit("orders").alias("table"), "id",
        format_key("id", integer=True).alias("key"), "op", "seq", "after")


def line_ranks(lines: DataFrame) -> DataFrame:
    """Number the lines of each order by (shipdate, linenumber, partkey, suppkey).

    An order of up to ``MOST_LINES`` lines is one window, so its lines are exchanged and sorted
    once. Larger ones, of which there are at most (lines / ``MOST_LINES``), are numbered in two
    levels.
    """
    large = lines.groupBy(F.col("l_orderkey").alias("large")).agg(F.count("*").alias("n")).filter(
        F.col("n") > MOST_LINES).select("large")
    inside = Window.partitionBy("l_orderkey").orderBy(
        "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")
    same = F.col("l_orderkey").eqNullSafe(F.col("large"))
    small = lines.join(F.broadcast(large), same, "left_anti").withColumn(
        "rank", F.row_number().over(inside).cast("bigint"))
    return small.unionByName(
        _ranks_in_pieces(lines.join(F.broadcast(large), same, "left_semi")).select(*small.columns))


def _ranks_in_pieces(lines: DataFrame) -> DataFrame:
    """The numbers in two levels, so that a hot order is cut into (shipdate, linenumber) pieces:
    the pieces are counted and summed, and each piece starts from an extra first row with its sum.
    """
    piece = ["l_orderkey", "l_shipdate", "l_linenumber"]
    before = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber").rowsBetween(
        Window.unboundedPreceding, -1)
    base = lines.groupBy(*piece).agg(F.count("*").alias("n")).select(
        *piece, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"), F.lit(True).alias("base"))
    rows = lines.withColumns({"n": F.lit(1).cast("bigint"), "base": F.lit(False)})
    inside = (Window.partitionBy(*piece).orderBy(F.desc("base"), "l_partkey", "l_suppkey")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (rows.unionByName(base.filter(F.col("n") > 0), allowMissingColumns=True)
            .withColumn("rank", F.sum("n").over(inside)).filter(~F.col("base")))


def order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed D: orders inserted, their lines as later updates (A, N) and deletes (R), with the
    BIGINT ``seq`` of a log: 0 for the insert, 1.. for the lines."""
    orders = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.lit(S.INSERT).alias("op"),
        F.lit(0).cast("bigint").alias("seq"),
        F.struct(F.col("o_orderstatus").alias("status"),
                 F.col("o_totalprice").alias("price")).alias("after"))
    changes = line_ranks(_lines(spark, sf_dir)).select(
        F.col("l_orderkey").alias("id"), _line_op().alias("op"), F.col("rank").alias("seq"),
        F.struct(F.col("l_linestatus").alias("status"),
                 F.col("l_extendedprice").alias("price")).alias("after"))
    return _labelled(orders.unionByName(changes))


def mixed_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed C: feeds A and D in one, after-images as documents."""
    feeds = [user_changes(spark, sf_dir), order_changes(spark, sf_dir)]
    users, orders = [
        f.select("database", "table", "key", "op", "seq", build_document("after.*").alias("after"))
        for f in feeds]
    return users.unionByName(orders)
