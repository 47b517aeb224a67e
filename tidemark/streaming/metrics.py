"""Change metrics on a stream, and what streams observed, kept as tables."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from .. import schemas as S
from ..operators.carry import carry_last
from ..operators.grouping import with_group_hash
from ..sources.versions import note
from .apply import keep_batches, read_kept, state_per_core, use_rocksdb

#: Positions whose changes of one key are one row of the state.
SPAN_BITS = 14
_BY = ("database", "table", "key")
_OPS = (S.INSERT, S.UPDATE, S.DELETE)
_COUNTS = tuple(f"{kind}_{op.lower()}" for kind in ("n", "found", "open") for op in _OPS)
_FIELDS = ("counts", "live")


def span_summary(changes: Column) -> Column:
    """What an ascending array of (seq, op) of one key says of itself: the number of changes by op;
    of them those ``found`` (INSERTs of a live key, others of a missing one) and those left
    ``open`` because no INSERT or DELETE of the array comes before; and whether the key is live at
    its end (null: as before)."""
    start = F.struct(F.lit(None).cast("boolean").alias("live"),
                     *[F.lit(0).cast("bigint").alias(c) for c in _COUNTS])

    def step(acc: Column, change: Column) -> Column:
        op, live = change["op"], acc["live"]
        wrong = F.when(op == S.INSERT, live).otherwise(~live)
        hits = {"n": F.lit(1), "found": F.coalesce(wrong, F.lit(False)), "open": live.isNull()}
        return F.struct(
            F.when(op == S.INSERT, True).when(op == S.DELETE, False).otherwise(live).alias("live"),
            *[(acc[f"{k}_{o.lower()}"] + F.when(op == o, hit.cast("bigint")).otherwise(0))
              .alias(f"{k}_{o.lower()}") for k, hit in hits.items() for o in _OPS])

    return F.aggregate(changes, start, step)


def stream_metrics(changes: DataFrame, target: str, checkpoint: str, bits: int = SPAN_BITS,
                   on_batch=None, rocksdb: bool = True, max_batches: int = 20,
                   **trigger) -> StreamingQuery:
    """Streaming twin of ``change_metrics``; ``read_metrics`` gives the totals so far.

    The state is one row per key and stretch of ``2**bits`` positions: its distinct (seq, op). So
    changes may come in any order and again, however late, and a key that holds a third of all
    changes is spread over its stretches, none of which can hold more than ``2**bits`` changes.
    Each micro-batch writes the summaries of the stretches it touched; ``on_batch(df, batch_id)``
    sees them as they change, with duplicate INSERTs and changes of missing keys in
    ``counts.found_*``. What a stretch leaves open is decided by those before it on reading.
    """
    if rocksdb:
        use_rocksdb(changes.sparkSession)
    spark = changes.sparkSession
    # A change without a position or an operation says nothing of an order.
    feed = changes.filter(F.col("seq").isNotNull() & F.col("op").isin(*_OPS)).select(
        *_BY, "op", F.col("seq").cast("bigint").alias("seq"))
    feed, group = with_group_hash(feed, list(_BY))
    spans = feed.groupBy(*group, F.shiftright("seq", bits).alias("span")).agg(
        F.sort_array(F.collect_set(F.struct("seq", "op"))).alias("changes"))
    rows = spans.select(*_BY, "span", span_summary(F.col("changes")).alias("summary")).select(
        *_BY, "span", F.struct(*[F.col(f"summary.{c}") for c in _COUNTS]).alias("counts"),
        "summary.live")
    write = keep_batches(spark, target, (*_BY, "span"), _FIELDS, max_batches, on_batch)
    with state_per_core(spark):
        return (rows.writeStream.outputMode("update").foreachBatch(write)
                .option("checkpointLocation", checkpoint)
                .trigger(**(trigger or {"processingTime": "5 seconds"})).start())


def read_metrics(spark: SparkSession, target: str) -> DataFrame:
    """The columns of ``change_metrics`` for all changes a ``stream_metrics`` target has seen."""
    spans = read_kept(spark, target, (*_BY, "span"), _FIELDS)
    seen = carry_last(spans, list(_BY), "span", F.col("live"), "__before", strict=True)
    before = F.coalesce("__before", F.lit(False))
    ops = F.array(*[F.struct(
        F.lit(op).alias("op"), F.col(f"counts.n_{op.lower()}").alias("n"),
        (F.col(f"counts.found_{op.lower()}")
         + F.when(before if op == S.INSERT else ~before, F.col(f"counts.open_{op.lower()}"))
         .otherwise(0)).alias("found")) for op in _OPS])
    flat = seen.select("database", "table", F.explode(ops).alias("o")).filter("o.n > 0")
    return flat.groupBy("database", "table", F.col("o.op").alias("op")).agg(
        F.sum("o.n").alias("n_changes"),
        F.sum(F.when(F.col("o.op") == S.INSERT, F.col("o.found")).otherwise(0))
        .alias("duplicate_inserts"),
        F.sum(F.when(F.col("o.op") != S.INSERT, F.col("o.found")).otherwise(0))
        .alias("missing_key_changes"))


_PROGRESS_KEY = ("batch", "name", "metric")
_PROGRESS = "batch bigint, name string, metric string, value string"


class ObservedTotals(StreamingQueryListener):
    """Stores what ``tap`` observes in each micro-batch of a stream, to be read with
    ``read_observed``. Add it with ``spark.streams.addListener`` before the streams start.

    A query has a folder of its own by its id, which its checkpoint keeps over restarts; a batch
    that runs again replaces its totals. Old folders are merged beyond ``max_batches``. Values are
    stored as text, numbers without loss; an observation of another kind as Spark prints it.
    """

    def __init__(self, spark: SparkSession, target: str, max_batches: int = 20):
        self._spark, self._target, self._max = spark, target, max_batches

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        rows = [(progress.batchId, name, metric, _text(value))
                for name, totals in progress.observedMetrics.items()
                for metric, value in totals.asDict().items()]
        if rows:
            write = keep_batches(self._spark, f"{self._target}/query={progress.id}",
                                 _PROGRESS_KEY, ("value",), self._max)
            write(note(self._spark, rows, _PROGRESS).coalesce(1), progress.batchId)

    def onQueryTerminated(self, event) -> None:
        pass


def _text(value) -> str | None:
    if value is None:
        return None
    return format(value, "f") if isinstance(value, Decimal) else str(value)


def read_observed(spark: SparkSession, target: str, query_id: str) -> DataFrame:
    """``batch``, ``name``, ``metric`` and ``value`` (text) of a query's observed totals."""
    return read_kept(spark, f"{target}/query={query_id}", _PROGRESS_KEY, ("value",))
