"""Target tables: snapshot, point read, refresh, routing of a mixed feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas as S
from ..operators.apply import apply_changes
from ..operators.history import folded_types
from .versions import finished, numbers, remove


def _quoted(*names: str) -> str:
    """Names from a log as SQL identifiers."""
    return ".".join(f"`{name.replace('`', '``')}`" for name in names)


def snapshot_scan(spark: SparkSession, database: str, table: str) -> DataFrame:
    """All rows of one target table."""
    return spark.table(_quoted(database, table))


def key_lookup(state: DataFrame, key: str, column: str = "key") -> DataFrame:
    """Point read by parameter. The comparison reaches the Parquet scan, where the sorted keys
    and the bloom filter written by ``write_state`` skip row groups."""
    return state.sparkSession.sql(f"SELECT * FROM {{state}} WHERE `{column}` = :key",
                                  args={"key": key}, state=state)


def write_state(state: DataFrame, path: str, key: str = "key") -> None:
    """Overwrite the Parquet state at ``path``, laid out for point reads."""
    (state.sortWithinPartitions(key).write.mode("overwrite")
     .option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path))


def full_refresh(changes: DataFrame, path: str) -> DataFrame:
    """Rebuild the target at ``path`` from the whole log and give its rows.

    Each refresh writes a folder ``state=<n>`` of its own, which counts once its job has committed
    it; read the target with ``read_refreshed``. A refresh that fails or is killed leaves the one
    before in force, and that stays on disk for readers that have begun.
    """
    spark = changes.sparkSession
    there = numbers(spark, path, "state")
    before = [n for n in there if finished(spark, f"{path}/state={n}")][-1:]
    write_state(apply_changes(changes), f"{path}/state={max(there, default=-1) + 1}")
    for n in there:
        if n not in before:
            remove(spark, f"{path}/state={n}")
    return read_refreshed(spark, path)


def read_refreshed(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the newest finished refresh of a target."""
    for n in reversed(numbers(spark, path, "state")):
        if finished(spark, f"{path}/state={n}"):
            return spark.read.parquet(f"{path}/state={n}")
    raise FileNotFoundError(f"no finished refresh below {path}")


def state_to_json(df: DataFrame, key: str = "key") -> DataFrame:
    """(key, doc): each row as one JSON document."""
    return df.select(F.col(key).alias("key"),
                     F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("doc"))


def create_target(df: DataFrame, database: str, table: str, root: str) -> None:
    """Make the database and the table at first sight and replace the table's rows."""
    spark = df.sparkSession
    folder = f"{root}/{database}".replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {_quoted(database)} LOCATION '{folder}'")
    (df.write.mode("overwrite").format("parquet").option("path", f"{root}/{database}/{table}")
     .saveAsTable(_quoted(database, table)))


def route_changes(changes: DataFrame, root: str, mode: str = "append") -> None:
    """Fan a mixed feed out to one folder per (database, table) below ``root``.

    Rebalancing gathers a table's rows to write few files; the optimizer splits a table that is
    too large for one task. VARIANT columns are kept.
    """
    (changes.hint("rebalance", "database", "table").write.mode(mode)
     .partitionBy("database", "table").parquet(root))


def typed_targets(catalog: DataFrame, document: str = "after",
                  key: str = S.KEY_COLUMN) -> dict[tuple[str, str], list[Column]]:
    """Typed columns of every table of a ``column_catalog``, read from documents: what a table is
    made with at first sight. The newest schema version of a table counts; its key is left out.
    Only schemas reach the driver."""
    place = F.struct("file_seq", "byte_off")
    newest = catalog.groupBy("database", "table").agg(F.max(place).alias("newest"))
    rows = catalog.join(newest, ["database", "table"]).filter(place == F.col("newest")).select(
        "database", "table", "ordinal", "name", "type_code", "meta", "unsigned").distinct()
    tables: dict[tuple[str, str], list] = {}
    for row in sorted(rows.collect(), key=lambda r: (r.database, r.table, r.ordinal)):
        tables.setdefault((row.database, row.table), []).append(row.asDict())
    return {
        name: [F.try_variant_get(document, f"$['{f.name}']", f.dataType.simpleString())
               .alias(f.name) for f in S.row_type(columns) if f.name != key]
        for name, columns in tables.items()}


def folded_targets(history: DataFrame, document: str = "after",
                   key: str = S.KEY_COLUMN) -> dict[tuple[str, str], list[Column]]:
    """As ``typed_targets``, with the types of a ``schema_history``: they hold the rows of every
    version, and columns that the newest one dropped stay."""
    return {
        table: [F.try_variant_get(document, f"$['{f.name}']", f.dataType.simpleString())
                .alias(f.name) for f in row if f.name != key]
        for table, row in folded_types(history).items()}


def route_typed(changes: DataFrame, targets: dict[tuple[str, str], list[Column]],
                root: str, prefix: str = "") -> list[tuple[str, str]]:
    """Current state of each listed table of a mixed feed as a typed catalog table, made at first
    sight; gives the names of the tables. ``prefix`` is put before the names of databases.

    The loop is over tables, never over rows; each pass reads only its partition of a feed
    written by ``route_changes``. ``targets`` maps (database, table) to the typed columns.
    """
    made = []
    for (database, table), columns in targets.items():
        one = changes.filter((F.col("database") == database) & (F.col("table") == table))
        typed = one.select("key", "op", "seq", F.struct(*columns).alias("after"))
        create_target(apply_changes(typed), prefix + database, table, root)
        made.append((prefix + database, table))
    return made
