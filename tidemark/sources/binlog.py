"""Log files as DataFrames: scan, schema messages, decoded row changes."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import schemas as S
from ..functions import classify_op, format_key
from ..operators.schema import attach_table_map, column_catalog
from ..operators.validate import key_reason
from . import codec
from .datasource import LOG_NAME, LogDataSource, qualified, register
from .decode import Events, decode_events, decoded_type

LOG_GLOB = "*.[0-9]*"  # mysql-bin.000121


def binlog_scan(spark: SparkSession, path: str, reader: str = "stream",
                start_file: int | None = None, magic: bool = True,
                codes: tuple[int, ...] | None = None, bodies: bool = True,
                base: str | None = None, holes: str = "fail", index: str | None = None,
                index_every: int | None = None) -> DataFrame:
    """Events of a directory of log files (``LOG_EVENTS``), one task per file.

    ``index`` names a folder for marks: (file, position, table maps in force) every
    ``index_every`` bytes (16 MB). A scan leaves marks of what it reads to its end; later ones split
    large files at them.

    ``reader="stream"`` lists the files, prunes those before ``start_file`` and streams their
    bytes. ``reader="binaryFile"`` reads through Spark's own file systems, one file as one value.
    The first one also takes filters on ``file_seq`` and ``type_code`` of the result: files and
    events they exclude are not read. ``base`` picks the files of one log (``base.000121``); a
    folder with several logs needs it. A missing file number fails the first one's scan
    (``holes="skip"`` reads on).
    ``codes`` keeps events of these types only and ``bodies=False`` headers only, before any byte
    leaves the reading task.
    Rows events carry the table map in force at their position, so decoding needs no join.
    A file that is not a log or ends inside an event gives one row with ``error`` set (an empty
    file is not seen by the second reader).
    """
    if reader == "binaryFile":
        glob = LOG_GLOB if base is None else f"{base}.[0-9]*"
        files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
                 .load(path).select("path", "content"))
        events = split_logs(files, magic, codes, bodies)
        return events if start_file is None else events.filter(F.col("file_seq") >= start_file)
    register(spark)
    source = (spark.read.format(LogDataSource.name()).option("path", qualified(spark, path))
              .option("holes", holes)
              .option("parallelism", str(spark.sparkContext.defaultParallelism)))
    if base is not None:
        source = source.option("base", base)
    if start_file is not None:
        source = source.option("start_file", str(start_file))
    if codes is not None:
        source = source.option("codes", ",".join(map(str, codes)))
    for name, value in index_options(spark, index, index_every).items():
        source = source.option(name, value)
    return (source.option("magic", str(magic).lower()).option("bodies", str(bodies).lower())
            .load())


def index_options(spark: SparkSession, index: str | None, every: int | None) -> dict[str, str]:
    """Options of the source for an index of marks."""
    if index is None:
        return {}
    return {"index": qualified(spark, index), **({"index_every": str(every)} if every else {})}


def split_logs(files: DataFrame, magic: bool = True, codes: tuple[int, ...] | None = None,
               bodies: bool = True) -> DataFrame:
    """Events of (path, content) rows: whole log files, batch or streaming. Names that do not end
    in a number are no log files."""
    schema = to_arrow_schema(S.LOG_EVENTS)

    def split(batches):
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                name = path.as_py().rsplit("/", 1)[-1]
                if not LOG_NAME.match(name):
                    continue
                rows = codec.log_rows([content.as_buffer().to_pybytes()], name,
                                      int(name.rsplit(".", 1)[-1]), magic, codes=codes,
                                      bodies=bodies)
                yield from codec.event_batches(rows, schema)

    return files.select("path", "content").mapInArrow(split, S.LOG_EVENTS)


TABLE_MAPS = T.StructType([
    *[S.LOG_EVENTS[c] for c in ("log_file", "file_seq", "byte_off", "table_id")],
    T.StructField("database", T.StringType()),
    T.StructField("table", T.StringType()),
    T.StructField("type_codes", T.ArrayType(T.IntegerType())),
    T.StructField("metas", T.ArrayType(T.IntegerType())),
    T.StructField("nulls", T.ArrayType(T.BooleanType())),
    T.StructField("names", T.ArrayType(T.StringType())),
    T.StructField("pk", T.ArrayType(T.IntegerType())),
    T.StructField("signedness", T.ArrayType(T.BooleanType())),
    T.StructField("error", T.StringType()),
])


def table_maps(log_events: DataFrame) -> DataFrame:
    """Schema messages as rows; ``error`` is set for one that cannot be read."""
    schema = to_arrow_schema(TABLE_MAPS)

    def parse(batches):
        for batch in batches:
            # The same map is logged again and again: each distinct one is parsed once.
            bodies = batch.column("body").dictionary_encode()
            pairs = list(zip(bodies.indices.to_pylist(), batch.column("id_bytes").to_pylist()))
            number = {pair: i for i, pair in enumerate(dict.fromkeys(pairs))}
            parsed = []
            for body, width in number:
                try:
                    raw = None if body is None else bodies.dictionary[body].as_py()
                    parsed.append({**codec.parse_table_map(raw, width), "error": None})
                except (ValueError, IndexError, TypeError):
                    parsed.append({"error": "bad_table_map"})
            own = ("log_file", "file_seq", "byte_off", "table_id")
            shared = pa.schema([f for f in schema if f.name not in own])
            found = pa.RecordBatch.from_pylist(parsed, schema=shared).take(
                pa.array([number[pair] for pair in pairs], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [(batch if f.name in own else found).column(f.name).cast(f.type) for f in schema],
                schema=schema)

    return (log_events.filter(F.col("type_code") == S.TABLE_MAP_EVENT)
            .select("log_file", "file_seq", "byte_off", "table_id", "id_bytes", "body")
            .mapInArrow(parse, TABLE_MAPS))


def decode_rows(log_events: DataFrame, row: T.StructType | None = None,
                database: str | None = None, table: str | None = None,
                spread: int | None = None, tables=None) -> DataFrame:
    """One row per image (pair) of every rows event.

    With ``row`` the images are typed structs: columns are matched by name, columns of ``row``
    that a schema version lacks are NULL. Without it they are JSON text, for feeds of many
    tables. ``database``/``table`` restrict the decoding to one table, ``tables`` to some pairs of
    these, before images are read: one pass decodes several tables to a row with the columns of
    all (see ``table_row_type``).
    An event that cannot be decoded, or a file that cannot be read on, gives one row with
    ``reason`` and no image.

    Decoding runs where the file was split. ``spread`` first deals the events out to that many
    tasks, for a few large files on many cores.
    """
    broken = F.col("error").isNotNull()
    if "table_map" not in log_events.columns:
        log_events = attach_table_map(log_events.filter(~broken)).unionByName(
            log_events.filter(broken), allowMissingColumns=True)
    rows = log_events.filter(F.col("type_code").isin(*S.ROWS_EVENTS) | broken).select(
        "log_file", "file_seq", "byte_off", "event_ts", "type_code", "server_id", "id_bytes",
        "body", "table_map", "error")
    if spread:
        rows = rows.repartition(spread, "log_file", "byte_off")
    result = decoded_type(row)
    schema = to_arrow_schema(result)
    wanted = (database, table, None if tables is None else {tuple(t) for t in tables})

    def decode(batches):
        for batch in batches:
            yield from decode_events(Events.from_batch(batch), schema, row is not None, wanted)

    return rows.mapInArrow(decode, result)


def read_images(spark: SparkSession, path: str, row: T.StructType | None = None,
                database: str | None = None, table: str | None = None,
                start_file: int | None = None, tables=None) -> DataFrame:
    """``decode_rows(binlog_scan(...))`` in one pass: files are split and decoded in the same
    task, so event bodies never leave it. The path for reading changes at scale. Filters on
    ``type_code`` and ``seq`` of the result skip events and files before images are read."""
    options = image_options(spark, path, row, database, table, start_file, tables)
    return spark.read.format(LogDataSource.name()).options(**options).load()


def image_options(spark: SparkSession, path: str, row, database, table, start_file,
                  tables=None) -> dict:
    """Options of the log source for decoded images; registers the source."""
    register(spark)
    options = {"path": qualified(spark, path), "decode": "documents" if row is None else row.json(),
               "database": database, "table": table,
               "tables": None if tables is None else json.dumps([list(t) for t in tables]),
               "parallelism": str(spark.sparkContext.defaultParallelism),
               "start_file": None if start_file is None else str(start_file)}
    return {k: v for k, v in options.items() if v is not None}


def read_changes(spark: SparkSession, path: str, row: T.StructType | None = None,
                 database: str | None = None, table: str | None = None,
                 key: str = S.KEY_COLUMN, start_file: int | None = None,
                 tables=None) -> DataFrame:
    """Change rows straight from a folder of log files."""
    return changes_of(read_images(spark, path, row, database, table, start_file, tables), key)


def build_changes(log_events: DataFrame, row: T.StructType | None = None,
                  database: str | None = None, table: str | None = None,
                  key: str = S.KEY_COLUMN, spread: int | None = None) -> DataFrame:
    """Change rows of scanned ``log_events``, batch or streaming."""
    return changes_of(decode_rows(log_events, row, database, table, spread), key)


def changes_of(images: DataFrame, key: str = S.KEY_COLUMN) -> DataFrame:
    """Operation and validated 24-digit key of decoded images.

    The key is the one the row had *before* the change; the after-image goes without it, so an
    update never moves a row. ``reason`` is NULL for a good change; ``split_valid`` parts them.
    JSON images become VARIANT documents; one that is no JSON is a ``bad_document``. A key that is
    no whole number from 0 to 2^64 - 1 gives ``key_value``.
    """
    value, after = F.col("key_value"), images.schema["after"].dataType
    if isinstance(after, T.StringType):
        before, after = F.try_parse_json("before"), F.try_parse_json("after")
        broken = ((F.col("before").isNotNull() & before.isNull())
                  | (F.col("after").isNotNull() & after.isNull()))
    else:
        broken = F.lit(False)
        before, has_key = F.col("before"), key in after.fieldNames()
        after = F.col("after").dropFields(f"`{key}`") if has_key else F.col("after")
    rule = key_reason(F.col("pk_names"), value, F.col("pk_type"), F.col("pk_unsigned"), key)
    reason = F.coalesce(F.col("reason"), rule, F.when(broken, F.lit("bad_document")))
    return images.select(
        "database", "table", classify_op("type_code").alias("op"), "seq", "log_file", "event_ts",
        "server_id", F.when(reason.isNull(), format_key(value)).alias("key"),
        before.alias("before"), after.alias("after"), reason.alias("reason"))


def bad_events(log_events: DataFrame) -> DataFrame:
    """Files and events the scan could not read, in the shape of the quarantine."""
    return log_events.filter(F.col("error").isNotNull()).select(
        "log_file", F.shiftleft(F.col("file_seq").cast("bigint"), 32).alias("file_start"),
        "byte_off", F.col("error").alias("reason"))


def tables_row_type(maps: DataFrame, tables) -> T.StructType:
    """Row struct with the columns of several tables, for one pass over all of them. A column that
    two tables have with different types is refused."""
    fields: dict[str, T.StructField] = {}
    for database, table in tables:
        for field in table_row_type(maps, database, table):
            if fields.setdefault(field.name, field).dataType != field.dataType:
                raise ValueError(f"{field.name} has different types in {tables}")
    return T.StructType(list(fields.values()))


def table_row_type(maps: DataFrame, database: str, table: str) -> T.StructType:
    """Row struct of a table from the newest schema version among ``table_maps``.

    The newest map is found by an aggregate; only its columns reach the driver.
    """
    mine = maps.filter((F.col("database") == database) & (F.col("table") == table)
                       & F.col("error").isNull())
    newest = mine.agg(F.max_by(F.struct(*mine.columns), F.struct("file_seq", "byte_off"))
                      .alias("map")).filter("map IS NOT NULL").select("map.*")
    columns = column_catalog(newest).orderBy("ordinal").collect()
    if not columns:
        raise LookupError(f"no schema of {database}.{table} in this log")
    return S.row_type([c.asDict() for c in columns])
