"""The types of a table over all versions of its schema, folded to one that holds every row.

Of each logged type four numbers count: the signed bits its whole numbers need, the mantissa bits of
its fractions, whether it is text, and whether it is not accepted at all. The fold of several types
is the largest of each, which needs no order of versions and no more than one aggregate; a Spark
type that holds these four holds the values of every version exactly, as text where nothing else
does.

Defined cases: booleans count as 0 and 1 beside numbers; whole numbers beside fractions become DOUBLE
if its mantissa holds them, else text; a column that some version lacks is null in its rows; a column
of a type that is not accepted has no folded type; names are told apart by case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import schemas as S

# type code: (signed bits, signed bits of the unsigned form)
_BITS = {S.BOOL: (1, 1), S.TINY: (8, 9), S.SHORT: (16, 17), S.INT24: (24, 25), S.LONG: (32, 33),
         S.LONGLONG: (64, 65)}
_WHOLE = ((1, "boolean"), (8, "tinyint"), (16, "smallint"), (32, "int"), (64, "bigint"),
          (65, "decimal(20,0)"))
_SINGLE, _DOUBLE = 24, 53
# Whole numbers beside FLOAT: of up to two bytes, as three bytes are read as four.
_BESIDE_SINGLE = 17


def _needs(code: Column, meta: Column, unsigned: Column) -> dict[str, Column]:
    bits = F.lit(0)
    for number, (signed, plain) in _BITS.items():
        bits = F.when(code == number, F.when(unsigned, plain).otherwise(signed)).otherwise(bits)
    mantissa = F.when(code.isin(S.FLOAT, S.DOUBLE), F.when(meta == 4, _SINGLE).otherwise(_DOUBLE))
    known = F.coalesce(code.isin(*S.ACCEPTED_TYPES), F.lit(False))
    return {"bits": bits, "mantissa": F.coalesce(mantissa, F.lit(0)),
            "text": F.coalesce(code.isin(S.VARCHAR, S.STRING), F.lit(False)), "unknown": ~known}


def _read_off(bits: Column, mantissa: Column, text: Column, unknown: Column) -> Column:
    """The narrowest type that holds what the four numbers say; null if there is none."""
    whole = F.lit(None).cast("string")
    for most, name in reversed(_WHOLE):
        whole = F.when(bits <= most, name).otherwise(whole)
    # A fraction of m bits holds whole numbers of m bits and a sign.
    real = F.when((mantissa <= _SINGLE) & (bits <= _BESIDE_SINGLE), "float").when(
        bits <= _DOUBLE + 1, "double").otherwise("string")
    return F.when(~unknown, F.when(text, "string").when(mantissa > 0, real).otherwise(whole))


def schema_history(catalog: DataFrame) -> DataFrame:
    """One row per table and column name of a ``column_catalog`` with all its versions.

    ``data_type``: the folded type; ``types``: the different Spark types it was logged with;
    ``ordinal``: its place in the newest version that has it; ``first_seq``, ``last_seq``: the
    first and the last table map that has it; ``n_maps`` of ``of_maps`` table maps have it (a map
    read again counts again);
    ``added``, ``dropped``: the first, the last table map of the table lacks it; ``reason``: why not
    every version's values keep their kind (``unsupported_type``, ``mixed_kinds``), else null.
    """
    code, meta = F.col("type_code"), F.coalesce("meta", F.lit(0))
    needs = _needs(code, meta, F.coalesce("unsigned", F.lit(False)))
    seq = F.shiftleft(F.col("file_seq").cast("bigint"), 32) + F.col("byte_off")
    own = _read_off(*needs.values())
    columns = catalog.select(
        "database", "table", "name", "ordinal", seq.alias("seq"), own.alias("type"),
        *[v.alias(k) for k, v in needs.items()]).groupBy("database", "table", "name").agg(
        *[F.max(k).alias(k) for k in needs], F.collect_set("type").alias("types"),
        F.max_by("ordinal", "seq").alias("ordinal"), F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"), F.count("*").alias("n_maps"),
        F.count_if(F.col("ordinal") == 0).alias("firsts"))
    tables = columns.groupBy("database", "table").agg(
        F.min("first_seq").alias("start"), F.max("last_seq").alias("end"),
        F.sum("firsts").alias("of_maps"))
    folded = _read_off(*[F.col(k) for k in needs])
    mixed = (folded == "string") & ((F.col("bits") > 0) | (F.col("mantissa") > 0))
    return columns.join(tables, ["database", "table"]).select(
        "database", "table", "name", "ordinal", folded.alias("data_type"),
        F.sort_array("types").alias("types"), "first_seq", "last_seq", "n_maps", "of_maps",
        (F.col("first_seq") > F.col("start")).alias("added"),
        (F.col("last_seq") < F.col("end")).alias("dropped"),
        F.when(F.col("unknown"), "unsupported_type").when(mixed, "mixed_kinds").alias("reason"))


def misfits(history: DataFrame) -> DataFrame:
    """Columns whose values do not keep their kind in the folded type, or have none."""
    return history.filter(F.col("reason").isNotNull())


def folded_types(history: DataFrame) -> dict[tuple[str, str], T.StructType]:
    """The folded row of every table: columns of the newest version in its order, then those it
    dropped, the latest first. Columns without a type are left out. Only schemas reach the driver."""
    rows = history.filter(F.col("data_type").isNotNull()).select(
        "database", "table", "name", "ordinal", "data_type", "dropped", "last_seq").collect()
    found: dict[tuple[str, str], list] = {}
    for row in sorted(rows, key=lambda r: (r.database, r.table, -r.last_seq if r.dropped else
                                           float("-inf"), r.ordinal, r.name)):
        found.setdefault((row.database, row.table), []).append(
            T.StructField(row.name, T.DataType.fromDDL(row.data_type)))
    return {table: T.StructType(fields) for table, fields in found.items()}


def conform(rows: DataFrame, target: T.StructType) -> DataFrame:
    """Rows of any version with the columns and types of ``target``; columns they lack are null.
    Casts only widen if ``target`` is folded from that version too. A column that ``target`` does
    not know is an error."""
    known = {f.name for f in target}
    if extra := [c for c in rows.columns if c not in known]:
        raise ValueError(f"not in the target type: {extra}")
    return rows.select(*[
        (F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType)
        .alias(f.name) for f in target])
