"""Typed columns for change feeds that carry values as text or JSON. What does not fit its type,
fixed-width text that is too long included, becomes NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import schemas as S


def _typed(value: Column, type_code: int, meta: int, unsigned: bool) -> Column:
    """One text value as its column type; out-of-range or malformed text becomes NULL."""
    if type_code == S.STRING:
        width = (meta >> 8) // 4
        return F.when(F.char_length(value) <= width, F.rpad(value, width, " "))
    if type_code == S.VARCHAR:
        return value
    if type_code == S.BOOL:
        return value.try_cast("int") != 0
    if type_code in (S.FLOAT, S.DOUBLE):
        return value.try_cast("float" if meta == 4 else "double")
    bits = {S.TINY: 8, S.SHORT: 16, S.INT24: 24, S.LONG: 32, S.LONGLONG: 64}[type_code]
    low, high = (0, 2 ** bits - 1) if unsigned else (-(2 ** (bits - 1)), 2 ** (bits - 1) - 1)
    target = S.spark_type(type_code, meta, unsigned)
    # Text is read as an exact decimal first, so that 2^64-1 survives and "1.5" does not.
    number = F.when(value.rlike(r"^\s*[+-]?[0-9]+\s*$"), value.try_cast("decimal(38,0)"))
    bounds = [F.lit(str(bound)).cast("decimal(38,0)") for bound in (low, high)]
    return F.when(number.between(*bounds), number.cast(target))


def cast_columns(df: DataFrame, table_schema, source: str | None = None) -> DataFrame:
    """Type the columns of a text feed.

    ``table_schema`` lists column descriptions (mappings with name, type_code, meta, unsigned).
    With ``source`` the values are fields of that JSON column, read in one pass; without it
    they are text columns of the same names, replaced in place.
    """
    if source is not None:
        text = ", ".join(f"`{c['name']}` string" for c in table_schema)
        df = df.withColumn("__doc", F.from_json(F.col(source), text))
    typed = {
        c["name"]: _typed(
            F.col(f"__doc.`{c['name']}`") if source is not None else F.col(f"`{c['name']}`"),
            c["type_code"], c.get("meta", 0), c.get("unsigned", False))
        for c in table_schema
    }
    return df.withColumns(typed).drop("__doc")
