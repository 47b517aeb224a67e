"""Column functions: all built-in expressions, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import schemas as S


def is_key(col) -> Column:
    """True for what can be a key: the text of a whole number from 0 to 2^64 - 1."""
    text = F.col(col).cast("string") if isinstance(col, str) else col.cast("string")
    number = F.when(text.rlike("^[0-9]{1,24}$"), text.cast("decimal(24,0)"))
    return F.coalesce(number <= F.lit(str(2 ** 64 - 1)).cast("decimal(24,0)"), F.lit(False))


def format_key(col, integer: bool = False) -> Column:
    """Key text: the unsigned number left-padded with zeros to 24 digits; NULL for anything that
    is not a whole number from 0 to 2^64 - 1. For a column known to be of an integer type, up to
    BIGINT, ``integer=True`` tests its sign only, in half the time."""
    if integer:
        number = F.col(col) if isinstance(col, str) else col
        return F.when(number >= 0, F.lpad(number.cast("string"), S.KEY_DIGITS, "0"))
    text = F.col(col).cast("string") if isinstance(col, str) else col.cast("string")
    return F.when(is_key(text), F.lpad(text, S.KEY_DIGITS, "0"))


def char_pad(col, n: int) -> Column:
    """Fixed-width text: right-padded with spaces to ``n`` characters; longer text stays as it
    is."""
    value = F.col(col) if isinstance(col, str) else col
    return F.when(F.char_length(value) < n, F.rpad(value, n, " ")).otherwise(value)


def int24_sign(col) -> Column:
    """Sign-extend the low 24 bits of an integer column."""
    value = F.col(col) if isinstance(col, str) else col
    return F.shiftright(F.shiftleft(value.cast("int"), 8), 8)


def null_mask(col, width: int, binary: bool = False) -> Column:
    """Expand a bitmap, low bit first, to ``width`` booleans; higher bits are ignored.

    An integer holds at most 64 bits. For wider tables pass ``binary=True`` and the bytes as they
    are logged, the first eight columns in the first byte; bits beyond the bytes are NULL.
    """
    value = F.col(col) if isinstance(col, str) else col
    if binary:
        byte = [F.conv(F.nullif(F.hex(F.substring(value, i // 8 + 1, 1)), F.lit("")), 16, 10)
                .cast("int") for i in range(0, width, 8)]
        return F.array(*[F.getbit(byte[i // 8], F.lit(i % 8)) == 1 for i in range(width)])
    if width > 64:
        raise ValueError("an integer bitmap holds 64 columns; pass bytes and binary=True")
    bits = value.cast("bigint")
    return F.array(*[F.getbit(bits, F.lit(i)) == 1 for i in range(width)])


def masked(col, mask, position: int) -> Column:
    """``col``, or NULL where the mask marks ``position`` as null."""
    value = F.col(col) if isinstance(col, str) else col
    bits = F.col(mask) if isinstance(mask, str) else mask
    return F.when(~F.get(bits, F.lit(position)), value)


def classify_op(type_code) -> Column:
    """Rows-event code to change operation; NULL for any other event."""
    code = F.col(type_code) if isinstance(type_code, str) else type_code
    return (F.when(code == S.WRITE_ROWS_V1, S.INSERT)
            .when(code == S.UPDATE_ROWS_V1, S.UPDATE)
            .when(code == S.DELETE_ROWS_V1, S.DELETE))


def log_seq(file_seq, offset) -> Column:
    """Total order of the log as one BIGINT: file number in the high half, offset in the low."""
    high = F.col(file_seq) if isinstance(file_seq, str) else file_seq
    low = F.col(offset) if isinstance(offset, str) else offset
    return F.shiftleft(high.cast("bigint"), 32) + low.cast("bigint")


def build_document(*cols, **named) -> Column:
    """Named columns as one VARIANT document, so tables of any shape share a column."""
    fields = [F.col(c) if isinstance(c, str) else c for c in cols]
    fields += [v.alias(k) for k, v in named.items()]
    return F.to_variant_object(F.struct(*fields))


def document_field(doc, name: str, data_type: str) -> Column:
    """Field of a document as ``data_type``; NULL when absent."""
    return F.variant_get(doc, f"$.{name}", data_type)
