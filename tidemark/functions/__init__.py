from .scalar import (
    build_document,
    char_pad,
    classify_op,
    document_field,
    format_key,
    is_key,
    int24_sign,
    log_seq,
    null_mask,
    masked,
)
from .cast import cast_columns

__all__ = [
    "build_document", "cast_columns", "char_pad", "classify_op", "document_field",
    "format_key", "is_key", "int24_sign", "log_seq", "masked",
    "null_mask",
]
