"""Scalar column expressions (all JVM-side, codegen friendly)."""

from riskloom.functions.exprs import (  # noqa: F401
    INF, NEG_INF, qcol, clean_nan, clean, ieee_div, sentinel_null, clamp_zero,
    replace_inf, not_equal_keep_null, portable_hash, portable_hash_sql,
    conditional_value, is_floating,
)
