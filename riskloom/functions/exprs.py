"""Scalar expressions with the reference's missing-value semantics.

Canonical missing value is SQL NULL. pandas' NaN becomes NULL at the
scan and after every arithmetic step; +-inf is kept (it is a real value
in the feature table until ``replace_inf``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType

INF = float("inf")
NEG_INF = float("-inf")


def quoted(name: str) -> str:
    """A column's name as SQL text. Wide projections are built as SQL text: a call into
    the JVM for each part of each column takes seconds on hundreds of columns."""
    return "`" + name.replace("`", "``") + "`"


def double_sql(x: float) -> str:
    """A double as SQL text, infinities and NaN included."""
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def qcol(name: str) -> Column:
    """Column by exact name, safe for dots, spaces and other characters."""
    return F.col("`" + name.replace("`", "``") + "`")


def _c(x) -> Column:
    return qcol(x) if isinstance(x, str) else x


def is_floating(dt: DataType) -> bool:
    return isinstance(dt, (DoubleType, FloatType))


def clean_nan(c) -> Column:
    """NaN -> NULL (Spark orders NaN above +inf and counts it as a value)."""
    c = _c(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def clean(c, dt: DataType) -> Column:
    """``clean_nan`` for floating columns, identity otherwise."""
    return clean_nan(c) if is_floating(dt) else _c(c)


def ieee_div(a, b) -> Column:
    """a / b with IEEE results: x/0 -> +-inf by the sign of x, 0/0 -> NULL.

    Plain ``/`` raises under ANSI mode and ``try_divide`` gives NULL for
    x/0; pandas gives +-inf, which later steps audit and replace.
    """
    a, b = _c(a).cast("double"), _c(b).cast("double")
    q = (F.when(b == 0, F.when(a > 0, F.lit(INF)).when(a < 0, F.lit(NEG_INF)))
         .otherwise(a / b))
    return clean_nan(q)


def sentinel_null(c, sentinel=365243) -> Column:
    """Sentinel 'no date' value -> NULL."""
    return F.nullif(_c(c), F.lit(sentinel))


def clamp_zero(c) -> Column:
    """x if x > 0 else 0; a missing x gives 0 as in the reference (NaN > 0 is false)."""
    c = _c(c)
    return F.when(c > 0, c).otherwise(F.lit(0))


def replace_inf(c, big: float = 1.0e9) -> Column:
    """+inf -> big, -inf -> -big, everything else unchanged."""
    c = _c(c)
    return (F.when(c == F.lit(INF), F.lit(big))
            .when(c == F.lit(NEG_INF), F.lit(-big))
            .otherwise(c))


def not_equal_keep_null(c, value) -> Column:
    """``c != value`` that keeps NULL rows (pandas semantics)."""
    return ~_c(c).eqNullSafe(F.lit(value))


def conditional_value(cond: Column, if_true, if_false) -> Column:
    """Two-way conditional value (row weights by label)."""
    return F.when(cond, F.lit(if_true)).otherwise(F.lit(if_false))


def portable_hash(*keys, seed=0) -> Column:
    """Repeatable 32-bit hash of the key(s) and a seed.

    First 8 hex digits of md5('k1:k2:...:seed') as a non-negative bigint.
    The same value is computable in DuckDB (see ``portable_hash_sql``), so
    samples and folds are oracle-checkable, and it does not change when a
    task is retried or data is repartitioned (unlike ``rand()``).
    """
    parts = [_c(k).cast("string") for k in keys] + [F.lit(str(seed))]
    digest = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def portable_hash_sql(*keys: str, seed=0) -> str:
    """DuckDB form of ``portable_hash``."""
    inner = " || ':' || ".join([f"CAST({k} AS VARCHAR)" for k in keys] + [f"'{seed}'"])
    return f"CAST(('0x' || substr(md5({inner}), 1, 8)) AS BIGINT)"
