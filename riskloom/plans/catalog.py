"""Registered queries: one per operator / pipeline, each with its
DuckDB oracle SQL where the operator is SQL-expressible.

Every query reads the driver tables at ``sf_dir`` (or views Spark
derives from them) in full. Floating outputs are rounded the same way
on both sides (``finalize`` / ``oracle.final_select``) so that the
order of floating-point additions cannot change a compared value.
"""

from __future__ import annotations

import contextvars
import functools
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DoubleType, FloatType

from riskloom.functions.exprs import double_sql, quoted
from riskloom.plans import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


# Table readers shared while one query builds its plan (nested query
# calls included): each table's files are listed and its footers read
# once per build, not once per branch. The scope ends with the build, so
# a later call sees the files as they are then.
_READ_SCOPE: contextvars.ContextVar[dict | None] = contextvars.ContextVar("read_scope", default=None)


def read_scope() -> dict | None:
    return _READ_SCOPE.get()


def register(name: str, sql: str | None = None):
    def deco(fn):
        @functools.wraps(fn)
        def build(spark, sf):
            if _READ_SCOPE.get() is not None:
                return fn(spark, sf)
            token = _READ_SCOPE.set({})
            try:
                return fn(spark, sf)
            finally:
                _READ_SCOPE.reset(token)
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = sql
        return build
    return deco


def stable_round(c: str) -> str:
    """SQL text that snaps a column to the magnitude band's grid (see ``oracle.rnd``)."""
    pi, d = double_sql(math.pi), O.DIGITS
    # floor() is a bigint already; no narrowing cast, so no per-column
    # overflow-check code (wide outputs stay within a 64 KB method)
    band = f"least({O.E_MAX}L, greatest({O.E_MIN}L, floor(log10(abs({c}) / {pi}))))"
    step = (f"CASE WHEN {band} >= {d} THEN {pi} * pow(10.0D, {band} - {d}) "
            f"ELSE {pi} / pow(10.0D, {d} - {band}) END")
    return (f"CASE WHEN {c} = 0 OR isnan({c}) OR abs({c}) = {double_sql(math.inf)} THEN {c} "
            f"ELSE rint({c} / ({step})) * ({step}) END")


def finalize(df: DataFrame) -> DataFrame:
    """Round every floating column (same bands as the SQL side)."""
    return df.selectExpr(*[f"{stable_round(quoted(f.name))} AS {quoted(f.name)}"
                           if isinstance(f.dataType, (DoubleType, FloatType)) else quoted(f.name)
                           for f in df.schema.fields])
