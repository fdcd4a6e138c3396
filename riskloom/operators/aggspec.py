"""Declarative aggregation specs compiled to one Spark aggregate.

A spec is the reference's ``{column: [fn, ...]}`` dict. Output names
are flattened at aggregation time to ``PREFIX + column + "_" + FN``.

Semantics follow the reference's pandas group-by, with NULL as the
missing value:

* ``min``/``max``/``mean``/``var`` skip missing values; ``var`` is the
  sample variance (one value -> NULL); inf mixing to NaN -> NULL.
* ``sum`` of an all-missing group is 0, not NULL.
* ``size`` counts rows (missing included); ``nunique`` counts distinct
  non-missing values (0 for all-missing). Spark plans a distinct count as
  an exchange of its own; a column of small whole numbers whose span is
  given (``spans``, see ``integer_spans``) is counted in the same aggregate
  instead: a bit a value, or-ed before and after the one exchange.

Subset aggregates (the reference filters rows, aggregates, and left
joins the result back) are fused into the same pass: every function
reads ``when(cond, col)``, and a group with no matching row gets NULL
for every output, sums and sizes included. One scan, one shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, BooleanType

from riskloom.functions.exprs import clean, clean_nan, qcol

SUPPORTED = ("min", "max", "mean", "sum", "var", "size", "nunique")

# Above this many aggregate outputs a single hash aggregate stops
# generating code; ``aggregate`` may split the list into chunks.
DEFAULT_MAX_EXPRS = None


def agg_name(prefix: str, col: str, fn: str) -> str:
    return f"{prefix}{col}_{fn.upper()}"


#: a span may take this many 64-bit words of a group's state
MAX_WORDS = 8


def integer_spans(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[int, int]]:
    """{column: (least, largest)} of those columns whose values are all whole numbers and
    lie close enough together to be counted by bits; one job for all."""
    if not cols:
        return {}
    aggs = []
    for i, c in enumerate(cols):
        v = qcol(c).cast("double")
        whole = F.count_if(v.isNotNull() & ((v != F.floor(v)) | F.isnan(v) | (F.abs(v) > 2.0 ** 53))) == 0
        aggs += [F.min(v).alias(f"a{i}"), F.max(v).alias(f"b{i}"), whole.alias(f"w{i}")]
    row = df.agg(*aggs).first()
    out = {}
    for i, c in enumerate(cols):
        low, high = row[f"a{i}"], row[f"b{i}"]
        if row[f"w{i}"] and (low is None or high - low < 64 * MAX_WORDS):
            out[c] = (int(low or 0), int(high or 0))
    return out


def nunique_bits(v: Column, span: tuple[int, int]) -> Column:
    """Distinct non-missing values of ``v``, whole numbers in ``span``; another value raises."""
    low, high = span
    at = (v - F.lit(low)).cast("long")
    outside = v.isNotNull() & ~(v.between(low, high) & (v == F.floor(v)))
    words = []
    for first in range(0, high - low + 1, 64):
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (at - F.lit(first)).cast("int"))
        word = F.when(at.between(first, first + 63), bit)
        if first == 0:
            word = F.when(outside, F.raise_error(F.lit(f"a value lies outside {span}")).cast("long")).otherwise(word)
        words.append(F.coalesce(F.bit_count(F.bit_or(word)), F.lit(0)).cast("long"))
    return reduce(lambda a, b: a + b, words)


def agg_expr(col: str, fn: str, dtype, cond: Column | None = None, span: tuple[int, int] | None = None) -> Column:
    """One aggregate of ``col`` with reference semantics (unaliased)."""
    c = qcol(col)
    v = c if cond is None else F.when(cond, c)
    has = None if cond is None else F.count_if(cond) > 0
    if fn == "min":
        return F.min(v)
    if fn == "max":
        return F.max(v)
    if fn == "mean":
        return clean_nan(F.avg(v))
    if fn == "var":
        return clean_nan(F.var_samp(v))
    if fn == "sum":
        s = F.sum(v)
        out = F.when(s.isNull(), F.lit(0)).otherwise(clean(s, dtype))
        return out if has is None else F.when(has, out)
    if fn == "size":
        return F.count(F.lit(1)) if cond is None else F.when(has, F.count_if(cond))
    if fn == "nunique":
        d = F.count_distinct(v) if span is None else nunique_bits(v, span)
        return d if has is None else F.when(has, d)
    raise ValueError(f"unsupported aggregate {fn!r}; use one of {SUPPORTED}")


def compile_spec(schema, spec: Mapping[str, Sequence[str]], prefix: str = "",
                 cond: Column | None = None, spans: Mapping[str, tuple[int, int]] | None = None) -> list[Column]:
    """Spec dict -> list of aliased aggregate columns, in spec order. ``spans``: the spans
    of the columns whose distinct values are counted by bits."""
    types = {f.name: f.dataType for f in schema.fields}
    out = []
    for col, fns in spec.items():
        if col not in types:
            raise KeyError(f"aggregation spec names missing column {col!r}")
        for fn in fns:
            out.append(agg_expr(col, fn, types[col], cond, (spans or {}).get(col)).alias(agg_name(prefix, col, fn)))
    return out


def share_exprs(col: str, values: Iterable[str], prefix: str = "",
                nan_as_category: bool = True, suffix: str = "_MEAN") -> list[Column]:
    """Category shares: the mean of each one-hot flag per group.

    The denominator is every row of the group, missing category included.
    Named like the reference's one-hot column plus ``_MEAN``.
    """
    return [flag_agg(cond, "mean").alias(f"{prefix}{col}_{name}{suffix}")
            for name, cond in flag_conditions(col, values, nan_as_category)]


def flag_conditions(col: str, values: Iterable[str], nan_as_category: bool) -> list[tuple[str, Column]]:
    """(name, condition) of a categorical column's 0/1 flags."""
    c = qcol(col)
    return [(v, c.eqNullSafe(F.lit(v))) for v in values] + ([("nan", c.isNull())] if nan_as_category else [])


def flag_agg(cond: Column, fn: str) -> Column:
    """An aggregate of a 0/1 flag, from the number of rows where it is set and the number
    of rows: one counter per flag, shared by all functions, and one for the group."""
    s, n = F.count_if(cond), F.count(F.lit(1))
    if fn == "min":
        return (s == n).cast("int")
    if fn == "max":
        return (s > 0).cast("int")
    if fn == "sum":
        return s
    if fn == "mean":
        return s / n
    if fn == "var":
        return F.when(n > 1, s * (1 - s / n) / (n - 1))
    raise ValueError(f"unsupported flag aggregate {fn!r}")


def all_columns_spec(df: DataFrame, key: str, fns: Sequence[str],
                     exclude: Iterable[str] = ()) -> dict[str, list[str]]:
    """Apply one function list to every numeric non-key column (A2)."""
    skip = set(exclude) | {key}
    return {f.name: list(fns) for f in df.schema.fields
            if f.name not in skip and isinstance(f.dataType, (NumericType, BooleanType))}


def aggregate(df: DataFrame, key: str | Sequence[str], exprs: Sequence[Column],
              max_exprs: int | None = DEFAULT_MAX_EXPRS, deal: bool = False) -> DataFrame:
    """``groupBy(key).agg(*exprs)`` with null keys dropped (pandas group-by).

    ``deal`` shuffles the rows by the key and not their partial aggregates: less, where a
    group's few rows lie in many tasks and each has fewer columns than the aggregates'
    buffers. The aggregate then needs no exchange.

    With ``max_exprs`` set and more outputs than that, the list is cut
    into chunks aggregated separately and joined back on the key: each
    chunk keeps whole-stage code generation. Every chunk sees the same
    groups, so the joins are one-to-one.
    """
    keys = [key] if isinstance(key, str) else list(key)
    src = df.where(reduce(lambda a, b: a & b, [qcol(k).isNotNull() for k in keys]))
    if deal:
        src = src.repartition(*[qcol(k) for k in keys])
    grouped = src.groupBy(*[qcol(k) for k in keys])
    if not max_exprs or len(exprs) <= max_exprs:
        return grouped.agg(*exprs)
    chunks = [exprs[i:i + max_exprs] for i in range(0, len(exprs), max_exprs)]
    parts = [src.groupBy(*[qcol(k) for k in keys]).agg(*ch) for ch in chunks]
    return reduce(lambda a, b: a.join(b, keys, "inner"), parts)


def aggregate_spec(df: DataFrame, key: str, spec: Mapping[str, Sequence[str]],
                   prefix: str = "", shares: Mapping[str, Sequence[str]] | None = None,
                   nan_as_category: bool = True,
                   subsets: Sequence[tuple[str, Column]] = (),
                   max_exprs: int | None = DEFAULT_MAX_EXPRS, deal: bool = False) -> DataFrame:
    """Spec aggregate + category shares + fused subset aggregates.

    ``subsets`` is a list of ``(prefix, condition)``; for each, the same
    numeric ``spec`` is computed on the matching rows only (the
    reference's filter / group-by / left-join, in one pass).
    """
    exprs = compile_spec(df.schema, spec, prefix)
    for col, values in (shares or {}).items():
        exprs += share_exprs(col, values, prefix, nan_as_category)
    for sub_prefix, cond in subsets:
        exprs += compile_spec(df.schema, spec, sub_prefix, cond)
    return aggregate(df, key, exprs, max_exprs, deal)
