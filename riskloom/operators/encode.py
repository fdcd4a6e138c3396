"""Categorical encoding: domain discovery, one-hot flags, factorize codes.

The one-hot output schema depends on the data (one column per value),
so the category list must be known before the plan is built. One Spark
job collects the domains of all categorical columns at once; the caller
states how many output columns a variable may have (``max_values``) and
a wider one raises, or passes ``categories=`` and no job runs.

Factorize has no such limit: its codes are a table (value, code), written
once and joined back, so any number of values works and none of them
passes through the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from riskloom.functions.exprs import qcol
from riskloom.session import checkpoint_dir
from riskloom.sources.store import stored

def string_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Columns the reference treats as categorical (pandas ``object``)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, StringType) and f.name not in set(exclude)]


def _order_col(order_by) -> Column:
    if order_by is None:
        return F.lit(0)
    return order_by if isinstance(order_by, Column) else qcol(order_by)


def discover_domains(df: DataFrame, cols: Sequence[str], max_values: int,
                     order_by: str | Column | None = None) -> dict[str, list[str]]:
    """Distinct non-null values per column, in one job.

    Values are sorted (pandas ``get_dummies`` order), or, with
    ``order_by``, in order of first appearance by that column (pandas
    ``factorize`` order; Spark rows have no order of their own).
    Raises if a column has more than ``max_values`` values.
    """
    cols = list(cols)
    if not cols:
        return {}
    order = _order_col(order_by)
    pairs = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("k"), qcol(c).cast("string").alias("v"), order.alias("o"))
        for c in cols])))
    dom = (pairs.where(F.col("v").isNotNull())
           .groupBy("k", "v").agg(F.min("o").alias("o")))
    cap = max_values * len(cols)
    rows = dom.limit(cap + 1).collect()
    out: dict[str, list] = {c: [] for c in cols}
    for r in rows:
        out[r["k"]].append((r["o"], r["v"]))
    too_big = [c for c, vs in out.items() if len(vs) > max_values]
    if too_big or len(rows) > cap:
        raise ValueError(f"columns {too_big or cols} have more than {max_values} distinct "
                         "values; pass categories= or exclude them")
    return {c: [v for _, v in sorted(vs)] for c, vs in out.items()}


def one_hot_exprs(col: str, values: Sequence[str], nan_as_category: bool) -> list[Column]:
    c = qcol(col)
    out = [c.eqNullSafe(F.lit(v)).cast("int").alias(f"{col}_{v}") for v in values]
    if nan_as_category:
        out.append(c.isNull().cast("int").alias(f"{col}_nan"))
    return out


def one_hot(df: DataFrame, cols: Sequence[str] | None = None, nan_as_category: bool = True,
            categories: Mapping[str, Sequence[str]] | None = None,
            max_values: int | None = None) -> tuple[DataFrame, list[str]]:
    """Replace each categorical column with 0/1 flags ``col_value``.

    Values sorted; with ``nan_as_category`` an extra ``col_nan`` flag is
    emitted even if no row is missing; without it a missing value gives
    all zeros. Returns ``(df, new_columns)``. Other columns keep their
    order; flags go at the end, as in ``pandas.get_dummies``.
    """
    cols = string_columns(df) if cols is None else list(cols)
    doms = dict(categories or {})
    missing = [c for c in cols if c not in doms]
    if missing:
        if max_values is None:
            raise ValueError(f"pass categories= or max_values= for {missing}")
        doms.update(discover_domains(df, missing, max_values))
    flags, new = [], []
    for c in cols:
        vals = sorted(doms[c])
        exprs = one_hot_exprs(c, vals, nan_as_category)
        flags += exprs
        new += [f"{c}_{v}" for v in vals] + ([f"{c}_nan"] if nan_as_category else [])
    keep = [qcol(c) for c in df.columns if c not in set(cols)]
    return df.select(*keep, *flags), new


def factorize_expr(col: str, values: Sequence[str]) -> Column:
    """Integer code by position in ``values``; missing or unknown -> -1."""
    if not values:
        return F.lit(-1).cast("bigint")
    m = F.create_map(*[x for i, v in enumerate(values) for x in (F.lit(v), F.lit(i))])
    return F.coalesce(F.try_element_at(m, qcol(col).cast("string")), F.lit(-1)).cast("bigint")


#: this many values, of all columns together, are coded by a literal map
MAX_LITERAL_CODES = 100


def _first_seen(df: DataFrame, cols: Sequence[str], order_by: str | Column | None) -> DataFrame:
    """(k, v, o): the distinct non-missing values of each column and where they appear first."""
    pairs = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("k"), qcol(c).cast("string").alias("v"), _order_col(order_by).alias("o"))
        for c in cols])))
    return pairs.where(F.col("v").isNotNull()).groupBy("k", "v").agg(F.min("o").alias("o"))


def few_values(df: DataFrame, cols: Sequence[str], order_by: str | Column | None = None) -> dict[str, list[str]] | None:
    """Each column's values in order of their codes, by one job; None if there are more than
    MAX_LITERAL_CODES in all."""
    rows = _first_seen(df, cols, order_by).orderBy("k", "o", "v").limit(MAX_LITERAL_CODES + 1).collect()
    if len(rows) > MAX_LITERAL_CODES:
        return None
    return {c: [r["v"] for r in rows if r["k"] == c] for c in cols}


def code_tables(df: DataFrame, cols: Sequence[str], order_by: str | Column | None = None) -> DataFrame:
    """(k, v, code): the distinct non-missing values of each column, numbered from 0 by
    first appearance (``order_by``) and value.

    Values are dealt into ranges of that order; each range is numbered on its own and
    shifted by the size of the ranges before it, so no task sees all values.
    """
    checkpoint_dir(df.sparkSession)
    ranged = (_first_seen(df, cols, order_by).repartitionByRange("k", "o", "v").withColumn("r", F.spark_partition_id())
              .checkpoint(eager=True))
    before = Window.partitionBy("k").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    shift = (ranged.groupBy("k", "r").agg(F.count(F.lit(1)).alias("n"))
             .select("k", "r", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift")))
    inside = Window.partitionBy("k", "r").orderBy("o", "v")
    return (ranged.join(shift, ["k", "r"])
            .select("k", "v", (F.col("shift") + F.row_number().over(inside) - 1).cast("bigint").alias("code")))


def factorize(df: DataFrame, cols: Sequence[str], order_by: str | Column | None = None,
              categories: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Replace each column with its integer code (pandas ``factorize``).

    Codes follow first appearance by ``order_by`` (the reference's row order), or
    sorted value order when it is None. Missing -> -1. Columns in ``categories``, and
    others if they have few values in all, are coded by a literal map; else by a table
    written to the shared folder, whose known size lets the planner broadcast it or not.
    """
    doms = dict(categories or {})
    unknown = [c for c in cols if c not in doms]
    if unknown:
        doms.update(few_values(df, unknown, order_by) or {})
    known = [c for c in cols if c in doms]
    rest = [c for c in cols if c not in doms]
    out = df.withColumns({c: factorize_expr(c, doms[c]) for c in known}) if known else df
    if not rest:
        return out
    codes = stored(code_tables(df, rest, order_by))
    for i, c in enumerate(rest):
        mine = codes.where(F.col("k") == c).select(F.col("v").alias(f"_rl_v{i}"), F.col("code").alias(f"_rl_c{i}"))
        out = out.join(mine, qcol(c).cast("string") == F.col(f"_rl_v{i}"), "left")
    coded = {c: F.coalesce(F.col(f"_rl_c{i}"), F.lit(-1)).cast("bigint") for i, c in enumerate(rest)}
    return out.withColumns(coded).select(*[qcol(c) for c in df.columns])


def discover_domains_many(parts, max_values: int) -> dict[str, dict[str, list[str]]]:
    """Domains of several tables in one Spark job.

    ``parts`` is a list of ``(name, df, cols)``. Returns ``{name: {col: values}}``
    with sorted values. The tables' (column, value) pairs are
    de-duplicated by partial aggregation before one shuffle, so a plan
    that needs the categories of five tables scans each of them once
    instead of running five jobs.
    """
    frames = []
    for i, (name, df, cols) in enumerate(parts):
        if not cols:
            continue
        frames.append(df.select(F.inline(F.array(*[
            F.struct(F.lit(f"{i}\x1f{c}").alias("k"), qcol(c).cast("string").alias("v")) for c in cols]))))
    out: dict[str, dict[str, list]] = {name: {c: [] for c in cols} for name, _, cols in parts}
    if not frames:
        return out
    pairs = frames[0]
    for f in frames[1:]:
        pairs = pairs.unionByName(f)
    dom = pairs.where(F.col("v").isNotNull()).distinct()
    cap = max_values * sum(len(p[2]) for p in parts)
    rows = dom.limit(cap + 1).collect()
    names = [p[0] for p in parts]
    for r in rows:
        idx, col = r["k"].split("\x1f", 1)
        out[names[int(idx)]][col].append(r["v"])
    for name, cols in out.items():
        for c, vs in cols.items():
            if len(vs) > max_values:
                raise ValueError(f"{name}.{c} has more than {max_values} distinct values")
            cols[c] = sorted(vs)
    return out
