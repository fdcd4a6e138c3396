"""Model-matrix preparation: inf replacement, mean imputation, min-max
scaling. Fitting is one wide aggregate (one job, one row of statistics
per column); transforming is a projection with the statistics as
literals, so it runs inside whole-stage code generation.

Semantics follow the reference's scikit-learn steps: the mean ignores
missing values; an all-missing column is dropped (and reported); after
imputation the min/max are those of the observed values (the mean lies
between them); a constant column scales to 0.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.exprs import INF, NEG_INF, double_sql, is_floating, quoted

DEFAULT_EXCLUDE = ("TARGET", "SK_ID_CURR", "SK_ID_BUREAU", "SK_ID_PREV", "index")


@dataclass
class PrepModel:
    """Fitted imputer + scaler: per-feature mean, min and max."""
    features: list[str]
    mean: dict[str, float]
    lo: dict[str, float]
    hi: dict[str, float]
    dropped: list[str] = field(default_factory=list)

    def _imputed(self, c: str) -> str:
        return f"coalesce(CAST({quoted(c)} AS DOUBLE), {double_sql(self.mean[c])})"

    def impute_exprs(self) -> list[str]:
        return [f"{self._imputed(c)} AS {quoted(c)}" for c in self.features]

    def scale_exprs(self, impute: bool = True) -> list[str]:
        out = []
        for c in self.features:
            x = self._imputed(c) if impute else quoted(c)
            rng = self.hi[c] - self.lo[c]
            scaled = f"({x} - {double_sql(self.lo[c])}) / {double_sql(rng)}" if rng != 0 else f"{x} * 0.0D"
            out.append(f"{scaled} AS {quoted(c)}")
        return out

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, c, self.mean[c], self.lo[c], self.hi[c]) for i, c in enumerate(self.features)]
        return spark.createDataFrame(rows, "position int, feature string, mean double, min double, max double")

    @classmethod
    def from_frame(cls, df: DataFrame) -> "PrepModel":
        rows = sorted(df.collect(), key=lambda r: r["position"])
        return cls([r["feature"] for r in rows], {r["feature"]: r["mean"] for r in rows},
                   {r["feature"]: r["min"] for r in rows}, {r["feature"]: r["max"] for r in rows})


def prepare_data(df: DataFrame, label: str = "TARGET", exclude: Sequence[str] = DEFAULT_EXCLUDE,
                 big: float = 1.0e9) -> tuple[DataFrame, list[str]]:
    """Replace +-inf by +-``big`` in every floating column and split the
    feature list from the label/ids (``prepare_data``, X3 + P2 + P13).
    Returns the same DataFrame (ids and label kept) and the feature names."""
    ex = set(exclude) | {label}
    feats = [f.name for f in df.schema.fields if f.name not in ex]
    kept = set(feats)

    def bounded(f):
        c = quoted(f.name)
        if f.name not in kept or not is_floating(f.dataType):
            return c
        return (f"CASE WHEN {c} = {double_sql(INF)} THEN {double_sql(big)} "
                f"WHEN {c} = {double_sql(NEG_INF)} THEN {double_sql(-big)} ELSE {c} END AS {c}")

    return df.selectExpr(*[bounded(f) for f in df.schema.fields]), feats


def fit_prep(df: DataFrame, features: Sequence[str]) -> PrepModel:
    """Fit mean imputer and min-max scaler in one aggregate."""
    stats = [("avg", "a"), ("min", "l"), ("max", "h")]
    exprs = [f"{fn}(CAST({quoted(c)} AS DOUBLE)) AS {short}{i}" for i, c in enumerate(features) for fn, short in stats]
    row = df.selectExpr(*exprs).collect()[0] if exprs else None
    keep, dropped, mean, lo, hi = [], [], {}, {}, {}
    for i, c in enumerate(features):
        if row[f"a{i}"] is None:
            dropped.append(c)
            continue
        keep.append(c)
        mean[c], lo[c], hi[c] = float(row[f"a{i}"]), float(row[f"l{i}"]), float(row[f"h{i}"])
    return PrepModel(keep, mean, lo, hi, dropped)


def fit_preps(df: DataFrame, features: Sequence[str], fold: str, folds: Sequence[int]) -> tuple[dict[int, PrepModel], dict[int, int]]:
    """``fit_prep`` of the rows outside each fold, and the number of these rows: one grouped
    aggregate for all folds, whose sums, counts and extremes are put together here."""
    stats = [("sum", "s"), ("count", "n"), ("min", "l"), ("max", "h")]
    exprs = [f"{fn}(CAST({quoted(c)} AS DOUBLE)) AS {short}{i}" for i, c in enumerate(features) for fn, short in stats]
    found = df.groupBy(quoted(fold)).agg(F.count(F.lit(1)).alias("rows"), *[F.expr(e) for e in exprs]).collect()
    order = lambda v: (math.isnan(v), v)  # noqa: E731  NaN is the largest, as in Spark
    preps, rows = {}, {}
    for f in folds:
        others = sorted((r for r in found if r[fold] != f), key=lambda r: r[fold])
        rows[f] = sum(r["rows"] for r in others)
        m = preps[f] = PrepModel([], {}, {}, {})
        for i, c in enumerate(features):
            held = [r for r in others if r[f"n{i}"]]
            if not held:
                m.dropped.append(c)
                continue
            m.features.append(c)
            m.mean[c] = sum(r[f"s{i}"] for r in held) / sum(r[f"n{i}"] for r in held)
            m.lo[c] = min((r[f"l{i}"] for r in held), key=order)
            m.hi[c] = max((r[f"h{i}"] for r in held), key=order)
    return preps, rows


def mean_impute(df: DataFrame, model: PrepModel, keep: Sequence[str] = ()) -> DataFrame:
    return df.selectExpr(*[quoted(c) for c in keep], *model.impute_exprs())


def min_max_scale(df: DataFrame, model: PrepModel, keep: Sequence[str] = (),
                  impute: bool = True) -> DataFrame:
    return df.selectExpr(*[quoted(c) for c in keep], *model.scale_exprs(impute))
