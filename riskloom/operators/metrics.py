"""Evaluation tables: confusion matrix, accuracy, exact ROC AUC,
model comparison and feature ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.exprs import qcol
from riskloom.session import checkpoint_dir


def _by(by):
    return [] if by is None else ([by] if isinstance(by, str) else list(by))


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction",
                     by=None) -> DataFrame:
    """(label, prediction, n) for the four cells of a binary problem,
    zero cells included: one aggregate of four counts, stacked to rows."""
    l, p = qcol(label).cast("int"), qcol(prediction).cast("int")
    cells = [(a, b) for a in (0, 1) for b in (0, 1)]
    wide = df.groupBy(*_by(by)).agg(*[F.count_if((l == a) & (p == b)).alias(f"c{a}{b}")
                                      for a, b in cells])
    args = ", ".join(f"{a}, {b}, c{a}{b}" for a, b in cells)
    return wide.selectExpr(*_by(by), f"stack(4, {args}) AS (label, prediction, n)")


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction",
             by=None) -> DataFrame:
    """Share of rows whose prediction equals the label."""
    hit = (qcol(label).cast("double") == qcol(prediction).cast("double")).cast("double")
    return df.groupBy(*_by(by)).agg(F.avg(hit).alias("accuracy"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", by=None) -> DataFrame:
    """Exact ROC AUC (ties count one half), distributed.

    AUC = sum over distinct scores s of pos(s) * (neg(< s) + neg(s) / 2),
    divided by P * N. ``neg(< s)`` needs a running total in score order;
    instead of one global window:

    1. collapse to one row per (group, score) (partial aggregate),
    2. deal these rows into ranges of (group, score), as many as there are
       shuffle partitions, and write them once to the shared folder,
    3. running negatives over the ranges of a group, joined back on the
       range, plus a running sum within each range.

    Rows with a missing score or label are left out; infinite scores are
    scores like any other, and a NULL group is a group. Returns one row
    (per ``by`` group) with column ``auc``; NULL when a group has only
    one class.
    """
    keys = _by(by)
    y = qcol(label).cast("int")
    src = df.where(qcol(score).isNotNull() & ~F.isnan(qcol(score).cast("double")) & qcol(label).isNotNull())
    # one struct of the group's columns: equal to itself also where a field is NULL
    group = F.struct(*[qcol(k).alias(k) for k in keys], F.lit(0).alias("_all"))
    d = (src.groupBy(group.alias("_g"), qcol(score).cast("double").alias("_s"))
         .agg(F.count_if(y == 1).alias("_pos"), F.count_if(y == 0).alias("_neg")))
    return _ranked_auc(d, keys)


def auc_of_counts(counts: DataFrame, by, score: str = "score", pos: str = "pos", neg: str = "neg") -> DataFrame:
    """``roc_auc`` of rows that are already counted: one row per (group, score) with its
    numbers of positives and negatives."""
    keys = _by(by)
    group = F.struct(*[qcol(k).alias(k) for k in keys], F.lit(0).alias("_all"))
    return _ranked_auc(counts.select(group.alias("_g"), qcol(score).cast("double").alias("_s"),
                                     qcol(pos).alias("_pos"), qcol(neg).alias("_neg")), keys)


def _ranked_auc(d: DataFrame, keys: list[str]) -> DataFrame:
    """Steps 2 and 3 of ``roc_auc`` on (_g, _s, _pos, _neg)."""
    checkpoint_dir(d.sparkSession)
    d = d.repartitionByRange("_g", "_s").withColumn("_b", F.spark_partition_id()).checkpoint(eager=True)
    totals = d.groupBy("_g", "_b").agg(F.sum("_neg").alias("_bn"))
    wb = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_g", "_b", F.coalesce(F.sum("_bn").over(wb), F.lit(0)).alias("_off"))
    wi = Window.partitionBy("_g", "_b").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    # joined on (group, range) like the window below partitions, so the
    # join adds no exchange; AQE broadcasts the offsets when small
    below = (d.join(offsets, ["_g", "_b"])
             .withColumn("_below", F.col("_off") + F.coalesce(F.sum("_neg").over(wi), F.lit(0))))
    num = F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2.0))
    npos, nneg = F.sum("_pos"), F.sum("_neg")
    auc = F.when((npos > 0) & (nneg > 0), num / (npos.cast("double") * nneg)).alias("auc")
    if not keys:
        return below.agg(auc)
    return below.groupBy("_g").agg(auc).select(*[F.col(f"_g.`{k}`").alias(k) for k in keys], "auc")


def model_compare(metrics: DataFrame, variants: Sequence[str] | None = None) -> DataFrame:
    """(metric, variant, value) rows -> one row per metric, one column per variant (M7)."""
    g = metrics.groupBy("metric")
    g = g.pivot("variant", list(variants)) if variants is not None else g.pivot("variant")
    return g.agg(F.first("value"))


def top_features(importances: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """Mean importance per feature, the top ``k``, and their per-fold rows (M6).

    Returns ``(top, rows)``; ties in mean importance are broken by name.
    The top list has ``k`` rows, so the semi join broadcasts a bounded side.
    """
    mean = importances.groupBy("feature").agg(F.avg("importance").alias("mean_importance"))
    top = mean.orderBy(F.desc("mean_importance"), F.asc("feature")).limit(k)
    rows = (importances.join(F.broadcast(top.select("feature")), "feature", "left_semi")
            .orderBy(F.desc("importance"), "feature", "fold"))   # sorted for output (k * folds rows)
    return top, rows
