"""Composite evaluation pipelines (C9-C14): audit, model matrix,
cross-validated experiments, comparison, ranking and persistence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators import metrics as M
from riskloom.operators import prep as PR
from riskloom.operators import profile as P
from riskloom.operators.assemble import union_by_name
from riskloom.operators.model import CVResult, GBTParams, cv_train
from riskloom.operators.sampling import hash_sample
from riskloom.sources import store

VARIANTS = ("plain", "smote", "weighted")


def audit(df: DataFrame, label: str = "TARGET"):
    """Column profile, missing and infinite cell counts, and the
    labelled / unlabelled split."""
    return (P.column_profile(df), P.null_count(df), P.inf_count(df),
            df.where(F.col(label).isNotNull()), df.where(F.col(label).isNull()))


def model_matrix(train: DataFrame, key: str = "SK_ID_CURR", label: str = "TARGET",
                 fraction: float | None = 0.1, seed: int = 0, exclude=PR.DEFAULT_EXCLUDE):
    """Optional fraction sample (hash of the key), inf -> +-1e9 and the
    feature list. Imputation and scaling are fitted inside ``cv_train``."""
    df = hash_sample(train, key, fraction, seed) if fraction else train
    return PR.prepare_data(df, label=label, exclude=list(exclude) + [key])


def evaluate(result: CVResult, key: str, label: str = "TARGET") -> dict[str, DataFrame]:
    """Out-of-fold AUC (total and per fold), accuracy and confusion matrix."""
    p = result.predictions
    return {
        "auc": M.roc_auc(p, label, "score"),
        "auc_by_fold": M.roc_auc(p, label, "score", by="fold"),
        "accuracy": M.accuracy(p, label, "prediction"),
        "confusion": M.confusion_matrix(p, label, "prediction"),
    }


def experiment(df: DataFrame, key: str, features, variant: str, label: str = "TARGET",
               params: GBTParams | None = None, **kw) -> tuple[CVResult, dict]:
    """One cross-validated variant and its metrics."""
    res = cv_train(df, key, features, label, variant=variant, params=params, **kw)
    res.predictions = res.predictions.checkpoint(eager=True)
    return res, evaluate(res, key, label)


def compare(metric_rows: dict[str, dict]) -> DataFrame:
    """C14 / M7: AUC and accuracy per variant in one table, each variant
    with its own metrics (the reference shows one variant's AUC twice)."""
    rows = []
    for variant, m in metric_rows.items():
        rows.append(m["auc"].select(F.lit("AUC").alias("metric"), F.lit(variant).alias("variant"),
                                    F.col("auc").alias("value")))
        rows.append(m["accuracy"].select(F.lit("accuracy").alias("metric"), F.lit(variant).alias("variant"),
                                         F.col("accuracy").alias("value")))
    return M.model_compare(union_by_name(rows), list(metric_rows))


def best_fold(result: CVResult, label: str = "TARGET") -> int:
    """The fold with the largest out-of-fold AUC (the first of equals)."""
    per = M.roc_auc(result.predictions, label, "score", by="fold").where(F.col("auc").isNotNull())
    return per.orderBy(F.desc("auc"), "fold").first()["fold"]


def persist_run(spark, result: CVResult, metrics: dict, run_dir: str, run_id: str,
                best: str = "auc", label: str = "TARGET", refit=None) -> None:
    """S4 + S5: save a model with its preprocessing, append the metrics.

    ``best``: 'auc' saves the fold with the best out-of-fold AUC, 'last' the last one (the
    reference's choice), 'refit' what ``refit()`` returns: (model, preprocessing) fitted
    on all rows (see ``fit_all``).
    """
    if best == "refit":
        model, prep = refit()
    else:
        i = {"auc": lambda: best_fold(result, label), "last": lambda: len(result.models) - 1}[best]()
        model, prep = result.models[i], result.preps[i]
    store.save_model(model, f"{run_dir}/model")
    if prep is not None:
        store.save_prep(spark, prep, f"{run_dir}/preprocessing")
    vals = {"AUC": metrics["auc"].first()["auc"], "Accuracy": metrics["accuracy"].first()["accuracy"]}
    store.log_metrics(spark, f"{run_dir}/metrics", run_id, vals)


def fit_all(df: DataFrame, features, label: str = "TARGET", params: GBTParams | None = None):
    """(model, preprocessing) of one plain fit on every row."""
    from pyspark.ml.feature import VectorAssembler
    prep = PR.fit_prep(df, features)
    rows = VectorAssembler(inputCols=prep.features, outputCol="features", handleInvalid="keep").transform(
        PR.min_max_scale(df, prep, keep=[label])).checkpoint(eager=True)
    return (params or GBTParams()).estimator(label_col=label, n_rows=rows.count()).fit(rows), prep
