"""The reference's whole workflow on a folder of credit tables.

``features(spark, data_dir)`` is the reference's ``main()``: the eight
tables -> one wide row per applicant (C1-C7). ``run(...)`` continues
with the client extract, audit, model matrix, the three cross-validated
experiments, the comparison table, feature ranking and persistence
(C8-C14). Tables are read as CSV (header, inferred or given schema,
pandas' null tokens) or parquet, as the ``fmt`` argument says.

Usage::

    from riskloom import get_spark
    from riskloom.plans import workflow
    spark = get_spark()
    ft = workflow.features(spark, "data/")
    out = workflow.run(spark, "data/", out_dir="runs/", params=GBTParams(max_iter=200))
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import metrics as M
from riskloom.operators.assemble import union_by_name
from riskloom.operators.encode import discover_domains_many, string_columns
from riskloom.operators import profile as P
from riskloom.operators.model import GBTParams
from riskloom.plans import credit as C
from riskloom.plans import evaluate as EV
from riskloom.sources import csv as CSV

# File names of the reference's tables (fixed values).
TABLES = {
    "application_train": "application_train",
    "application_test": "application_test",
    "bureau": "bureau",
    "bureau_balance": "bureau_balance",
    "previous_application": "previous_application",
    "pos_cash": "POS_CASH_balance",
    "installments": "installments_payments",
    "credit_card": "credit_card_balance",
}
# Client columns of the extract (fixed values).
CLIENT_COLUMNS = ["SK_ID_CURR", "DAYS_BIRTH", "CODE_GENDER", "CNT_CHILDREN", "CNT_FAM_MEMBERS",
                  "FLAG_OWN_CAR", "FLAG_OWN_REALTY", "REGION_POPULATION_RELATIVE", "NAME_CONTRACT_TYPE",
                  "AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE"]


def read_table(spark: SparkSession, data_dir: str, name: str, schemas: dict | None = None,
               num_rows: int | None = None, fmt: str = "csv", order: str | None = None) -> DataFrame:
    """One of TABLES from ``data_dir``, any folder that Spark reads; ``fmt``: 'csv' or
    'parquet'. ``num_rows`` keeps the first rows; ``order`` adds the rows' places."""
    path = f"{data_dir.rstrip('/')}/{TABLES[name]}.{fmt}"
    if fmt != "parquet":
        return CSV.read_csv(spark, path, (schemas or {}).get(name), num_rows=num_rows, order=order)
    df = spark.read.parquet(path)
    if num_rows is None and order is None:
        return df
    df = df.withColumn(CSV.INPUT_ORDER, CSV.input_order(parquet=True))
    df = df if num_rows is None else df.orderBy(CSV.INPUT_ORDER).limit(num_rows)
    return df.withColumnRenamed(CSV.INPUT_ORDER, order) if order else df.drop(CSV.INPUT_ORDER)


def features(spark: SparkSession, data_dir: str, debug: bool = False,
             schemas: dict | None = None, fmt: str = "csv") -> DataFrame:
    """The reference's ``main(debug)``: C1, then C2-C6 left-joined, names cleaned. The
    categories of all tables come from one job; debug reads 10000 rows of each."""
    n = 10000 if debug else None
    # the applicants' codes follow the order of their files
    t = {name: read_table(spark, data_dir, name, schemas, n, fmt,
                          CSV.INPUT_ORDER if name.startswith("application") else None) for name in TABLES}
    both = union_by_name([t["application_train"], t["application_test"]]).drop(CSV.INPUT_ORDER)
    cats = {name: string_columns(df) for name, df in t.items() if not name.startswith("application")}
    cats["application"] = string_columns(both, exclude=C.APP_FACTORIZE)
    frames = {**t, "application": both}
    doms = discover_domains_many([(name, frames[name], cols) for name, cols in cats.items()], C.MAX_ONE_HOT)
    app = C.application_features(t["application_train"], t["application_test"], order_by=CSV.INPUT_ORDER,
                                 categories=doms["application"])
    parts = [
        C.bureau_and_balance(t["bureau"], t["bureau_balance"],
                             categories={**doms["bureau"], **doms["bureau_balance"]}),
        C.previous_applications(t["previous_application"], categories=doms["previous_application"]),
        C.pos_cash(t["pos_cash"], categories=doms["pos_cash"]),
        C.installments_payments(t["installments"], categories=doms["installments"]),
        C.credit_card_balance(t["credit_card"], categories=doms["credit_card"]),
    ]
    return C.feature_table(app, parts)


def run(spark: SparkSession, data_dir: str, out_dir: str, params: GBTParams | None = None,
        variants=EV.VARIANTS, sample_fraction: float | None = 0.1, k: int = 5,
        persist_variant: str = "smote", rank_variant: str = "smote", best: str = "auc",
        schemas: dict | None = None, fmt: str = "csv", **cv_kw) -> dict:
    """Feature table (written once to ``out_dir``, cutting the
    lineage; the audit's facts are gathered by this write), client extract, audit, model matrix, one experiment per
    variant, comparison, top features of ``rank_variant`` and the persisted run of
    ``persist_variant`` (``best``: see ``evaluate.persist_run``)."""
    run_id = uuid.uuid4().hex
    ft_path = os.path.join(out_dir, "features")
    table, seen = P.observed(features(spark, data_dir, schemas=schemas, fmt=fmt))
    table.write.mode("overwrite").parquet(ft_path)
    ft = spark.read.parquet(ft_path)

    train = read_table(spark, data_dir, "application_train", schemas, fmt=fmt)
    test = read_table(spark, data_dir, "application_test", schemas, fmt=fmt)
    cols = [c for c in CLIENT_COLUMNS if c in train.columns]
    extract = C.client_extract(train, test, ft, cols)
    CSV.write_csv(extract, os.path.join(out_dir, "info_clients"))

    # the audit was gathered by the write; the labelled rows are read back
    profile, nulls, infs, _ = seen.frames(spark)
    labelled = ft.where(F.col("TARGET").isNotNull())
    matrix, feats = EV.model_matrix(labelled, fraction=sample_fraction)
    results, metrics = {}, {}
    for v in variants:
        res, m = EV.experiment(matrix, "SK_ID_CURR", feats, v, params=params, k=k, **cv_kw)
        results[v], metrics[v] = res, m
    table = EV.compare(metrics)
    top, top_rows = M.top_features(results[rank_variant if rank_variant in results else variants[0]].importances, 10)
    if persist_variant in results:
        EV.persist_run(spark, results[persist_variant], metrics[persist_variant],
                       os.path.join(out_dir, "run"), run_id, best=best,
                       refit=lambda: EV.fit_all(matrix, feats, params=params))
    return {"features": ft, "profile": profile, "null_cells": nulls, "inf_cells": infs,
            "results": results, "metrics": metrics, "comparison": table, "top_features": top,
            "top_feature_rows": top_rows, "extract": extract, "run_id": run_id}
