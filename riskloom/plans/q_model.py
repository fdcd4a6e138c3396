"""Model training, scoring and persistence queries (rows-only checks:
tree learning is not SQL), plus the CSV and metric-store round trips
(SQL-checked)."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import replace

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from riskloom.functions.exprs import portable_hash_sql
from riskloom.operators import metrics as M
from riskloom.operators.assemble import union_by_name
from riskloom.operators.model import GBTParams, cv_train
from riskloom.operators.prep import fit_prep, min_max_scale
from riskloom.operators.stages import fit_pipeline
from riskloom.plans import driver as D
from riskloom.plans import oracle as O
from riskloom.plans.catalog import finalize, register
from riskloom.plans.evaluate import fit_all, model_matrix
from riskloom.plans.q_eval import _auc_sql, _scored, _scored_sql
from riskloom.plans.q_features import feature_table
from riskloom.sources import csv as CSV
from riskloom.sources import store

# Bounded runs: the model queries grow 20 trees (the check queries 3) of the default
# 10000, so that a round's check ends; a real run passes its own GBTParams. The least
# node weight is left out, since it is larger than a whole fold of the test tables.
QUERY_PARAMS = GBTParams(max_iter=20, min_child_weight=0.0)
CHECK_PARAMS = GBTParams(max_iter=3, max_depth=3, min_child_weight=0.0, min_info_gain=0.0)
# Columns the driver label is computed from (excluded as features).
LEAK = ["c_acctbal", "ACCTBAL_PER_NATION"]


def _matrix(spark, sf):
    """The labelled rows of the feature table, which all model queries read as one stored table."""
    inputs = [f"{sf}/{t}.parquet" for t in ("customer", "orders", "lineitem", "events")]
    ft = store.stored_once(spark, "features", inputs, lambda: feature_table(spark, sf)).where(F.col("TARGET").isNotNull())
    df, feats = model_matrix(ft, fraction=None, exclude=["TARGET", "SK_ID_CURR"] + LEAK)
    return df, feats


def _cv(spark, sf, variant, params=QUERY_PARAMS, **kw):
    df, feats = _matrix(spark, sf)
    return cv_train(df, "SK_ID_CURR", feats, "TARGET", variant=variant, params=params, parallelism=5, **kw)


@register("gbt_cv")
def gbt_cv(spark, sf):
    """5-fold GBT on the full feature table, out-of-fold scores (C11)."""
    return _cv(spark, sf, "plain").predictions


@register("gbt_weighted")
def gbt_weighted(spark, sf):
    """Cost-weighted variant: defaults weigh 10, others 1."""
    return _cv(spark, sf, "weighted").predictions


@register("gbt_smote")
def gbt_smote(spark, sf):
    """SMOTE inside each training fold, drawn back to the fold size."""
    return _cv(spark, sf, "smote").predictions


@register("feature_importance")
def feature_importance(spark, sf):
    """Per-fold importances of the top 10 features by mean importance (M5, M6)."""
    res = _cv(spark, sf, "plain")
    _, rows = M.top_features(res.importances, 10)
    return rows


@register("gbt_evaluation")
def gbt_evaluation(spark, sf):
    """Out-of-fold AUC per fold and in total, for the plain variant (A21 on model scores)."""
    p = _cv(spark, sf, "plain").predictions.checkpoint(eager=True)
    per_fold = M.roc_auc(p, "TARGET", "score", by="fold")
    total = M.roc_auc(p, "TARGET", "score").select(F.lit(-1).alias("fold"), "auc")
    return per_fold.unionByName(total)


@register("gbt_history")
def gbt_history(spark, sf):
    """Per-iteration loss on the training and validation rows of each fold (M8)."""
    df, feats = _matrix(spark, sf)
    res = cv_train(df, "SK_ID_CURR", feats, "TARGET", params=QUERY_PARAMS, parallelism=5, history=True)
    return res.history


@register("model_roundtrip")
def model_roundtrip(spark, sf):
    """Fit, save to the shared folder, load, score: the loaded model's
    scores next to the fitted model's."""
    from pyspark.ml.functions import vector_to_array
    df, feats = _matrix(spark, sf)
    pm = fit_prep(df, feats)
    x = VectorAssembler(inputCols=pm.features, outputCol="features", handleInvalid="keep").transform(
        min_max_scale(df, pm, keep=["SK_ID_CURR", "TARGET"]))
    model = QUERY_PARAMS.estimator(label_col="TARGET", n_rows=x.count()).fit(x)
    path = store.scratch_path(spark, "model")
    store.save_model(model, path + "/model")
    store.save_prep(spark, pm, path + "/prep")
    loaded = store.load_gbt(path + "/model")
    pm2 = store.load_prep(spark, path + "/prep")
    assert pm2.features == pm.features
    a = model.transform(x).select("SK_ID_CURR", vector_to_array("probability")[1].alias("score"))
    b = loaded.transform(x).select("SK_ID_CURR", vector_to_array("probability")[1].alias("score_loaded"))
    return a.join(b, "SK_ID_CURR")


# -- facts about the models that SQL can state (bounded runs of 3 trees) -----------------

FOLD_SQL = f"""SELECT SK_ID_CURR, TARGET, CAST((row_number() OVER (ORDER BY
  {portable_hash_sql('SK_ID_CURR', seed=1001)}, SK_ID_CURR) - 1) % 5 AS INTEGER) AS fold FROM ({D.APP_TRAIN_SQL}) t"""


def _oof(res):
    """Out-of-fold rows: every labelled key once, in its fold, with a usable score."""
    return res.predictions.select(
        "SK_ID_CURR", "TARGET", "fold", F.col("score").between(0, 1).alias("in_range"),
        (F.col("prediction") == (F.col("score") > 0.5).cast("double")).alias("consistent"))


for _variant in ("plain", "weighted", "smote"):
    def _check(spark, sf, variant=_variant):
        return _oof(_cv(spark, sf, variant, CHECK_PARAMS))

    register(f"gbt_{_variant}_check", f"SELECT *, TRUE AS in_range, TRUE AS consistent FROM ({FOLD_SQL}) f")(_check)


@register("importance_check", """SELECT CAST(i AS INTEGER) AS fold, TRUE AS sums_to_one, TRUE AS none_negative,
  0 AS missing FROM generate_series(0, 4) g(i)""")
def importance_check(spark, sf):
    """Per fold: importances cover all features, are not negative and sum to one (M5)."""
    df, feats = _matrix(spark, sf)
    res = cv_train(df, "SK_ID_CURR", feats, "TARGET", params=CHECK_PARAMS, parallelism=5)
    total, n = F.sum("importance"), F.count_distinct("feature")
    return res.importances.groupBy("fold").agg(
        (F.abs(total - 1) < 1e-6).alias("sums_to_one"), (F.min("importance") >= 0).alias("none_negative"),
        (F.lit(len(feats)) - n).cast("int").alias("missing"))


@register("split_count_check", "SELECT CAST(i AS INTEGER) AS fold, TRUE AS equal, 0 AS missing FROM generate_series(0, 4) g(i)")
def split_count_check(spark, sf):
    """Per fold: the splits counted in the node table, a feature's number each, are those
    of the printed trees (M5, the reference's kind of importance)."""
    df, feats = _matrix(spark, sf)
    res = cv_train(df, "SK_ID_CURR", feats, "TARGET", params=CHECK_PARAMS, parallelism=5)
    printed = [(fold, pm.features[int(i)], n) for fold, (m, pm) in enumerate(zip(res.models, res.preps))
               for i, n in Counter(re.findall(r"If \(feature (\d+) ", m.toDebugString)).items()]
    other = spark.createDataFrame(printed, "fold int, feature string, n long")
    both = res.importances.join(other, ["fold", "feature"], "full")
    return both.groupBy("fold").agg(
        F.every(F.coalesce(F.col("splits") == F.coalesce("n", F.lit(0)), F.lit(False))).alias("equal"),
        (F.lit(len(feats)) - F.count("splits")).cast("int").alias("missing"))


@register("early_stop_check", "SELECT CAST(i AS INTEGER) AS fold, TRUE AS stopped, TRUE AS evaluated FROM generate_series(0, 4) g(i)")
def early_stop_check(spark, sf):
    """Per fold: boosting ends before its last tree once the validation rows gain too little,
    and every tree that was kept has its loss and AUC (M8)."""
    params = replace(CHECK_PARAMS, max_iter=12, validation_tol=0.5)
    res = _cv(spark, sf, "plain", params, history=True)
    trees = spark.createDataFrame([(f, m.getNumTrees) for f, m in enumerate(res.models)], "fold int, trees int")
    seen = res.history.where("split = 'valid' AND loss IS NOT NULL").groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    return trees.join(seen, "fold", "left").select("fold", (F.col("trees") < 12).alias("stopped"),
                                                   (F.col("trees") == F.col("n")).alias("evaluated"))


@register("best_iteration_check", "SELECT CAST(i AS INTEGER) AS fold, TRUE AS equal FROM generate_series(0, 4) g(i)")
def best_iteration_check(spark, sf):
    """Per fold: out-of-fold scores of the best iteration have that iteration's AUC, the
    highest of all (the reference scores with its best iteration)."""
    res = _cv(spark, sf, "plain", CHECK_PARAMS, history=True, best_iteration=True)
    best = res.history.where("split = 'valid'").groupBy("fold").agg(F.max("auc").alias("best"))
    return M.roc_auc(res.predictions, "TARGET", "score", by="fold").join(best, "fold").select(
        "fold", (F.abs(F.col("auc") - F.col("best")) < 1e-12).alias("equal"))


@register("history_check", """SELECT CAST(f AS INTEGER) AS fold, split, CAST(i AS INTEGER) AS iteration, TRUE AS finite
FROM generate_series(0, 4) a(f), (VALUES ('train'), ('valid')) s(split), generate_series(1, 3) b(i)""")
def history_check(spark, sf):
    """Loss and AUC of every iteration, split and fold (M8)."""
    h = _cv(spark, sf, "plain", CHECK_PARAMS, history=True).history
    return h.select("fold", "split", "iteration", ((F.abs("loss") < float("inf")) & F.col("auc").between(0, 1))
                    .alias("finite"))


@register("model_roundtrip_check", f"SELECT SK_ID_CURR, TRUE AS equal FROM ({D.APP_TRAIN_SQL}) t")
def model_roundtrip_check(spark, sf):
    """A saved and loaded model scores every row as the fitted one does."""
    return model_roundtrip(spark, sf).select("SK_ID_CURR", (F.col("score") == F.col("score_loaded")).alias("equal"))


@register("pipeline_roundtrip_check", f"SELECT SK_ID_CURR, TRUE AS equal, TRUE AS as_separate FROM ({D.APP_TRAIN_SQL}) t")
def pipeline_roundtrip_check(spark, sf):
    """Preparation and booster saved and loaded as one pipeline score every row as before
    (E6, S4), and as the scaler and booster do that are fitted one after the other."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import vector_to_array
    df, feats = _matrix(spark, sf)
    fitted = fit_pipeline(df, feats, CHECK_PARAMS.estimator(label_col="TARGET"))
    path = store.scratch_path(spark, "pipeline")
    store.save_model(fitted, path)
    loaded = PipelineModel.load(path)
    alone, prep = fit_all(df, feats, params=CHECK_PARAMS)
    x = VectorAssembler(inputCols=prep.features, outputCol="features", handleInvalid="keep").transform(
        min_max_scale(df, prep, keep=["SK_ID_CURR"]))
    score = lambda d, name: d.select("SK_ID_CURR", vector_to_array("probability")[1].alias(name))
    both = score(fitted.transform(df), "a").join(score(loaded.transform(df), "b"), "SK_ID_CURR").join(
        score(alone.transform(x), "c"), "SK_ID_CURR")
    return both.select("SK_ID_CURR", (F.col("a") == F.col("b")).alias("equal"),
                       (F.abs(F.col("a") - F.col("c")) < 1e-9).alias("as_separate"))


@register("gbt_auc_check", "SELECT CAST(i AS INTEGER) AS fold, TRUE AS equal FROM generate_series(-1, 4) g(i)")
def gbt_auc_check(spark, sf):
    """Our AUC of the model scores, per fold and in total, is Spark's own."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    p = _cv(spark, sf, "plain", CHECK_PARAMS).predictions.checkpoint(eager=True)
    judge = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="TARGET", numBins=0)
    own = [(-1, judge.evaluate(p)), *((f, judge.evaluate(p.where(F.col("fold") == f))) for f in range(5))]
    ours = M.roc_auc(p, "TARGET", "score", by="fold").unionByName(
        M.roc_auc(p, "TARGET", "score").select(F.lit(-1).alias("fold"), "auc"))
    theirs = spark.createDataFrame([(f, float(a)) for f, a in own], "fold int, other double")
    return ours.join(theirs, "fold").select("fold", (F.abs(F.col("auc") - F.col("other")) < 1e-9).alias("equal"))


CAP = 40
CAPPED = {"customer": "c_custkey", "orders": "o_orderkey", "part": "p_partkey", "supplier": "s_suppkey", "events": "event_id"}


@register("debug_cap", " UNION ALL ".join(
    f"SELECT '{t}' AS name, CAST({k} AS BIGINT) AS key FROM (SELECT * FROM {t} LIMIT {CAP})" for t, k in CAPPED.items()))
def debug_cap(spark, sf):
    """The debug row cap (S2): of tables written as CSV folders the first rows, in the
    order in which they stand in the files."""
    path = store.scratch_path(spark, "cap")
    caps = []
    for name, key in CAPPED.items():
        CSV.write_csv(D.read(spark, sf, name).select(key), f"{path}/{name}")
        back = CSV.read_csv(spark, f"{path}/{name}", f"{key} bigint", num_rows=CAP)
        caps.append(back.select(F.lit(name).alias("name"), F.col(key).alias("key")))
    return union_by_name(caps)


@register("csv_roundtrip", "SELECT doc_id, CASE WHEN text IN ('', 'NA') THEN NULL ELSE text END AS text, n_chars FROM documents")
def csv_roundtrip(spark, sf):
    """Texts with quotes, commas and line breaks through the CSV sink and source, then a
    missing cell as 'NA' (S1, S3)."""
    docs = D.read(spark, sf, "documents").select("doc_id", "text", "n_chars")
    path = store.scratch_path(spark, "csv")
    CSV.write_csv(docs, path, null_value="NA")
    return CSV.read_csv(spark, path, docs.schema, multi_line=True)


@register("csv_scan", O.final_select(
    f"SELECT * FROM ({D.APP_TRAIN_SQL} UNION ALL {D.APP_TEST_SQL}) u",
    [("SK_ID_CURR", "bigint"), ("c_mktsegment", "string"), ("c_nationkey", "bigint"), ("c_acctbal", "double"),
     ("TARGET", "double")]))
def csv_scan(spark, sf):
    """CSV sink then scan of the applicant table (train and test written separately, read
    back and unioned): types are found in the train part, 'nan' cells are missing."""
    path = store.scratch_path(spark, "app")
    CSV.write_csv(D.app_train(spark, sf), path + "/train")
    test = D.app_test(spark, sf)
    CSV.write_csv(test, path + "/test", null_value="nan")
    tr = CSV.read_csv(spark, path + "/train")
    te = CSV.read_csv(spark, path + "/test", test.schema)
    return finalize(union_by_name([tr, te]))


@register("metrics_append", O.final_select(
    f"""SELECT 'AUC' AS metric, CAST(s.step AS BIGINT) AS step, a.auc AS value
FROM ({_auc_sql('score_discount')}) a, (VALUES (0), (1)) s(step)
UNION ALL SELECT 'Accuracy', CAST(s.step AS BIGINT), AVG(CAST(label = pred_discount AS DOUBLE))
FROM ({_scored_sql()}) x, (VALUES (0), (1)) s(step) GROUP BY s.step""",
    [("metric", "string"), ("step", "bigint"), ("value", "double")]))
def metrics_append(spark, sf):
    """Metrics of steps 0 and 1, the first one written twice as by a retry, read back."""
    s = _scored(spark, sf)
    m = M.roc_auc(s, "label", "score_discount").select(F.lit("AUC").alias("metric"), F.col("auc").alias("value")) \
        .unionByName(M.accuracy(s, "label", "pred_discount").select(F.lit("Accuracy").alias("metric"),
                                                                    F.col("accuracy").alias("value")))
    path = store.scratch_path(spark, "metrics")
    for step in (0, 1, 0):
        store.log_metric_frame(m, path, "run", step=step)
    return finalize(store.read_metrics(spark, path).select("metric", "step", "value"))
