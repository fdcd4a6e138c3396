import math
import random

from pyspark.sql import functions as F

from riskloom.operators import metrics as M
from riskloom.operators.prep import fit_prep, min_max_scale, prepare_data


def brute_auc(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    tot = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_auc_exact_with_ties(spark):
    rnd = random.Random(5)
    rows = [(rnd.random() < 0.3 and 1 or 0, round(rnd.random(), 2)) for _ in range(600)]
    df = spark.createDataFrame(rows, "label int, score double")
    got = M.roc_auc(df, "label", "score").first().auc
    assert abs(got - brute_auc(rows)) < 1e-12
    flipped = M.roc_auc(df.withColumn("score", -F.col("score")), "label", "score").first().auc
    assert abs(flipped - (1 - got)) < 1e-12


def test_auc_crowded_scores(spark):
    # most scores in a tiny range: quantile cuts keep ranges balanced
    rnd = random.Random(9)
    rows = [(int(rnd.random() < 0.1), 0.02 + rnd.random() * 1e-6 if i % 10 else rnd.random()) for i in range(800)]
    df = spark.createDataFrame(rows, "label int, score double")
    assert abs(M.roc_auc(df, "label", "score").first().auc - brute_auc(rows)) < 1e-12


def test_auc_single_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.6)], "label int, score double")
    assert M.roc_auc(df, "label", "score").first().auc is None


def test_confusion_zero_cells_and_accuracy(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (0, 1)], "label int, prediction int")
    cells = {(r.label, r.prediction): r.n for r in M.confusion_matrix(df).collect()}
    assert cells == {(0, 0): 0, (0, 1): 1, (1, 0): 0, (1, 1): 2}
    assert abs(M.accuracy(df).first().accuracy - 2 / 3) < 1e-12


def test_top_features(spark):
    imp = spark.createDataFrame([("a", 1.0, 1), ("a", 3.0, 2), ("b", 2.0, 1), ("c", 2.0, 1), ("d", 0.5, 1)],
                                "feature string, importance double, fold int")
    top, rows = M.top_features(imp, 2)
    assert [r.feature for r in top.collect()] == ["a", "b"]   # b and c tie: by name
    assert sorted(r.feature for r in rows.collect()) == ["a", "a", "b"]


def test_prep_constant_column_and_all_null(spark):
    df = spark.createDataFrame([(1, 5.0, None, 1.0, math.inf), (2, 5.0, None, None, 2.0), (3, 5.0, None, 3.0, -math.inf)],
                               "SK_ID_CURR bigint, const double, empty double, x double, r double")
    df = df.withColumn("TARGET", F.lit(0.0))
    df, feats = prepare_data(df)
    assert feats == ["const", "empty", "x", "r"]
    m = fit_prep(df, feats)
    assert m.dropped == ["empty"] and m.mean["x"] == 2.0 and m.hi["r"] == 1e9
    out = {r.SK_ID_CURR: r for r in min_max_scale(df, m, keep=["SK_ID_CURR"]).collect()}
    assert all(out[k].const == 0.0 for k in out)
    assert out[2].x == 0.5 and out[1].x == 0.0 and out[3].x == 1.0
    assert out[1].r == 1.0 and out[3].r == 0.0


def test_auc_skips_missing(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, None), (None, 0.5), (0, float("nan"))],
                               "label int, score double")
    assert M.roc_auc(df, "label", "score").first().auc == 1.0


def test_null_groups_and_infinite_scores(spark):
    """40 rows in, 40 out with 10 missing labels; a missing group and infinite scores count."""
    from riskloom.operators.sampling import stratified_kfold
    df = spark.range(40).selectExpr("id AS k", "CAST(IF(id % 4 = 0, NULL, id % 2) AS DOUBLE) AS y")
    rows = stratified_kfold(df, "k", "y", 5).collect()
    assert len(rows) == 40
    sizes = [sum(r.fold == f for r in rows if r.y is None) for f in range(5)]
    assert sizes == [2] * 5
    inf = float("inf")
    data = [("a", 1, 1.0), ("a", 0, -inf), ("a", 1, inf), ("a", 0, 2.0), (None, 1, 3.0), (None, 0, 1.0), (None, 0, inf)]
    got = {r.g: r.auc for r in M.roc_auc(spark.createDataFrame(data, "g string, label int, score double"),
                                         by="g").collect()}
    assert got == {"a": 0.75, None: 0.5}
