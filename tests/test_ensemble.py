import re
from collections import Counter

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskloom.operators import ensemble as E
from riskloom.operators import metrics as M
from riskloom.operators.model import GBTParams, _assemble, cv_train, iteration_auc


def _data(spark):
    df = spark.range(1, 401).withColumnRenamed("id", "k").withColumn("x1", (F.col("k") % 17).cast("double"))
    df = df.withColumn("x2", F.sin("k")).withColumn("x3", F.lit(1.0))
    return df.withColumn("TARGET", ((F.col("x1") > 12) | (F.col("x2") > 0.95)).cast("double"))


FEATURES = ["x1", "x2", "x3"]


def _fitted(spark, trees, depth=3):
    x = _assemble(_data(spark), FEATURES)
    return GBTParams(max_iter=trees, max_depth=depth, min_child_weight=0.0, min_info_gain=0.0).estimator(
        label_col="TARGET").fit(x), x


def test_split_counts_and_margins(spark):
    model, x = _fitted(spark, 6)
    nodes = E.written_nodes(spark, model).checkpoint()
    printed = Counter(int(i) for i in re.findall(r"If \(feature (\d+) ", model.toDebugString))
    got = {r.feature: r.splits for r in E.split_counts(nodes, FEATURES).collect()}
    assert got == {f: printed.get(i, 0) for i, f in enumerate(FEATURES)} and got["x3"] == 0
    assert nodes.count() == sum(t.numNodes for t in model.trees)
    # margins: each tree's own predictions, weighted and added up
    trees = E.Trees.of(nodes)
    rows = x.limit(50).collect()
    margins = trees.margins(np.array([r["features"].toArray() for r in rows]))
    want = np.cumsum([[t.predict(r["features"]) * w for t, w in zip(model.trees, model.treeWeights)] for r in rows], axis=1)
    assert np.allclose(margins, want, atol=1e-12)
    same = E.scores_at(trees, x, ["k"]).join(
        model.transform(x).select("k", vector_to_array("probability")[1].alias("p")), "k")
    assert same.where(F.abs(F.col("score") - F.col("p")) > 1e-12).count() == 0 and same.count() == 400


def test_trees_without_a_split(spark):
    x = _assemble(_data(spark).withColumn("TARGET", F.lit(1.0)), FEATURES)
    model = GBTParams(max_iter=2, max_depth=2).estimator(label_col="TARGET").fit(x)
    nodes = E.written_nodes(spark, model)
    assert E.Trees.of(nodes).depth == 0
    assert {r.splits for r in E.split_counts(nodes, FEATURES).collect()} == {0}
    rows = E.iteration_metrics([({"fold": 0}, E.Trees.of(nodes), x)], "TARGET").collect()
    assert [r.auc for r in rows] == [None] * len(rows) and all(r.loss < 0.3 for r in rows)


def test_history_equals_sparks_own(spark):
    model, x = _fitted(spark, 4, depth=2)
    held = {r.iteration: r for r in iteration_auc(model, x, "TARGET").collect()}
    assert sorted(held) == [1, 2, 3, 4]
    for i, loss in enumerate(model.evaluateEachIteration(x), 1):
        assert abs(held[i].loss - loss) < 1e-9
    scored = model.transform(x).withColumn("score", vector_to_array("probability")[1])
    assert abs(held[4].auc - M.roc_auc(scored, "TARGET", "score").first().auc) < 1e-12
    assert sorted(r.iteration for r in iteration_auc(model, x, "TARGET", every=3).collect()) == [3, 4]


def test_jobs_do_not_grow_with_the_trees(spark):
    jobs = {}
    for n in (2, 40):
        model, x = _fitted(spark, n, depth=1)
        trees = E.Trees.of(E.written_nodes(spark, model))
        spark.sparkContext.setJobGroup(f"history-{n}", "")
        try:
            assert E.iteration_metrics([({"split": s}, trees, x) for s in "ab"], "TARGET").count() == 2 * len(model.trees)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        jobs[n] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"history-{n}"))
    assert jobs[2] == jobs[40] > 0


def test_best_iteration_scores(spark):
    df = _data(spark)
    params = GBTParams(max_iter=5, max_depth=2, min_child_weight=0.0)
    res = cv_train(df, "k", FEATURES, "TARGET", k=2, params=params, history=True, best_iteration=True)
    best = {r.fold: r.iteration for r in E.best_iterations(res.history).collect()}
    top = {r.fold: r.auc for r in res.history.where("split = 'valid'").groupBy("fold").agg(F.max("auc").alias("auc")).collect()}
    own = {r.fold: r.auc for r in M.roc_auc(res.predictions, "TARGET", "score", by="fold").collect()}
    assert best.keys() == own.keys() == {0, 1} and all(abs(top[f] - own[f]) < 1e-12 for f in own)
    assert res.predictions.count() == 400
    first = res.history.where("split = 'valid'").orderBy("fold", F.desc("auc"), "iteration").dropDuplicates(["fold"])
    assert all(best[f] <= 5 for f in best) and first.count() == 2
    splits = res.importances.groupBy("fold").agg(F.sum("splits").alias("n")).collect()
    assert {r.fold: r.n for r in splits} == {i: sum((t.numNodes - 1) // 2 for t in m.trees) for i, m in enumerate(res.models)}
