"""A fitted boosted ensemble as a table of nodes, and what follows from it.

Spark ML keeps a fitted ensemble on the driver; saved, it is a Parquet table
with a row a node. ``node_table`` reads that table with plain columns, so
importances by number of splits are one aggregate over it (M5, the
reference's kind of importance), and ``Trees`` holds the same rows as
arrays for ``margins``: the running sums of the trees' weighted
predictions, all iterations of a row in one pass over its features.

``iteration_metrics`` gives AUC and loss after every iteration (M8) of any
number of models and row sets in one go: each batch of rows counts its
positives and negatives by (iteration, score), the counts are added up by
one aggregate, and one grouped AUC runs over them. The number of jobs does
not depend on the number of trees.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.exprs import qcol
from riskloom.operators.assemble import union_by_name
from riskloom.operators.metrics import auc_of_counts
from riskloom.sources.store import save_model, scratch_path, stored

#: rows x trees whose positions are walked at a time
WALK = 1 << 20


def node_table(spark: SparkSession, path: str) -> DataFrame:
    """A saved ensemble's nodes: tree, weight, node, prediction, gain, left, right,
    feature, threshold; leaves have no feature. Categorical splits raise."""
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    weights = spark.read.parquet(f"{path}/treesMetadata").select(F.col("_1").alias("treeID"), F.col("_3").alias("weight"))
    inner = F.col("leftChild") >= 0
    split = F.col("split.leftCategoriesOrThreshold")
    threshold = F.when(F.col("split.numCategories") >= 0, F.raise_error(F.lit("categorical splits are not read"))
                       .cast("double")).otherwise(F.get(split, F.lit(0)))
    return nodes.join(F.broadcast(weights), "treeID").select(
        F.col("treeID").alias("tree"), "weight", F.col("id").alias("node"), "prediction", F.when(inner, F.col("gain")).alias("gain"),
        F.when(inner, F.col("leftChild")).alias("left"), F.when(inner, F.col("rightChild")).alias("right"),
        F.when(inner, F.col("split.featureIndex")).alias("feature"), F.when(inner, threshold).alias("threshold"))


def written_nodes(spark: SparkSession, model) -> DataFrame:
    """The nodes of a fitted ensemble, saved in the shared folder."""
    path = scratch_path(spark, "ensemble")
    save_model(model, path)
    return node_table(spark, path)


def split_counts(nodes: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, splits): in how many nodes each feature is the one that splits."""
    names = nodes.sparkSession.createDataFrame(list(enumerate(features)), "index int, feature string")
    used = nodes.where("feature IS NOT NULL").groupBy(F.col("feature").alias("index")).agg(F.count(F.lit(1)).alias("n"))
    return names.join(used, "index", "left").select("feature", F.coalesce("n", F.lit(0)).cast("long").alias("splits"))


@dataclass
class Trees:
    """The nodes as arrays, a row a tree; a leaf's children are the leaf itself."""
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    prediction: np.ndarray
    weight: np.ndarray
    depth: int

    @classmethod
    def of(cls, nodes: DataFrame) -> Trees:
        """As large as the model, which the driver holds anyway."""
        f = nodes.orderBy("tree", "node").toPandas()
        n_trees, width = int(f["tree"].max()) + 1, int(f["node"].max()) + 1
        at = (f["tree"].to_numpy(), f["node"].to_numpy())

        def filled(column, dtype, empty):
            out = np.tile(np.asarray(empty, dtype), (n_trees, width)) if np.ndim(empty) == 0 \
                else np.tile(empty, (n_trees, 1)).astype(dtype)
            values = f[column].to_numpy(float)
            known = ~np.isnan(values)
            out[at[0][known], at[1][known]] = values[known].astype(dtype)
            return out

        own = np.arange(width)
        weight = f.drop_duplicates("tree").sort_values("tree")["weight"].to_numpy(float)
        trees = cls(filled("feature", np.int32, 0), filled("threshold", float, 0.0), filled("left", np.int32, own),
                    filled("right", np.int32, own), filled("prediction", float, 0.0), weight, 0)
        inner = trees.left != own
        level = np.zeros((n_trees, width), bool)
        level[:, 0] = True
        while (level & inner).any():  # the nodes of the next level, until all are leaves
            tree, node = np.nonzero(level & inner)
            level = np.zeros((n_trees, width), bool)
            level[tree, trees.left[tree, node]] = level[tree, trees.right[tree, node]] = True
            trees.depth += 1
        return trees

    def margins(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): the weighted sum of the first trees' predictions."""
        out = np.empty((len(x), len(self.weight)))
        step = max(1, WALK // max(1, len(x)))
        row = np.arange(len(x))[:, None]
        for a in range(0, len(self.weight), step):
            tree = np.arange(a, min(a + step, len(self.weight)))[None, :]
            at = np.zeros((len(x), tree.shape[1]), np.int32)
            for _ in range(self.depth):
                low = x[row, self.feature[tree, at]] <= self.threshold[tree, at]
                at = np.where(low, self.left[tree, at], self.right[tree, at])
            out[:, a:a + step] = self.prediction[tree, at] * self.weight[tree]
        return np.cumsum(out, axis=1)


def scores_at(model_trees: Trees, assembled: DataFrame, keep: Sequence[str], iteration: int | None = None) -> DataFrame:
    """``keep`` and the score (probability of label 1) after ``iteration`` trees (all)."""
    n = iteration or len(model_trees.weight)
    shared = assembled.sparkSession.sparkContext.broadcast(model_trees)
    rows = assembled.select(*[qcol(c) for c in keep], vector_to_array("features").alias("_x"))
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "_x") + ", score double"

    def score(frames):
        for f in frames:
            if len(f):
                m = shared.value.margins(np.stack(f["_x"].to_list()))[:, n - 1]
                yield f.drop(columns="_x").assign(score=1.0 / (1.0 + np.exp(-2.0 * m)))

    return rows.mapInPandas(score, schema)


def _counts(trees: Trees, assembled: DataFrame, label: str, every: int) -> DataFrame:
    """(iteration, score, pos, neg) of each batch of rows."""
    n = len(trees.weight)
    kept = [i for i in range(n) if (i + 1) % every == 0 or i + 1 == n]
    shared = assembled.sparkSession.sparkContext.broadcast(trees)
    rows = assembled.where(qcol(label).isNotNull()).select(
        qcol(label).cast("int").alias("y"), vector_to_array("features").alias("x"))

    def count(frames):
        for f in frames:
            if not len(f):
                continue
            margins, y = shared.value.margins(np.stack(f["x"].to_list())), f["y"].to_numpy()
            for i in kept:
                score, at = np.unique(margins[:, i], return_inverse=True)
                pos = np.bincount(at, y == 1, minlength=len(score)).astype(np.int64)
                neg = np.bincount(at, y == 0, minlength=len(score)).astype(np.int64)
                yield pd.DataFrame({"iteration": np.int32(i + 1), "score": score, "pos": pos, "neg": neg})

    return rows.mapInPandas(count, "iteration int, score double, pos long, neg long")


def log_loss(margin, label):
    """Spark's loss of boosted classifiers: 2 log(1 + exp(-2 y m)) with y = -1 or 1."""
    x = F.lit(-2.0) * label * margin
    return 2.0 * (F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))))


def iteration_metrics(parts: Sequence[tuple[dict, Trees, DataFrame]], label: str, every: int = 1) -> DataFrame:
    """AUC and mean log loss after every ``every``-th iteration and the last.

    ``parts`` are (names, trees, assembled rows); the names (for example fold
    and split) become columns, the same ones for each part.
    """
    names = list(parts[0][0])
    each = [_counts(t, x, label, every).select(*[F.lit(v).alias(k) for k, v in by.items()], "*") for by, t, x in parts]
    keys = [*names, "iteration"]
    counts = stored(union_by_name(each).groupBy(*keys, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    total = F.col("pos") * log_loss(F.col("score"), 1.0) + F.col("neg") * log_loss(F.col("score"), -1.0)
    loss = counts.groupBy(*keys).agg((F.sum(total) / F.sum(F.col("pos") + F.col("neg"))).alias("loss"))
    return loss.join(auc_of_counts(counts, keys, "score", "pos", "neg"), keys)


def best_iterations(history: DataFrame, by: str = "fold", split: str = "valid") -> DataFrame:
    """(fold, iteration): where the split's AUC is highest, the first of equals."""
    rows = history.where((F.col("split") == split) & F.col("auc").isNotNull())
    return rows.groupBy(by).agg(F.max_by("iteration", F.struct(F.col("auc"), -F.col("iteration"))).alias("iteration"))
