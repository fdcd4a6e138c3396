"""Gradient-boosted default models with out-of-fold evaluation.

The reference fits a leaf-wise booster per fold; here every fit is
Spark ML's distributed ``GBTClassifier`` on a ``VectorAssembler``
column. Parameter map from the reference's tuned values:

=====================  ==========================================
reference              Spark ML
=====================  ==========================================
learning_rate 0.02     stepSize 0.02
n_estimators 10000     maxIter 10000 (pass fewer for a bounded run)
max_depth 8,           maxDepth 5 (32 leaves; Spark grows level by
num_leaves 34          level, not leaf by leaf)
colsample_bytree       featureSubsetStrategy '0.9497036' (drawn per
                       node, not per tree)
subsample              subsamplingRate 0.8715623
min_split_gain         minInfoGain: the gain as a share of the training
                       rows (the reference's gain is a sum over a node's
                       rows, Spark's a mean: taken as it stands it would
                       leave most trees without a split)
min_child_weight       minWeightFractionPerNode: the weight as a share of
                       the training rows (at most 0.49)
reg_alpha, reg_lambda  no equivalent
=====================  ==========================================

Deliberate differences from the reference (its faults, see README):
SMOTE runs inside each training fold (the reference resamples the whole
table and then mixes positions, so validation rows leak into training);
positive rows get the larger weight in the weighted variant; every
variant reads importances from its own model; all folds are kept.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from threading import Lock

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.exprs import conditional_value, qcol
from riskloom.operators import ensemble as E
from riskloom.operators import prep as PR
from riskloom.operators.assemble import union_by_name
from riskloom.operators.rank import global_position
from riskloom.operators.sampling import hash_cut, kfold, stratified_kfold
from riskloom.operators.smote import smote, synthetic_keys
from riskloom.session import checkpoint_dir
from riskloom.sources.store import shuffles_released, stored

# The reference's tuned booster parameters, mapped as above.
REF_LEARNING_RATE = 0.02
REF_COLSAMPLE = 0.9497036
REF_SUBSAMPLE = 0.8715623
REF_MIN_SPLIT_GAIN = 0.0222415
REF_MIN_CHILD_WEIGHT = 39.3259775
REF_TREES = 10000
REF_FOLD_SEED = 1001
REF_COST_FN = 10.0
REF_COST_FP = 1.0


@dataclass
class GBTParams:
    step_size: float = REF_LEARNING_RATE
    max_iter: int = REF_TREES
    max_depth: int = 5
    feature_subset: str = str(REF_COLSAMPLE)
    subsampling_rate: float = REF_SUBSAMPLE
    min_info_gain: float = REF_MIN_SPLIT_GAIN
    min_child_weight: float = REF_MIN_CHILD_WEIGHT
    max_bins: int = 32
    seed: int = REF_FOLD_SEED
    validation_tol: float | None = None   # early stop on the validation fold when set

    def estimator(self, features_col="features", label_col="label", weight_col=None,
                  validation_col=None, n_rows: int | None = None) -> GBTClassifier:
        """``n_rows``: training rows, for the least gain and the least share of them in a node
        (both 0 without it)."""
        kw = dict(featuresCol=features_col, labelCol=label_col, stepSize=self.step_size,
                  maxIter=self.max_iter, maxDepth=self.max_depth,
                  featureSubsetStrategy=self.feature_subset, subsamplingRate=self.subsampling_rate,
                  minInfoGain=self.min_info_gain / n_rows if n_rows else 0.0,
                  minWeightFractionPerNode=min(0.49, self.min_child_weight / n_rows) if n_rows else 0.0,
                  maxBins=self.max_bins, seed=self.seed,
                  # the boosting state is checkpointed to the shared folder every
                  # 10 trees, so a lost executor never replays the whole ensemble
                  checkpointInterval=10)
        if weight_col:
            kw["weightCol"] = weight_col
        if validation_col and self.validation_tol is not None:
            kw["validationIndicatorCol"] = validation_col
            kw["validationTol"] = self.validation_tol
        return GBTClassifier(**kw)


@dataclass
class CVResult:
    predictions: DataFrame          # key, label, fold, score, prediction
    importances: DataFrame          # feature, importance, splits, fold
    models: list = field(default_factory=list)
    preps: list = field(default_factory=list)
    history: DataFrame | None = None   # fold, split, iteration, loss, auc


def _assemble(df: DataFrame, features) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features",
                           handleInvalid="keep").transform(df)


def _vectors(df: DataFrame, features, keep) -> DataFrame:
    """``keep`` and the features as one vector, written once to the shared folder: the booster's
    passes, the scores and the history (and a lost executor) do not scale and assemble again."""
    return _assemble(df, features).select(*[qcol(c) for c in keep], "features").checkpoint(eager=True)


def _importance_frame(spark, model, nodes, features, fold):
    """Both kinds of importance: ``importance`` by gain (Spark's), ``splits`` by number of
    splitting nodes (the reference's)."""
    imp = model.featureImportances.toArray().tolist()
    gain = spark.createDataFrame([(f, float(v), fold) for f, v in zip(features, imp)],
                                 "feature string, importance double, fold int")
    return gain.join(E.split_counts(nodes, features), "feature").select("feature", "importance", "splits", "fold")


def iteration_auc(model, assembled: DataFrame, label: str, every: int = 1) -> DataFrame:
    """AUC and loss after each boosting iteration (M8, the reference's eval metric) of one
    model: iteration, loss, auc. The probability is a monotone function of the margin, so
    the AUC is the same. ``every`` keeps every n-th iteration (and the last)."""
    trees = E.Trees.of(E.written_nodes(assembled.sparkSession, model))
    return E.iteration_metrics([({}, trees, assembled)], label, every)


def _oversample(train: DataFrame, key: str, features, label: str, k: int, seed: int, n: int,
                draw_back: bool) -> tuple[DataFrame, DataFrame]:
    """SMOTE on the ``n`` training rows: label and features as one vector, with the key in
    the second frame, which is written. The first is the training rows as they stand.

    Drawn back to the original row count by an exact hash sample, if so wished: where the
    sample ends is found from the keys alone, so rows outside it are neither made nor moved
    and the training rows are filtered where they are."""
    own, new = F.col("_rk"), lambda k: F.concat(F.lit("syn:"), k)
    vec = train.select(qcol(key).cast("string").alias("_rk"), qcol(label).cast("int").alias("_y"),
                       F.array(*[qcol(c).cast("double") for c in features]).alias("_v"))
    args = dict(seed=seed, minority=1)
    cut = None
    if draw_back:
        made = synthetic_keys(vec, "_rk", "_y", **args).select(new(F.col("row_key")).alias("_rk"))
        cut = hash_cut(vec.select("_rk").unionByName(made), "_rk", n, seed=42)
    inside = (lambda k: cut.before(k) | cut.at(k)) if cut else lambda k: F.lit(True)
    syn = smote(vec, "_rk", "_v", "_y", k=k, keep=lambda k: inside(new(k)), **args)
    syn = syn.select(new(F.col("row_key")).alias("_rk"), F.col("label").cast("double").alias(label),
                     *[F.col("vector")[i].alias(c) for i, c in enumerate(features)])
    syn = _vectors(syn, features, ["_rk", label])
    rows = _assemble(train.withColumns({"_rk": qcol(key).cast("string"), label: qcol(label).cast("int").cast("double")})
                     .where(inside(own)), features).select("_rk", qcol(label), "features")
    if cut and cut.taken < cut.held:  # rows of one key on both sides of the cut
        tied = rows.unionByName(syn).where(cut.at(own))
        order = F.pmod(F.xxhash64(vector_to_array("features"), qcol(label)), F.lit(2 ** 32))
        tied = global_position(tied, "_rk", name="_pos", hash_col=order, n_rows=cut.held).where(F.col("_pos") < cut.taken)
        syn = syn.where(cut.before(own)).unionByName(tied.drop("_pos").checkpoint(eager=True))
        rows = rows.where(cut.before(own))
    return rows.drop("_rk"), syn.drop("_rk")


def cv_train(df: DataFrame, key: str, features, label: str = "TARGET", k: int = 5,
             seed: int = REF_FOLD_SEED, variant: str = "plain", params: GBTParams | None = None,
             stratified: bool = False, fit_scope: str = "fold", pos_weight: float = REF_COST_FN,
             neg_weight: float = REF_COST_FP, smote_k: int = 5, draw_back: bool = True,
             parallelism: int = 2, history: bool = False, every: int = 1,
             best_iteration: bool = False) -> CVResult:
    """K-fold training and out-of-fold scoring.

    ``variant``: 'plain' (as is), 'weighted' (row weight by label) or
    'smote' (minority oversampled inside each training fold).
    ``fit_scope``: 'fold' fits impute/scale on the training fold only;
    'all' fits them once on every row (the reference's order).
    ``history`` evaluates every ``every``-th iteration on the training and
    validation rows of all folds; ``best_iteration`` scores each fold with the
    trees up to its best validation AUC (as the reference asks for), not all.
    The prepared table is checkpointed once to the shared checkpoint
    folder, and so are each fold's scaled vectors (with 'smote' only its new
    rows), so the five fits do not recompute the features and survive a lost executor.
    """
    params = params or GBTParams()
    spark = df.sparkSession
    checkpoint_dir(spark)
    feats = list(features)
    base = df.select(qcol(key), qcol(label).cast("double").alias(label), *[qcol(c) for c in feats])
    base = (stratified_kfold(base, key, label, k, seed) if stratified else kfold(base, key, k, seed))
    if fit_scope == "all":
        pm = PR.fit_prep(base, feats)
        feats = pm.features
        base = PR.min_max_scale(base, pm, keep=[key, label, "fold"])
    base = base.checkpoint(eager=True)
    preps, n_train = PR.fit_preps(base, feats if fit_scope == "fold" else [], "fold", range(k))
    whole = _vectors(base, feats, [key, label, "fold"]) if fit_scope == "all" else None

    resampling = Lock()

    def one(fold):
        pm = preps[fold] if fit_scope == "fold" else None
        fs = pm.features if pm else feats
        others, own = F.col("fold") != fold, F.col("fold") == fold
        scaled = PR.min_max_scale(base, pm, keep=[key, label, "fold"]) if pm else base
        if variant == "smote":
            # new rows come from joins and windows and are written; the table's own rows are read
            # where they are. One fold after the other, so that one fold's shuffle files lie there
            with resampling, shuffles_released(spark):
                train = union_by_name(_oversample(scaled.where(others), key, fs, label, smote_k, seed + fold,
                                                  n_train[fold], draw_back))
            valid = whole.where(own) if whole is not None else \
                _assemble(scaled.where(own), fs).select(qcol(key), qcol(label), "fold", "features")
            n_rows = train.count()
        else:
            rows = whole if whole is not None else _vectors(scaled, fs, [key, label, "fold"])
            train, valid, n_rows = rows.where(others), rows.where(own), n_train[fold]
        weight = None
        if variant == "weighted":
            train = train.withColumn("_w", conditional_value(F.col(label) == 1, pos_weight, neg_weight))
            weight = "_w"
        fit_rows, val_col = train, None
        if params.validation_tol is not None:
            # early stop on the fold's validation rows (the reference's eval set)
            val_col = "_is_valid"
            vrows = valid.select(*train.columns if weight is None else [c for c in train.columns if c != weight])
            if weight is not None:
                vrows = vrows.withColumn(weight, F.lit(1.0))
            fit_rows = train.withColumn(val_col, F.lit(False)).unionByName(vrows.withColumn(val_col, F.lit(True)))
        est = params.estimator(label_col=label, weight_col=weight, validation_col=val_col, n_rows=n_rows)
        model = est.fit(fit_rows)
        scored = model.transform(valid)
        pred = scored.select(qcol(key), qcol(label), F.lit(fold).alias("fold"),
                             vector_to_array("probability")[1].alias("score"), F.col("prediction"))
        nodes = E.written_nodes(spark, model)
        parts = []
        if history or best_iteration:
            trees = E.Trees.of(nodes)
            parts = [({"fold": fold, "split": split}, trees, d)
                     for split, d in (("train", train), ("valid", valid)) if history or split == "valid"]
        return pred, _importance_frame(spark, model, nodes, fs, fold), model, pm, parts

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        outs = list(pool.map(one, range(k)))
    preds = union_by_name([o[0] for o in outs])
    imps = union_by_name([o[1] for o in outs])
    parts = [p for o in outs for p in o[4]]
    hist = None
    if parts:
        hist = stored(E.iteration_metrics(parts, label, every))
    if best_iteration:
        best = {r["fold"]: r["iteration"] for r in E.best_iterations(hist).collect()}
        preds = union_by_name([_scored_at(trees, x, key, label, by["fold"], best.get(by["fold"]))
                               for by, trees, x in parts if by["split"] == "valid"])
    return CVResult(preds, imps, [o[2] for o in outs], [o[3] for o in outs], hist)


def _scored_at(trees, rows: DataFrame, key: str, label: str, fold: int, iteration: int | None) -> DataFrame:
    scored = E.scores_at(trees, rows, [key, label], iteration)
    return scored.select(qcol(key), qcol(label), F.lit(fold).alias("fold"), "score",
                         (F.col("score") > 0.5).cast("double").alias("prediction"))
