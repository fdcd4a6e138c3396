"""Model-matrix preparation, sampling, folds and evaluation metrics on
the driver tables (all SQL-checkable: hashes are portable md5 prefixes)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions.exprs import ieee_div, portable_hash, portable_hash_sql
from riskloom.operators import metrics as M
from riskloom.operators import prep as PR
from riskloom.operators import sampling as S
from riskloom.operators.rank import global_position
from riskloom.plans import driver as D
from riskloom.plans import oracle as O
from riskloom.plans.catalog import finalize, register
from riskloom.plans.q_features import app_features, app_sql

# -- imputation and scaling ------------------------------------------------------

NUM_SQL = """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity,
  NULLIF(l_discount, 0.0) AS l_discount, NULLIF(l_tax, 0.0) AS l_tax FROM lineitem"""
NUM_FEATS = ["l_quantity", "l_discount", "l_tax"]


def _num_table(spark, sf):
    li = D.read(spark, sf, "lineitem")
    return li.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_quantity",
                     F.nullif("l_discount", F.lit(0.0)).alias("l_discount"),
                     F.nullif("l_tax", F.lit(0.0)).alias("l_tax"))


def _cols(feats):
    return [("l_orderkey", "bigint"), ("l_linenumber", "bigint")] + [(c, "double") for c in feats]


@register("mean_impute", O.final_select(
    f"SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"COALESCE({c}, AVG({c}) OVER ()) AS {c}" for c in NUM_FEATS) + f" FROM ({NUM_SQL}) t",
    _cols(NUM_FEATS)))
def mean_impute(spark, sf):
    """Missing -> column mean (fit: one aggregate; transform: literals)."""
    t = _num_table(spark, sf)
    m = PR.fit_prep(t, NUM_FEATS)
    return finalize(PR.mean_impute(t, m, keep=["l_orderkey", "l_linenumber"]))


def _scale_sql(src, feats):
    items = []
    for c in feats:
        x = f"COALESCE({c}, AVG({c}) OVER ())"
        lo, hi = f"MIN({c}) OVER ()", f"MAX({c}) OVER ()"
        items.append(f"CASE WHEN {hi} = {lo} THEN 0.0 ELSE ({x} - {lo}) / ({hi} - {lo}) END AS {O.q(c)}")
    return items


@register("min_max_scale", O.final_select(
    f"SELECT l_orderkey, l_linenumber, {', '.join(_scale_sql('t', NUM_FEATS))} FROM ({NUM_SQL}) t",
    _cols(NUM_FEATS)))
def min_max_scale(spark, sf):
    """Impute then scale to [0, 1]; a constant column gives 0."""
    t = _num_table(spark, sf)
    m = PR.fit_prep(t, NUM_FEATS)
    return finalize(PR.min_max_scale(t, m, keep=["l_orderkey", "l_linenumber"]))


PREP_FEATS = ["c_mktsegment", "c_nationkey", "c_acctbal", "ACCTBAL_PER_NATION"]


def _prep_sql():
    inner, _ = app_sql()
    rep = ("CASE WHEN ACCTBAL_PER_NATION = CAST('inf' AS DOUBLE) THEN 1e9 "
           "WHEN ACCTBAL_PER_NATION = CAST('-inf' AS DOUBLE) THEN -1e9 ELSE ACCTBAL_PER_NATION END")
    src = f"""SELECT SK_ID_CURR, TARGET, CAST(c_mktsegment AS DOUBLE) AS c_mktsegment,
  CAST(c_nationkey AS DOUBLE) AS c_nationkey, c_acctbal, {rep} AS ACCTBAL_PER_NATION
FROM ({inner}) a WHERE TARGET IS NOT NULL"""
    sql = f"SELECT SK_ID_CURR, TARGET, {', '.join(_scale_sql('t', PREP_FEATS))} FROM ({src}) t"
    return O.final_select(sql, [("SK_ID_CURR", "bigint"), ("TARGET", "double")]
                          + [(c, "double") for c in PREP_FEATS])


@register("prep_pipeline", _prep_sql())
def prep_pipeline(spark, sf):
    """prepare_data (inf -> +-1e9, feature list) -> mean impute -> min-max
    scale, fitted on the whole labelled table (the reference's scope)."""
    df = app_features(spark, sf).where(F.col("TARGET").isNotNull())
    df, feats = PR.prepare_data(df, label="TARGET", exclude=PR.DEFAULT_EXCLUDE)
    m = PR.fit_prep(df, feats)
    return finalize(PR.min_max_scale(df, m, keep=["SK_ID_CURR", "TARGET"]))


# -- samples, folds, positions -------------------------------------------------------

@register("hash_sample", f"""SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE {portable_hash_sql('o_orderkey', seed=0)} < {int(0.1 * S.HASH_RANGE)}""")
def hash_sample(spark, sf):
    """10 % sample by a repeatable hash of the key."""
    o = D.read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return S.hash_sample(o, "o_orderkey", 0.1, seed=0)


def _pos_sql(table, key, seed, part=None):
    over = (f"PARTITION BY {part} " if part else "") + f"ORDER BY {portable_hash_sql(key, seed=seed)}, {key}"
    return f"row_number() OVER ({over}) - 1"


@register("global_position", f"""SELECT o_orderkey, o_custkey, {_pos_sql('orders', 'o_orderkey', 42)} AS pos
FROM orders""")
def global_position_q(spark, sf):
    """Exact 0-based position in hash order, without a one-task window."""
    o = D.read(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return global_position(o, "o_orderkey", seed=42, name="pos")


@register("exact_sample", f"""SELECT o_orderkey, o_custkey, o_totalprice FROM (
  SELECT *, {_pos_sql('orders', 'o_orderkey', 42)} AS pos FROM orders) t
WHERE pos < (SELECT COUNT(*) FROM orders) // 10""")
def exact_sample(spark, sf):
    """Exactly a tenth of the rows (count // 10), chosen by hash order."""
    o = D.read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    n = o.count()
    return S.exact_sample(o, "o_orderkey", n // 10, seed=42, n_rows=n)


@register("kfold", f"""SELECT c_custkey, CAST(({_pos_sql('customer', 'c_custkey', 1001)}) % 5 AS INTEGER) AS fold
FROM customer""")
def kfold(spark, sf):
    """Shuffled 5-fold assignment, seed 1001; fold sizes differ by at most one."""
    c = D.read(spark, sf, "customer").select("c_custkey")
    return S.kfold(c, "c_custkey", 5, seed=1001)


@register("stratified_kfold", f"""SELECT SK_ID_CURR, TARGET,
  CAST(({_pos_sql('t', 'SK_ID_CURR', 1001, 'TARGET')}) % 5 AS INTEGER) AS fold FROM ({D.APP_TRAIN_SQL}) t""")
def stratified_kfold(spark, sf):
    """5 folds with the label's classes spread evenly over the folds."""
    t = D.app_train(spark, sf).select("SK_ID_CURR", "TARGET")
    return S.stratified_kfold(t, "SK_ID_CURR", "TARGET", 5, seed=1001)


NULL_LABEL_SQL = f"SELECT SK_ID_CURR, NULLIF(c_nationkey % 3, 2) AS y FROM ({D.APP_TRAIN_SQL}) t"


@register("stratified_null_label", f"""SELECT SK_ID_CURR, CAST(y AS BIGINT) AS y,
  CAST(({_pos_sql('t', 'SK_ID_CURR', 1001, 'y')}) % 5 AS INTEGER) AS fold FROM ({NULL_LABEL_SQL}) t""")
def stratified_null_label(spark, sf):
    """Rows whose label is missing are a class of their own: none is lost."""
    t = D.app_train(spark, sf).select("SK_ID_CURR", F.nullif(F.col("c_nationkey") % 3, F.lit(2)).alias("y"))
    return S.stratified_kfold(t, "SK_ID_CURR", "y", 5, seed=1001)


# -- metrics on fixed scores ------------------------------------------------------------

LABEL_SQL = "CAST(l_returnflag = 'R' AS INTEGER)"
SCORES = {"discount": ("l_discount", 0.05), "tax": ("l_tax", 0.04), "quantity": ("l_quantity / 50.0", 0.5)}


def _scored(spark, sf):
    li = D.read(spark, sf, "lineitem")
    cols = [F.col("l_linestatus"), (F.col("l_returnflag") == "R").cast("int").alias("label")]
    for name, (expr, thr) in SCORES.items():
        s = F.expr(expr)
        cols += [s.alias(f"score_{name}"), (s >= thr).cast("int").alias(f"pred_{name}")]
    return li.select(*cols)


def _scored_sql():
    cols = [f"l_linestatus, {LABEL_SQL} AS label"]
    for name, (expr, thr) in SCORES.items():
        cols.append(f"{expr} AS score_{name}, CAST({expr} >= {thr} AS INTEGER) AS pred_{name}")
    return f"SELECT {', '.join(cols)} FROM lineitem"


@register("confusion_matrix", f"""WITH s AS ({_scored_sql()}),
grid AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) g(label, prediction)),
c AS (SELECT label, pred_discount AS prediction, COUNT(*) AS n FROM s GROUP BY 1, 2)
SELECT grid.label, grid.prediction, CAST(COALESCE(c.n, 0) AS BIGINT) AS n
FROM grid LEFT JOIN c ON grid.label = c.label AND grid.prediction = c.prediction""")
def confusion_matrix(spark, sf):
    """2x2 counts (zero cells included) of label vs thresholded score."""
    return M.confusion_matrix(_scored(spark, sf), "label", "pred_discount")


@register("accuracy", O.final_select(
    f"SELECT AVG(CAST(label = pred_discount AS DOUBLE)) AS accuracy FROM ({_scored_sql()}) s",
    [("accuracy", "double")]))
def accuracy(spark, sf):
    return finalize(M.accuracy(_scored(spark, sf), "label", "pred_discount"))


def _auc_sql(score: str, by: str | None = None, src: str | None = None) -> str:
    """AUC by the rank formula (average ranks for ties)."""
    src = src or f"({_scored_sql()}) s0"
    part = f"PARTITION BY {by}" if by else ""
    g = f"{by}, " if by else ""
    return f"""SELECT {g}CASE WHEN SUM(label) > 0 AND SUM(1 - label) > 0 THEN
  (SUM(CASE WHEN label = 1 THEN r END) - SUM(label) * (SUM(label) + 1) / 2.0)
  / (CAST(SUM(label) AS DOUBLE) * SUM(1 - label)) END AS auc
FROM (SELECT {g}label, (rank() OVER ({part} ORDER BY {score}) +
      (COUNT(*) OVER ({part + ',' if part else 'PARTITION BY'} {score}) - 1) / 2.0) AS r FROM {src}) ranked
{('GROUP BY ' + by) if by else ''}"""


@register("roc_auc", O.final_select(
    _auc_sql("score_discount", "l_linestatus"), [("l_linestatus", "string"), ("auc", "double")]))
def roc_auc(spark, sf):
    """Exact AUC per group, with heavy score ties (discounts take 11 values)."""
    return finalize(M.roc_auc(_scored(spark, sf), "label", "score_discount", by="l_linestatus"))


INF_SQL = f"""SELECT NULLIF(l_linestatus, 'O') AS l_linestatus, {LABEL_SQL} AS label,
  {O.ieee_div_sql('l_discount - 0.05', 'l_tax')} AS score FROM lineitem"""


@register("roc_auc_null_group", O.final_select(
    _auc_sql("score", "l_linestatus", f"(SELECT * FROM ({INF_SQL}) i0 WHERE score IS NOT NULL) i"),
    [("l_linestatus", "string"), ("auc", "double")]))
def roc_auc_null_group(spark, sf):
    """AUC of scores with infinities (x / 0), by a group that is missing for some rows."""
    li = D.read(spark, sf, "lineitem").select(
        F.nullif("l_linestatus", F.lit("O")).alias("l_linestatus"), (F.col("l_returnflag") == "R").cast("int").alias("label"),
        ieee_div(F.col("l_discount") - 0.05, F.col("l_tax")).alias("score"))
    return finalize(M.roc_auc(li, "label", "score", by="l_linestatus"))


def _compare_sql():
    parts = []
    for name in SCORES:
        parts.append(f"SELECT 'AUC' AS metric, '{name}' AS variant, auc AS value FROM ({_auc_sql('score_' + name)}) a")
        parts.append(f"SELECT 'accuracy', '{name}', AVG(CAST(label = pred_{name} AS DOUBLE)) FROM ({_scored_sql()}) s")
    pivot = ", ".join(f"MAX(CASE WHEN variant = '{n}' THEN value END) AS {n}" for n in SCORES)
    sql = f"SELECT metric, {pivot} FROM ({' UNION ALL '.join(parts)}) m GROUP BY metric"
    return O.final_select(sql, [("metric", "string")] + [(n, "double") for n in SCORES])


@register("model_compare", _compare_sql())
def model_compare(spark, sf):
    """Metric x variant table (AUC and accuracy of three scores)."""
    # one row per (line, variant): every metric is one grouped pass over
    # the scored rows instead of one pass per variant
    s = _scored(spark, sf).select("label", F.inline(F.array(*[
        F.struct(F.lit(n).alias("variant"), F.col(f"score_{n}").cast("double").alias("score"),
                 F.col(f"pred_{n}").alias("pred")) for n in SCORES])))
    auc = M.roc_auc(s, "label", "score", by="variant").select(
        F.lit("AUC").alias("metric"), "variant", F.col("auc").alias("value"))
    acc = M.accuracy(s, "label", "pred", by="variant").select(
        F.lit("accuracy").alias("metric"), "variant", F.col("accuracy").alias("value"))
    return finalize(M.model_compare(auc.unionByName(acc), list(SCORES)))


IMP_SQL = f"""SELECT 'supp_' || CAST(l_suppkey AS VARCHAR) AS feature,
  CAST({portable_hash_sql('l_orderkey', seed=1001)} % 5 AS INTEGER) AS fold, SUM(l_quantity) AS importance
FROM lineitem GROUP BY 1, 2"""


@register("topk_features", O.final_select(f"""WITH imp AS ({IMP_SQL}),
top AS (SELECT feature FROM (SELECT feature, AVG(importance) AS m FROM imp GROUP BY feature)
        ORDER BY m DESC, feature ASC LIMIT 10)
SELECT feature, fold, importance FROM imp WHERE feature IN (SELECT feature FROM top)""",
    [("feature", "string"), ("fold", "int"), ("importance", "double")]))
def topk_features(spark, sf):
    """Top 10 'features' by mean per-fold importance, with their per-fold rows."""
    li = D.read(spark, sf, "lineitem")
    imp = (li.groupBy(F.concat(F.lit("supp_"), F.col("l_suppkey").cast("string")).alias("feature"),
                      (portable_hash("l_orderkey", seed=1001) % 5).cast("int").alias("fold"))
           .agg(F.sum("l_quantity").alias("importance")))
    _, rows = M.top_features(imp, 10)
    return finalize(rows)
