"""Single-operator queries: scalars, filters, encodings, joins, sets,
counts and the data audit, each on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions.exprs import (clamp_zero, conditional_value, ieee_div,
                                      not_equal_keep_null, replace_inf, sentinel_null)
from riskloom.operators import assemble as A
from riskloom.operators import profile as P
from riskloom.operators.aggspec import aggregate, compile_spec
from riskloom.operators.encode import factorize, one_hot
from riskloom.plans import credit as C
from riskloom.plans import driver as D
from riskloom.plans.credit import MAX_ONE_HOT
from riskloom.plans import oracle as O
from riskloom.plans.catalog import finalize, register
from riskloom.plans.q_features import cc_features, pos_features
from riskloom.sources.store import stored

# -- scalars and filters ------------------------------------------------------

RATIO_SQL = f"""SELECT c_custkey AS SK_ID_CURR,
  {O.ieee_div_sql('c_acctbal', 'c_nationkey')} AS ACCTBAL_PER_NATION,
  {O.ieee_div_sql('-c_acctbal', 'c_nationkey')} AS NEG_ACCTBAL_PER_NATION,
  {O.ieee_div_sql('c_nationkey', 'c_nationkey')} AS NATION_SELF_RATIO FROM customer"""
RATIO_COLS = [("SK_ID_CURR", "bigint"), ("ACCTBAL_PER_NATION", "double"),
              ("NEG_ACCTBAL_PER_NATION", "double"), ("NATION_SELF_RATIO", "double")]


def _ratios(spark, sf):
    c = D.read(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("SK_ID_CURR"),
                    ieee_div("c_acctbal", "c_nationkey").alias("ACCTBAL_PER_NATION"),
                    ieee_div(-F.col("c_acctbal"), F.col("c_nationkey")).alias("NEG_ACCTBAL_PER_NATION"),
                    ieee_div("c_nationkey", "c_nationkey").alias("NATION_SELF_RATIO"))


@register("ieee_ratio", O.final_select(RATIO_SQL, RATIO_COLS))
def ieee_ratio(spark, sf):
    """x/0 -> +-inf, 0/0 -> NULL (nation key 0 gives both)."""
    return finalize(_ratios(spark, sf))


def _replace_inf_sql():
    cols = ", ".join(f"CASE WHEN {c} = CAST('inf' AS DOUBLE) THEN 1e9 WHEN {c} = CAST('-inf' AS DOUBLE) "
                     f"THEN -1e9 ELSE {c} END AS {c}" for c, _ in RATIO_COLS[1:])
    return O.final_select(f"SELECT SK_ID_CURR, {cols} FROM ({RATIO_SQL}) r", RATIO_COLS)


@register("replace_inf", _replace_inf_sql())
def replace_inf_q(spark, sf):
    r = _ratios(spark, sf)
    return finalize(r.select("SK_ID_CURR", *[replace_inf(c).alias(c) for c, _ in RATIO_COLS[1:]]))


@register("sentinel_null", O.final_select(
    "SELECT p_partkey, CAST(NULLIF(p_size, 50) AS BIGINT) AS p_size, p_retailprice FROM part",
    [("p_partkey", "bigint"), ("p_size", "bigint"), ("p_retailprice", "double")]))
def sentinel_null_q(spark, sf):
    """Sentinel value -> NULL (here size 50 read as 'unknown')."""
    p = D.read(spark, sf, "part")
    return finalize(p.select("p_partkey", sentinel_null(F.col("p_size").cast("bigint"), 50).alias("p_size"),
                             "p_retailprice"))


@register("clamp_zero", O.final_select(
    f"""SELECT SK_ID_CURR, NUM_INSTALMENT_VERSION, DAYS_INSTALMENT, DAYS_ENTRY_PAYMENT,
  {O.clamp_sql('(DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT)')} AS DPD,
  {O.clamp_sql('(DAYS_INSTALMENT - DAYS_ENTRY_PAYMENT)')} AS DBD,
  CASE WHEN NULLIF(AMT_PAYMENT, 0.0) - 50000.0 > 0 THEN NULLIF(AMT_PAYMENT, 0.0) - 50000.0 ELSE 0.0 END
    AS PAYMENT_OVER_50K FROM ({D.INS_SQL}) i""",
    [("SK_ID_CURR", "bigint"), ("NUM_INSTALMENT_VERSION", "bigint"), ("DAYS_INSTALMENT", "bigint"),
     ("DAYS_ENTRY_PAYMENT", "bigint"), ("DPD", "bigint"), ("DBD", "bigint"),
     ("PAYMENT_OVER_50K", "double")]))
def clamp_zero_q(spark, sf):
    """x if x > 0 else 0, with a missing x giving 0 (unpaid lines)."""
    i = D.installments(spark, sf)
    pay = F.nullif(F.col("AMT_PAYMENT"), F.lit(0.0))
    return finalize(i.select("SK_ID_CURR", "NUM_INSTALMENT_VERSION", "DAYS_INSTALMENT", "DAYS_ENTRY_PAYMENT",
                             clamp_zero(F.col("DAYS_ENTRY_PAYMENT") - F.col("DAYS_INSTALMENT")).alias("DPD"),
                             clamp_zero(F.col("DAYS_INSTALMENT") - F.col("DAYS_ENTRY_PAYMENT")).alias("DBD"),
                             clamp_zero(pay - 50000.0).alias("PAYMENT_OVER_50K")))


@register("not_equal_keep_null", O.final_select(
    f"SELECT SK_ID_BUREAU, o_orderpriority FROM ({D.BUREAU_SQL}) b "
    "WHERE o_orderpriority IS DISTINCT FROM '1-URGENT'",
    [("SK_ID_BUREAU", "bigint"), ("o_orderpriority", "string")]))
def not_equal_keep_null_q(spark, sf):
    """``!=`` that keeps rows whose value is missing."""
    b = D.bureau(spark, sf)
    return b.where(not_equal_keep_null("o_orderpriority", "1-URGENT")).select("SK_ID_BUREAU", "o_orderpriority")


APP_UNION_SQL = f"{D.APP_TRAIN_SQL} UNION ALL {D.APP_TEST_SQL}"


@register("null_split", O.final_select(
    f"""SELECT SK_ID_CURR, 'train' AS part FROM ({APP_UNION_SQL}) u WHERE TARGET IS NOT NULL
UNION ALL SELECT SK_ID_CURR, 'test' AS part FROM ({APP_UNION_SQL}) u WHERE TARGET IS NULL""",
    [("SK_ID_CURR", "bigint"), ("part", "string")]))
def null_split(spark, sf):
    """Labelled rows train, unlabelled rows test (filters on the label's null-ness)."""
    u = A.union_by_name([D.app_train(spark, sf), D.app_test(spark, sf)])
    train = u.where(F.col("TARGET").isNotNull()).select("SK_ID_CURR", F.lit("train").alias("part"))
    test = u.where(F.col("TARGET").isNull()).select("SK_ID_CURR", F.lit("test").alias("part"))
    return train.unionByName(test)


@register("conditional_weight", O.final_select(
    f"""SELECT SK_ID_CURR, TARGET, CASE WHEN TARGET = 1 THEN 10.0 ELSE 1.0 END AS weight
FROM ({D.APP_TRAIN_SQL}) t""", [("SK_ID_CURR", "bigint"), ("TARGET", "double"), ("weight", "double")]))
def conditional_weight(spark, sf):
    """Row weight by label: defaults (positives) weigh 10, others 1."""
    t = D.app_train(spark, sf)
    return finalize(t.select("SK_ID_CURR", "TARGET",
                             conditional_value(F.col("TARGET") == 1, 10.0, 1.0).alias("weight")))


# -- encodings ------------------------------------------------------------------

def _one_hot_sql():
    flags, cols = [], [("p_partkey", "bigint"), ("p_size", "bigint"), ("p_retailprice", "double")]
    for c, vals in (("p_brand", D.BRANDS), ("p_type", D.PART_TYPES)):
        for v in vals:
            n = f"{c}_{v}"
            flags.append(f"{O.flag_sql(c, v)} AS {O.q(n)}")
            cols.append((n, "int"))
    sql = f"SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, p_retailprice, {', '.join(flags)} FROM part"
    return O.final_select(sql, cols)


@register("one_hot", _one_hot_sql())
def one_hot_q(spark, sf):
    """One-hot of every string column, no missing flag (the free-text
    name column is left out, as a categorical list would)."""
    p = D.read(spark, sf, "part").select("p_partkey", F.col("p_size").cast("bigint").alias("p_size"),
                                         "p_retailprice", "p_brand", "p_type")
    df, _ = one_hot(p, None, nan_as_category=False, max_values=MAX_ONE_HOT)
    return finalize(df)


def _one_hot_nan_sql(sanitized=False):
    flags, cols = [], [("SK_ID_BUREAU", "bigint"), ("SK_ID_CURR", "bigint")]
    for v in list(D.DOMAINS["o_orderpriority"]) + [None]:
        n = f"o_orderpriority_{v if v is not None else 'nan'}"
        n = O.sanitize(n) if sanitized else n
        flags.append(f"{O.flag_sql('o_orderpriority', v)} AS {O.q(n)}")
        cols.append((n, "int"))
    sql = f"SELECT SK_ID_BUREAU, SK_ID_CURR, {', '.join(flags)} FROM ({D.BUREAU_SQL}) b"
    return O.final_select(sql, cols)


@register("one_hot_nan", _one_hot_nan_sql())
def one_hot_nan(spark, sf):
    """One-hot with the extra ``_nan`` flag for missing values."""
    b = D.bureau(spark, sf).select("SK_ID_BUREAU", "SK_ID_CURR", "o_orderpriority")
    df, _ = one_hot(b, ["o_orderpriority"], nan_as_category=True, max_values=MAX_ONE_HOT)
    return df


@register("sanitize_names", _one_hot_nan_sql(sanitized=True))
def sanitize_names_q(spark, sf):
    """Flags named after values with '-' and ' ' -> names of [A-Za-z0-9_] only."""
    return A.sanitize_names(one_hot_nan(spark, sf))


@register("factorize", O.final_select(
    f"""WITH b AS ({D.BUREAU_SQL}),
fs AS (SELECT o_orderpriority AS v, MIN(SK_ID_BUREAU) AS o FROM b WHERE o_orderpriority IS NOT NULL GROUP BY 1),
fs2 AS (SELECT o_orderstatus AS v, MIN(SK_ID_BUREAU) AS o FROM b WHERE o_orderstatus IS NOT NULL GROUP BY 1),
c1 AS (SELECT v, row_number() OVER (ORDER BY o) - 1 AS code FROM fs),
c2 AS (SELECT v, row_number() OVER (ORDER BY o) - 1 AS code FROM fs2)
SELECT b.SK_ID_BUREAU, COALESCE(c1.code, -1) AS o_orderpriority, COALESCE(c2.code, -1) AS o_orderstatus
FROM b LEFT JOIN c1 ON b.o_orderpriority = c1.v LEFT JOIN c2 ON b.o_orderstatus = c2.v""",
    [("SK_ID_BUREAU", "bigint"), ("o_orderpriority", "bigint"), ("o_orderstatus", "bigint")]))
def factorize_q(spark, sf):
    """Integer codes in order of first appearance by loan id; missing -> -1."""
    b = D.bureau(spark, sf).select("SK_ID_BUREAU", "o_orderpriority", "o_orderstatus")
    return factorize(b, ["o_orderpriority", "o_orderstatus"], order_by="SK_ID_BUREAU")


# -- joins and sets -------------------------------------------------------------

def _chain_sql():
    from riskloom.plans.q_features import cc_sql, pos_sql
    (ps, pc), (cs, cc) = pos_sql(), cc_sql()
    sel = [f"pos.{O.q(n)}" for n, _ in pc[1:]] + [f"cc.{O.q(n)}" for n, _ in cc[1:]]
    sql = f"""WITH pos AS ({ps}), cc AS ({cs})
SELECT c.c_custkey AS SK_ID_CURR, c.c_acctbal, {', '.join(sel)} FROM customer c
LEFT JOIN pos ON c.c_custkey = pos.SK_ID_CURR LEFT JOIN cc ON c.c_custkey = cc.SK_ID_CURR"""
    return O.final_select(sql, [("SK_ID_CURR", "bigint"), ("c_acctbal", "double")] + pc[1:] + cc[1:])


@register("left_join_chain", _chain_sql())
def left_join_chain(spark, sf):
    """Applicants left-joined with two per-applicant roll-ups; applicants
    without history keep NULL features (counts included)."""
    base = D.read(spark, sf, "customer").select(F.col("c_custkey").alias("SK_ID_CURR"), "c_acctbal")
    return finalize(A.left_join_chain(base, [pos_features(spark, sf), cc_features(spark, sf)], "SK_ID_CURR"))


CLIENT_COLS = ["SK_ID_CURR", "c_mktsegment", "c_nationkey", "c_acctbal", "TARGET"]


@register("semi_join_extract", O.final_select(
    f"""SELECT u.SK_ID_CURR, u.c_mktsegment, u.c_nationkey, u.c_acctbal, u.TARGET FROM ({APP_UNION_SQL}) u
WHERE u.SK_ID_CURR IN (SELECT user_id FROM events)""",
    [("SK_ID_CURR", "bigint"), ("c_mktsegment", "string"), ("c_nationkey", "bigint"),
     ("c_acctbal", "double"), ("TARGET", "double")]))
def semi_join_extract(spark, sf):
    """Client extract (C8): named client columns of every applicant that
    has a row in the card-history feature table (a left semi join)."""
    out = C.client_extract(D.app_train(spark, sf), D.app_test(spark, sf), cc_features(spark, sf), CLIENT_COLS)
    return finalize(out)


@register("union_missing_cols", O.final_select(
    APP_UNION_SQL, [("SK_ID_CURR", "bigint"), ("c_mktsegment", "string"), ("c_nationkey", "bigint"),
                    ("c_acctbal", "double"), ("TARGET", "double")]))
def union_missing_cols(spark, sf):
    """Train (with TARGET) and test (without) unioned by name."""
    return finalize(A.union_by_name([D.app_train(spark, sf), D.app_test(spark, sf)]))


# -- counts ------------------------------------------------------------------------

@register("group_counts", O.final_select(
    f"""SELECT SK_ID_CURR, COUNT(*) AS POS_COUNT, COUNT(*) AS POS_DAYS_EVENT_SIZE,
  COUNT(CASE WHEN event_type = 'purchase' THEN 1 END) AS POS_PURCHASE_COUNT
FROM ({D.EVENTS_SQL}) e WHERE SK_ID_CURR IS NOT NULL GROUP BY SK_ID_CURR""",
    [("SK_ID_CURR", "bigint"), ("POS_COUNT", "bigint"), ("POS_DAYS_EVENT_SIZE", "bigint"),
     ("POS_PURCHASE_COUNT", "bigint")]))
def group_counts(spark, sf):
    """Row count per applicant as a named column (equal to ``size``)."""
    e = D.events_history(spark, sf)
    exprs = [F.count(F.lit(1)).alias("POS_COUNT")] + compile_spec(e.schema, {"DAYS_EVENT": ["size"]}, "POS_")
    exprs.append(F.count_if(F.col("event_type") == "purchase").alias("POS_PURCHASE_COUNT"))
    return aggregate(e, "SK_ID_CURR", exprs)


@register("nunique_agg", O.final_select(
    """SELECT l_orderkey, COUNT(DISTINCT l_suppkey) AS l_suppkey_NUNIQUE,
  COUNT(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_partkey END) AS returned_part_NUNIQUE,
  COUNT(*) AS l_suppkey_SIZE FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY l_orderkey""",
    [("l_orderkey", "bigint"), ("l_suppkey_NUNIQUE", "bigint"), ("returned_part_NUNIQUE", "bigint"),
     ("l_suppkey_SIZE", "bigint")]))
def nunique_agg(spark, sf):
    """Distinct non-missing values per group; 0 when all are missing."""
    li = D.read(spark, sf, "lineitem").select(
        "l_orderkey", "l_suppkey",
        F.when(F.col("l_returnflag") == "R", F.col("l_partkey")).alias("returned_part"))
    return aggregate(li, "l_orderkey",
                     compile_spec(li.schema, {"l_suppkey": ["nunique", "size"], "returned_part": ["nunique"]}))


# -- data audit --------------------------------------------------------------------

AUDIT_SQL = f"""SELECT u.*, {O.ieee_div_sql('u.c_acctbal', 'u.c_nationkey')} AS ACCTBAL_PER_NATION
FROM ({APP_UNION_SQL}) u"""
AUDIT_COLS = [("SK_ID_CURR", "bigint"), ("c_mktsegment", "string"), ("c_nationkey", "bigint"),
              ("c_acctbal", "double"), ("TARGET", "double"), ("ACCTBAL_PER_NATION", "double")]


def _audit_table(spark, sf):
    u = A.union_by_name([D.app_train(spark, sf), D.app_test(spark, sf)])
    return u.withColumn("ACCTBAL_PER_NATION", ieee_div("c_acctbal", "c_nationkey"))


def _null_terms():
    return " + ".join(f"COUNT(*) FILTER (WHERE {O.q(n)} IS NULL" + (f" OR isnan({O.q(n)})" if t == "double" else "")
                      + ")" for n, t in AUDIT_COLS)


@register("null_count", f"SELECT CAST({_null_terms()} AS BIGINT) AS null_cells FROM ({AUDIT_SQL}) a")
def null_count_q(spark, sf):
    """Missing cells over the whole applicant table."""
    return P.null_count(_audit_table(spark, sf))


@register("inf_count", "SELECT CAST(" + " + ".join(
    f"COUNT(*) FILTER (WHERE {O.q(n)} IN (CAST('inf' AS DOUBLE), CAST('-inf' AS DOUBLE)))"
    for n, t in AUDIT_COLS if t == "double") + f" AS BIGINT) AS inf_cells FROM ({AUDIT_SQL}) a")
def inf_count_q(spark, sf):
    """Infinite cells over the numeric columns."""
    return P.inf_count(_audit_table(spark, sf))


SPARK_TYPE = {"bigint": "bigint", "string": "string", "double": "double"}


@register("column_profile", " UNION ALL ".join(
    f"SELECT '{n}' AS column_name, '{SPARK_TYPE[t]}' AS data_type, "
    f"COUNT(*) FILTER (WHERE {O.q(n)} IS NOT NULL" + (f" AND NOT isnan({O.q(n)})" if t == "double" else "")
    + f") AS non_null FROM ({AUDIT_SQL}) a" for n, t in AUDIT_COLS))
def column_profile_q(spark, sf):
    """(column, type, non-null count) per column."""
    return P.column_profile(_audit_table(spark, sf))


@register("audit_observed", " UNION ALL ".join(
    f"SELECT '{n}' AS column_name, COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE {O.q(n)} IS NOT NULL"
    + (f" AND NOT isnan({O.q(n)})" if t == "double" else "") + ") AS non_null, "
    + (f"COUNT(*) FILTER (WHERE isinf({O.q(n)}))" if t == "double" else "CAST(0 AS BIGINT)")
    + f" AS infinite FROM ({AUDIT_SQL}) a" for n, t in AUDIT_COLS))
def audit_observed(spark, sf):
    """The audit's facts per column, gathered while the table is written (no scan of their own)."""
    table, seen = P.observed(_audit_table(spark, sf))
    stored(table)
    facts = seen.observation.get
    rows = [(f.name, facts["rows"], facts[f"c{i}"], facts.get(f"i{i}", 0)) for i, f in enumerate(seen.fields)]
    return spark.createDataFrame(rows, "column_name string, n_rows long, non_null long, infinite long")


@register("value_counts", """SELECT CAST(c_acctbal < 0 AS DOUBLE) AS TARGET, COUNT(*) AS n
FROM customer WHERE c_mktsegment <> 'HOUSEHOLD' GROUP BY 1""")
def value_counts_q(spark, sf):
    """Class balance of the label."""
    return P.value_counts(D.app_train(spark, sf), "TARGET")


@register("table_shape", "SELECT COUNT(*) AS n_rows, CAST(11 AS BIGINT) AS n_cols FROM lineitem")
def table_shape_q(spark, sf):
    """(rows, columns) of a table."""
    return P.table_shape(D.read(spark, sf, "lineitem"))


@register("preview", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def preview_q(spark, sf):
    """The first rows in a stated order."""
    o = D.read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return A.preview(o.withColumn("neg", -F.col("o_totalprice")), 5, ["neg", "o_orderkey"]).drop("neg")
