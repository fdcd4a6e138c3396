"""The driver's test tables cast in the reference's roles.

``customer`` plays the applications, ``orders`` the external loans
(bureau) and the earlier applications, ``lineitem`` the loan-month
history and, joined to its order, the instalment payments; ``events``
plays the point-of-sale months and the card months. Keys are renamed
to the reference's key names so the pipelines run with their default
keys; other columns keep their own names.

Every view is given twice, as a Spark DataFrame and as the DuckDB SQL
that the oracle queries use, so the two stay side by side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.exprs import qcol

# Fixed values of the driver data used by the views: reference day for
# day counts, the hold-out segment, and the priority read as "missing".
REF_DATE = "2002-01-01"
TEST_SEGMENT = "HOUSEHOLD"
MISSING_PRIORITY = "4-NOT SPECIFIED"

# Category domains of the driver tables (sorted), for the SQL oracle.
DOMAINS = {
    "l_returnflag": ["A", "N", "R"],
    "l_linestatus": ["F", "O"],
    "o_orderstatus": ["F", "O", "P"],
    "o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"],
    "event_type": ["click", "error", "purchase", "signup", "view"],
    "c_mktsegment": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from riskloom.plans.catalog import read_scope
    path = f"{sf_dir}/{name}.parquet"
    scope = read_scope()
    if scope is None:
        return spark.read.parquet(path)
    key = (id(spark), path)
    if key not in scope:
        scope[key] = spark.read.parquet(path)
    return scope[key]


def days(col: str):
    """Whole days from the reference date (negative = before), bigint."""
    return F.datediff(F.to_date(qcol(col)), F.lit(REF_DATE).cast("date")).cast("bigint")


def days_sql(col: str) -> str:
    return f"CAST(CAST({col} AS DATE) - DATE '{REF_DATE}' AS BIGINT)"


# -- applications ------------------------------------------------------------

def app_train(spark, sf) -> DataFrame:
    c = read(spark, sf, "customer")
    return c.where(F.col("c_mktsegment") != TEST_SEGMENT).select(
        F.col("c_custkey").alias("SK_ID_CURR"), "c_mktsegment",
        F.col("c_nationkey").cast("bigint").alias("c_nationkey"), "c_acctbal",
        (F.col("c_acctbal") < 0).cast("double").alias("TARGET"))


def app_test(spark, sf) -> DataFrame:
    c = read(spark, sf, "customer")
    return c.where(F.col("c_mktsegment") == TEST_SEGMENT).select(
        F.col("c_custkey").alias("SK_ID_CURR"), "c_mktsegment",
        F.col("c_nationkey").cast("bigint").alias("c_nationkey"), "c_acctbal")


APP_TRAIN_SQL = f"""SELECT c_custkey AS SK_ID_CURR, c_mktsegment, CAST(c_nationkey AS BIGINT) AS c_nationkey,
  c_acctbal, CAST(c_acctbal < 0 AS DOUBLE) AS TARGET FROM customer WHERE c_mktsegment <> '{TEST_SEGMENT}'"""
APP_TEST_SQL = f"""SELECT c_custkey AS SK_ID_CURR, c_mktsegment, CAST(c_nationkey AS BIGINT) AS c_nationkey,
  c_acctbal, CAST(NULL AS DOUBLE) AS TARGET FROM customer WHERE c_mktsegment = '{TEST_SEGMENT}'"""

# -- external loans and their monthly history --------------------------------

def bureau(spark, sf) -> DataFrame:
    o = read(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("SK_ID_BUREAU"), F.col("o_custkey").alias("SK_ID_CURR"),
                    "o_orderstatus",
                    F.nullif("o_orderpriority", F.lit(MISSING_PRIORITY)).alias("o_orderpriority"),
                    "o_totalprice", days("o_orderdate").alias("DAYS_ORDER"))


BUREAU_SQL = f"""SELECT o_orderkey AS SK_ID_BUREAU, o_custkey AS SK_ID_CURR, o_orderstatus,
  NULLIF(o_orderpriority, '{MISSING_PRIORITY}') AS o_orderpriority, o_totalprice,
  {days_sql('o_orderdate')} AS DAYS_ORDER FROM orders"""


def bureau_balance(spark, sf) -> DataFrame:
    li = read(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("SK_ID_BUREAU"), "l_quantity", "l_returnflag",
                     "l_linestatus")


BB_SQL = """SELECT l_orderkey AS SK_ID_BUREAU, l_quantity, l_returnflag, l_linestatus FROM lineitem"""

# -- earlier applications ------------------------------------------------------

def previous(spark, sf) -> DataFrame:
    o = read(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("SK_ID_PREV"), F.col("o_custkey").alias("SK_ID_CURR"),
                    "o_orderstatus",
                    F.nullif("o_orderpriority", F.lit(MISSING_PRIORITY)).alias("o_orderpriority"),
                    "o_totalprice", days("o_orderdate").alias("DAYS_DECISION"))


PREV_SQL = f"""SELECT o_orderkey AS SK_ID_PREV, o_custkey AS SK_ID_CURR, o_orderstatus,
  NULLIF(o_orderpriority, '{MISSING_PRIORITY}') AS o_orderpriority, o_totalprice,
  {days_sql('o_orderdate')} AS DAYS_DECISION FROM orders"""

# -- monthly point-of-sale / card history from events --------------------------

def events_history(spark, sf) -> DataFrame:
    e = read(spark, sf, "events")
    return e.select(F.col("event_id").alias("SK_ID_PREV"), F.col("user_id").alias("SK_ID_CURR"),
                    days("ts").alias("DAYS_EVENT"), "value", "event_type")


EVENTS_SQL = f"""SELECT event_id AS SK_ID_PREV, user_id AS SK_ID_CURR, {days_sql('ts')} AS DAYS_EVENT,
  value, event_type FROM events"""

# -- instalment payments: one line item = one instalment; a returned line
#    counts as unpaid (payment 0), the ship date as the payment day ---------

def installments(spark, sf) -> DataFrame:
    li = read(spark, sf, "lineitem")
    o = read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select(F.col("o_custkey").alias("SK_ID_CURR"),
                    F.col("l_linenumber").cast("bigint").alias("NUM_INSTALMENT_VERSION"),
                    F.col("l_extendedprice").alias("AMT_INSTALMENT"),
                    F.when(F.col("l_returnflag") == "R", F.lit(0.0))
                    .otherwise(F.col("l_extendedprice")).alias("AMT_PAYMENT"),
                    days("o_orderdate").alias("DAYS_INSTALMENT"),
                    days("l_shipdate").alias("DAYS_ENTRY_PAYMENT"))


INS_SQL = f"""SELECT o_custkey AS SK_ID_CURR, CAST(l_linenumber AS BIGINT) AS NUM_INSTALMENT_VERSION,
  l_extendedprice AS AMT_INSTALMENT,
  CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE l_extendedprice END AS AMT_PAYMENT,
  {days_sql('o_orderdate')} AS DAYS_INSTALMENT, {days_sql('l_shipdate')} AS DAYS_ENTRY_PAYMENT
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""

# -- pipeline specs for these views --------------------------------------------

APP_SPEC = dict(drop_equal=("c_mktsegment", "XNA"), factorize_cols=["c_mktsegment"],
                order_by="SK_ID_CURR", sentinel_cols=[],
                ratios={"ACCTBAL_PER_NATION": ("c_acctbal", "c_nationkey")})
BB_NUM = {"l_quantity": ["min", "max", "size"]}
BUREAU_NUM = {
    "DAYS_ORDER": ["min", "max", "mean", "var"],
    "o_totalprice": ["max", "mean", "sum"],
    "l_quantity_MIN": ["min"],
    "l_quantity_MAX": ["max"],
    "l_quantity_SIZE": ["mean", "sum"],
}
BUREAU_SPEC = dict(bb_num_aggs=BB_NUM, num_aggs=BUREAU_NUM, status_col="o_orderstatus",
                   subsets=[("ACTIVE_", "O"), ("CLOSED_", "F")])
PREV_NUM = {
    "o_totalprice": ["min", "max", "mean"],
    "DAYS_DECISION": ["min", "max", "mean"],
    "PRICE_PER_DAY": ["min", "max", "mean", "var"],
}
PREV_SPEC = dict(sentinel_cols=[], ratios={"PRICE_PER_DAY": ("o_totalprice", "DAYS_DECISION")},
                 num_aggs=PREV_NUM, status_col="o_orderstatus",
                 subsets=[("APPROVED_", "F"), ("REFUSED_", "P")])
POS_NUM = {"DAYS_EVENT": ["max", "mean", "size"], "value": ["max", "mean"]}

BRANDS = sorted(f"Brand#{i}" for i in range(1, 26))
PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
