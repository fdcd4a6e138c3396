"""Feature-building queries: roll-ups, shares, subsets, encodings,
joins and the composite pipelines on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators.aggspec import integer_spans
from riskloom.plans import credit as C
from riskloom.plans import driver as D
from riskloom.plans import oracle as O
from riskloom.plans.catalog import finalize, register

# -- SQL building blocks for the driver views --------------------------------

BB_TYPES = {"SK_ID_BUREAU": "bigint", "l_quantity": "double", "l_returnflag": "string",
            "l_linestatus": "string"}
BUREAU_TYPES = {"SK_ID_BUREAU": "bigint", "SK_ID_CURR": "bigint", "o_orderstatus": "string",
                "o_orderpriority": "string", "o_totalprice": "double", "DAYS_ORDER": "bigint"}


def bureau_sql() -> tuple[str, list[tuple[str, str]]]:
    """Two-level bureau roll-up in the reference's unfused form."""
    dom = D.DOMAINS
    lvl1 = O.spec_sql(D.BB_NUM, BB_TYPES)
    lvl1 += O.share_sql("l_returnflag", dom["l_returnflag"])
    lvl1 += O.share_sql("l_linestatus", dom["l_linestatus"])
    share_names = [n for _, n, _ in lvl1[3:]]
    loan_types = {k: v for k, v in BUREAU_TYPES.items() if k != "SK_ID_BUREAU"}
    loan_types.update({n: t for _, n, t in lvl1})
    allg = O.spec_sql(D.BUREAU_NUM, loan_types, "BURO_")
    allg += O.share_sql("o_orderstatus", dom["o_orderstatus"], "BURO_")
    allg += O.share_sql("o_orderpriority", dom["o_orderpriority"], "BURO_")
    allg += O.spec_sql({n: ["mean"] for n in share_names}, loan_types, "BURO_")
    act = O.spec_sql(D.BUREAU_NUM, loan_types, "ACTIVE_")
    clo = O.spec_sql(D.BUREAU_NUM, loan_types, "CLOSED_")
    lvl1_cols = ", ".join(O.q(n) for _, n, _ in lvl1)
    sql = f"""WITH bb AS ({D.BB_SQL}), bureau AS ({D.BUREAU_SQL}),
lvl1 AS ({O.group_sql('bb', 'SK_ID_BUREAU', lvl1)}),
loans AS (SELECT b.SK_ID_CURR, b.o_orderstatus, b.o_orderpriority, b.o_totalprice, b.DAYS_ORDER, {lvl1_cols}
          FROM bureau b LEFT JOIN lvl1 ON b.SK_ID_BUREAU = lvl1.SK_ID_BUREAU),
allg AS ({O.group_sql('loans', 'SK_ID_CURR', allg)}),
act AS ({O.group_sql('loans', 'SK_ID_CURR', act, "o_orderstatus = 'O'")}),
clo AS ({O.group_sql('loans', 'SK_ID_CURR', clo, "o_orderstatus = 'F'")})
SELECT allg.*, {', '.join('act.' + O.q(n) for _, n, _ in act)}, {', '.join('clo.' + O.q(n) for _, n, _ in clo)}
FROM allg LEFT JOIN act ON allg.SK_ID_CURR = act.SK_ID_CURR LEFT JOIN clo ON allg.SK_ID_CURR = clo.SK_ID_CURR"""
    cols = [("SK_ID_CURR", "bigint")] + [(n, t) for _, n, t in allg + act + clo]
    return sql, cols


def bureau_features(spark, sf):
    return C.bureau_and_balance(D.bureau(spark, sf), D.bureau_balance(spark, sf), **D.BUREAU_SPEC)


# -- 1. two-level roll-up onto every applicant (minimum slice, entry()) -------

def _two_level_sql():
    inner, cols = bureau_sql()
    sql = f"""SELECT c.c_custkey AS SK_ID_CURR, {', '.join('f.' + O.q(n) for n, _ in cols[1:])}
FROM customer c LEFT JOIN ({inner}) f ON c.c_custkey = f.SK_ID_CURR"""
    return O.final_select(sql, cols)


@register("two_level_rollup", _two_level_sql())
def two_level_rollup(spark, sf):
    cust = D.read(spark, sf, "customer").select(F.col("c_custkey").alias("SK_ID_CURR"))
    return finalize(cust.join(bureau_features(spark, sf), "SK_ID_CURR", "left"))


# -- SQL for the other child roll-ups ----------------------------------------

PREV_TYPES = {"SK_ID_PREV": "bigint", "SK_ID_CURR": "bigint", "o_orderstatus": "string",
              "o_orderpriority": "string", "o_totalprice": "double", "DAYS_DECISION": "bigint",
              "PRICE_PER_DAY": "double"}
EV_TYPES = {"SK_ID_PREV": "bigint", "SK_ID_CURR": "bigint", "DAYS_EVENT": "bigint",
            "value": "double", "event_type": "string"}
INS_TYPES = {"SK_ID_CURR": "bigint", "NUM_INSTALMENT_VERSION": "bigint", "AMT_INSTALMENT": "double",
             "AMT_PAYMENT": "double", "DAYS_INSTALMENT": "bigint", "DAYS_ENTRY_PAYMENT": "bigint",
             "PAYMENT_PERC": "double", "PAYMENT_DIFF": "double", "DPD": "bigint", "DBD": "bigint"}


def prev_sql():
    dom = D.DOMAINS
    allp = O.spec_sql(D.PREV_NUM, PREV_TYPES, "PREV_")
    allp += O.share_sql("o_orderstatus", dom["o_orderstatus"], "PREV_")
    allp += O.share_sql("o_orderpriority", dom["o_orderpriority"], "PREV_")
    appr = O.spec_sql(D.PREV_NUM, PREV_TYPES, "APPROVED_")
    refu = O.spec_sql(D.PREV_NUM, PREV_TYPES, "REFUSED_")
    sql = f"""WITH p0 AS ({D.PREV_SQL}),
p AS (SELECT *, {O.ieee_div_sql('o_totalprice', 'DAYS_DECISION')} AS PRICE_PER_DAY FROM p0),
allp AS ({O.group_sql('p', 'SK_ID_CURR', allp)}),
appr AS ({O.group_sql('p', 'SK_ID_CURR', appr, "o_orderstatus = 'F'")}),
refu AS ({O.group_sql('p', 'SK_ID_CURR', refu, "o_orderstatus = 'P'")})
SELECT allp.*, {', '.join('appr.' + O.q(n) for _, n, _ in appr)}, {', '.join('refu.' + O.q(n) for _, n, _ in refu)}
FROM allp LEFT JOIN appr ON allp.SK_ID_CURR = appr.SK_ID_CURR LEFT JOIN refu ON allp.SK_ID_CURR = refu.SK_ID_CURR"""
    return sql, [("SK_ID_CURR", "bigint")] + [(n, t) for _, n, t in allp + appr + refu]


def pos_sql():
    items = O.spec_sql(D.POS_NUM, EV_TYPES, "POS_")
    items += O.share_sql("event_type", D.DOMAINS["event_type"], "POS_")
    items.append(("COUNT(*)", "POS_COUNT", "bigint"))
    sql = f"WITH ev AS ({D.EVENTS_SQL}) {O.group_sql('ev', 'SK_ID_CURR', items)}"
    return sql, [("SK_ID_CURR", "bigint")] + [(n, t) for _, n, t in items]


def ins_sql():
    items = O.spec_sql(C.INS_AGGS, INS_TYPES, "INSTAL_")
    items.append(("COUNT(*)", "INSTAL_COUNT", "bigint"))
    sql = f"""WITH i0 AS ({D.INS_SQL}),
ins AS (SELECT *, {O.ieee_div_sql('AMT_PAYMENT', 'AMT_INSTALMENT')} AS PAYMENT_PERC,
        AMT_INSTALMENT - AMT_PAYMENT AS PAYMENT_DIFF,
        {O.clamp_sql('(DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT)')} AS DPD,
        {O.clamp_sql('(DAYS_INSTALMENT - DAYS_ENTRY_PAYMENT)')} AS DBD FROM i0)
{O.group_sql('ins', 'SK_ID_CURR', items)}"""
    return sql, [("SK_ID_CURR", "bigint")] + [(n, t) for _, n, t in items]


def cc_sql():
    vals = D.DOMAINS["event_type"]
    flag_names = [f"event_type_{v}" for v in vals] + ["event_type_nan"]
    flags = ", ".join(f"{O.flag_sql('event_type', v)} AS {O.q(n)}"
                      for v, n in zip(list(vals) + [None], flag_names))
    types = {"DAYS_EVENT": "bigint", "value": "double", **{n: "int" for n in flag_names}}
    spec = {c: list(C.CC_FUNCS) for c in ["DAYS_EVENT", "value"] + flag_names}
    items = O.spec_sql(spec, types, "CC_") + [("COUNT(*)", "CC_COUNT", "bigint")]
    sql = f"""WITH ev AS ({D.EVENTS_SQL}),
cc AS (SELECT SK_ID_CURR, DAYS_EVENT, value, {flags} FROM ev)
{O.group_sql('cc', 'SK_ID_CURR', items)}"""
    return sql, [("SK_ID_CURR", "bigint")] + [(n, t) for _, n, t in items]


def app_sql():
    sql = f"""WITH u AS (SELECT *, 0 AS src FROM ({D.APP_TRAIN_SQL}) a UNION ALL SELECT *, 1 AS src FROM ({D.APP_TEST_SQL}) b),
f AS (SELECT * FROM u WHERE c_mktsegment IS DISTINCT FROM 'XNA'),
first_seen AS (SELECT c_mktsegment AS v, MIN((src, SK_ID_CURR)) AS o FROM f
               WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment),
codes AS (SELECT v, row_number() OVER (ORDER BY o) - 1 AS code FROM first_seen)
SELECT f.SK_ID_CURR, COALESCE(codes.code, -1) AS c_mktsegment, f.c_nationkey, f.c_acctbal, f.TARGET,
  {O.ieee_div_sql('f.c_acctbal', 'f.c_nationkey')} AS ACCTBAL_PER_NATION
FROM f LEFT JOIN codes ON f.c_mktsegment = codes.v"""
    cols = [("SK_ID_CURR", "bigint"), ("c_mktsegment", "bigint"), ("c_nationkey", "bigint"),
            ("c_acctbal", "double"), ("TARGET", "double"), ("ACCTBAL_PER_NATION", "double")]
    return sql, cols


# -- Spark side of the roll-ups ----------------------------------------------

def app_features(spark, sf):
    return C.application_features(D.app_train(spark, sf), D.app_test(spark, sf), **D.APP_SPEC)


def prev_features(spark, sf):
    return C.previous_applications(D.previous(spark, sf), **D.PREV_SPEC)


def pos_features(spark, sf):
    return C.pos_cash(D.events_history(spark, sf), aggs=D.POS_NUM)


def ins_features(spark, sf):
    # the payments' versions are line numbers, whose span one column of one table gives
    lines = D.read(spark, sf, "lineitem").select(F.col("l_linenumber").alias("NUM_INSTALMENT_VERSION"))
    return C.installments_payments(D.installments(spark, sf), spans=integer_spans(lines, lines.columns))


def cc_features(spark, sf):
    return C.credit_card_balance(D.events_history(spark, sf))


def _plain(sqlcols):
    sql, cols = sqlcols
    return O.final_select(sql, cols)


register("app_features", _plain(app_sql()))(lambda spark, sf: finalize(app_features(spark, sf)))
register("bureau_features", _plain(bureau_sql()))(lambda spark, sf: finalize(bureau_features(spark, sf)))
register("prev_features", _plain(prev_sql()))(lambda spark, sf: finalize(prev_features(spark, sf)))
register("pos_features", _plain(pos_sql()))(lambda spark, sf: finalize(pos_features(spark, sf)))
register("payment_style_features", _plain(ins_sql()))(lambda spark, sf: finalize(ins_features(spark, sf)))
register("card_features", _plain(cc_sql()))(lambda spark, sf: finalize(cc_features(spark, sf)))


# -- C7: the full feature table ----------------------------------------------

def _feature_table_sql():
    parts = [("app", app_sql()), ("bur", bureau_sql()), ("prv", prev_sql()), ("pos", pos_sql()),
             ("ins", ins_sql()), ("cc", cc_sql())]
    ctes = ",\n".join(f"{a} AS ({s})" for a, (s, _) in parts)
    sel, cols = [], []
    for a, (_, cs) in parts:
        for n, t in cs:
            if n == "SK_ID_CURR" and a != "app":
                continue
            sel.append(f"{a}.{O.q(n)} AS {O.q(O.sanitize(n))}")
            cols.append((O.sanitize(n), t))
    joins = " ".join(f"LEFT JOIN {a} ON app.SK_ID_CURR = {a}.SK_ID_CURR" for a, _ in parts[1:])
    return O.final_select(f"WITH {ctes}\nSELECT {', '.join(sel)} FROM app {joins}", cols)


def feature_table(spark, sf, buckets=None):
    """C7 on the driver tables. The categories of every source come from
    one job (orders and events serve two roles each but are scanned once);
    the applicants' codes from a code table."""
    from riskloom.operators.encode import discover_domains_many
    train, test = D.app_train(spark, sf), D.app_test(spark, sf)
    bu, bb, ev = D.bureau(spark, sf), D.bureau_balance(spark, sf), D.events_history(spark, sf)
    doms = discover_domains_many([
        ("bureau", bu, ["o_orderstatus", "o_orderpriority"]),
        ("bb", bb, ["l_returnflag", "l_linestatus"]),
        ("events", ev, ["event_type"]),
    ], C.MAX_ONE_HOT)
    app = C.application_features(train, test, **D.APP_SPEC)
    parts = [
        C.bureau_and_balance(bu, bb, categories={**doms["bureau"], **doms["bb"]}, **D.BUREAU_SPEC),
        C.previous_applications(D.previous(spark, sf), categories=doms["bureau"], **D.PREV_SPEC),
        C.pos_cash(ev, aggs=D.POS_NUM, categories=doms["events"]),
        ins_features(spark, sf),
        C.credit_card_balance(ev, categories=doms["events"]),
    ]
    return C.feature_table(app, parts, buckets=buckets)


register("feature_table", _feature_table_sql())(lambda spark, sf: finalize(feature_table(spark, sf)))


@register("feature_table_bucketed", _feature_table_sql())
def feature_table_bucketed(spark, sf):
    """C7 with applicants and roll-ups written once as bucketed tables, joined without an exchange."""
    return finalize(feature_table(spark, sf, buckets=int(spark.conf.get("spark.sql.shuffle.partitions"))))


# -- single operators ---------------------------------------------------------

def _subset_sql():
    spec = {"o_totalprice": ["min", "max", "mean", "var", "sum", "size"], "DAYS_ORDER": ["sum", "nunique"]}
    items = O.spec_sql(spec, BUREAU_TYPES, "ACTIVE_")
    sql = f"""WITH bureau AS ({D.BUREAU_SQL}),
keys AS (SELECT DISTINCT SK_ID_CURR FROM bureau WHERE SK_ID_CURR IS NOT NULL),
act AS ({O.group_sql('bureau', 'SK_ID_CURR', items, "o_orderstatus = 'O'")})
SELECT keys.SK_ID_CURR, {', '.join('act.' + O.q(n) for _, n, _ in items)}
FROM keys LEFT JOIN act ON keys.SK_ID_CURR = act.SK_ID_CURR"""
    return O.final_select(sql, [("SK_ID_CURR", "bigint")] + [(n, t) for _, n, t in items])


@register("subset_agg", _subset_sql())
def subset_agg(spark, sf):
    from riskloom.operators.aggspec import aggregate, compile_spec
    b = D.bureau(spark, sf)
    spec = {"o_totalprice": ["min", "max", "mean", "var", "sum", "size"], "DAYS_ORDER": ["sum", "nunique"]}
    return finalize(aggregate(b, "SK_ID_CURR",
                              compile_spec(b.schema, spec, "ACTIVE_", F.col("o_orderstatus") == "O")))


def _share_sql():
    items = O.share_sql("o_orderstatus", D.DOMAINS["o_orderstatus"], "BURO_")
    items += O.share_sql("o_orderpriority", D.DOMAINS["o_orderpriority"], "BURO_")
    sql = f"WITH bureau AS ({D.BUREAU_SQL}) {O.group_sql('bureau', 'SK_ID_CURR', items)}"
    return O.final_select(sql, [("SK_ID_CURR", "bigint")] + [(n, t) for _, n, t in items])


@register("category_share", _share_sql())
def category_share(spark, sf):
    from riskloom.operators.aggspec import aggregate, share_exprs
    from riskloom.operators.encode import discover_domains
    b = D.bureau(spark, sf)
    doms = discover_domains(b, ["o_orderstatus", "o_orderpriority"], C.MAX_ONE_HOT)
    exprs = [e for c in ("o_orderstatus", "o_orderpriority") for e in share_exprs(c, doms[c], "BURO_")]
    return finalize(aggregate(b, "SK_ID_CURR", exprs))


LI_A2_SQL = """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, l_extendedprice,
  l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem"""


def _all_column_sql():
    flags, types, names = [], {}, []
    for c in ("l_returnflag", "l_linestatus"):
        for v in list(D.DOMAINS[c]) + [None]:
            n = f"{c}_{v if v is not None else 'nan'}"
            flags.append(f"{O.flag_sql(c, v)} AS {O.q(n)}")
            types[n] = "int"
            names.append(n)
    num = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    types.update({c: "double" for c in num})
    spec = {c: list(C.CC_FUNCS) for c in num + names}
    items = O.spec_sql(spec, types, "LI_") + [("COUNT(*)", "LI_COUNT", "bigint")]
    sql = f"""WITH li AS ({LI_A2_SQL}),
x AS (SELECT l_orderkey, {', '.join(num)}, {', '.join(flags)} FROM li)
{O.group_sql('x', 'l_orderkey', items)}"""
    return O.final_select(sql, [("l_orderkey", "bigint")] + [(n, t) for _, n, t in items])


@register("all_column_agg", _all_column_sql())
def all_column_agg(spark, sf):
    li = D.read(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    return finalize(C.credit_card_balance(li, curr_key="l_orderkey", drop=["l_linenumber"],
                                          prefix="LI_", count_name="LI_COUNT"))
