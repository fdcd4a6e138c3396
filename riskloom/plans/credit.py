"""Composite feature pipelines: one wide row per applicant.

Each pipeline takes DataFrames (not paths) and a spec, so it runs on
the reference's credit tables with the default specs below and on any other
parent / child / grandchild schema with specs of its own (see
``riskloom.plans.driver``).

Plan shape (per child table): scan -> projection (flags, ratios) ->
one hash aggregate on the applicant key (partial aggregation before
the shuffle, fused subset aggregates) -> left join onto the applicant
table. The bureau roll-up adds one level: aggregate per loan, join the
loan table on the loan key (the aggregate is already partitioned on
it), then aggregate per applicant.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.exprs import (clamp_zero, ieee_div, not_equal_keep_null, qcol,
                                      sentinel_null)
from riskloom.operators.aggspec import (agg_name, aggregate, aggregate_spec, all_columns_spec,
                                        compile_spec, flag_agg, flag_conditions, integer_spans, share_exprs)
from riskloom.operators.assemble import left_join_chain, sanitize_names, semi_join, union_by_name
from riskloom.operators.encode import discover_domains, factorize, one_hot, string_columns
from riskloom.sources.csv import INPUT_ORDER
from riskloom.sources.store import stored_buckets

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for the same features:
# feature names, aggregation specs, prefixes, sentinels and subset values.
# ---------------------------------------------------------------------------
SENTINEL_DAYS = 365243

APP_FACTORIZE = ["CODE_GENDER", "FLAG_OWN_CAR", "FLAG_OWN_REALTY"]
APP_DROP_EQUAL = ("CODE_GENDER", "XNA")
APP_SENTINELS = ["DAYS_EMPLOYED"]
APP_RATIOS = {
    "DAYS_EMPLOYED_PERC": ("DAYS_EMPLOYED", "DAYS_BIRTH"),
    "INCOME_CREDIT_PERC": ("AMT_INCOME_TOTAL", "AMT_CREDIT"),
    "INCOME_PER_PERSON": ("AMT_INCOME_TOTAL", "CNT_FAM_MEMBERS"),
    "ANNUITY_INCOME_PERC": ("AMT_ANNUITY", "AMT_INCOME_TOTAL"),
    "PAYMENT_RATE": ("AMT_ANNUITY", "AMT_CREDIT"),
}

BB_NUM_AGGS = {"MONTHS_BALANCE": ["min", "max", "size"]}
BUREAU_NUM_AGGS = {
    "DAYS_CREDIT": ["min", "max", "mean", "var"],
    "DAYS_CREDIT_ENDDATE": ["min", "max", "mean"],
    "DAYS_CREDIT_UPDATE": ["mean"],
    "CREDIT_DAY_OVERDUE": ["max", "mean"],
    "AMT_CREDIT_MAX_OVERDUE": ["mean"],
    "AMT_CREDIT_SUM": ["max", "mean", "sum"],
    "AMT_CREDIT_SUM_DEBT": ["max", "mean", "sum"],
    "AMT_CREDIT_SUM_OVERDUE": ["mean"],
    "AMT_CREDIT_SUM_LIMIT": ["mean", "sum"],
    "AMT_ANNUITY": ["max", "mean"],
    "CNT_CREDIT_PROLONG": ["sum"],
    "MONTHS_BALANCE_MIN": ["min"],
    "MONTHS_BALANCE_MAX": ["max"],
    "MONTHS_BALANCE_SIZE": ["mean", "sum"],
}
BUREAU_SUBSETS = [("ACTIVE_", "Active"), ("CLOSED_", "Closed")]

PREV_SENTINELS = ["DAYS_FIRST_DRAWING", "DAYS_FIRST_DUE", "DAYS_LAST_DUE_1ST_VERSION",
                  "DAYS_LAST_DUE", "DAYS_TERMINATION"]
PREV_RATIOS = {"APP_CREDIT_PERC": ("AMT_APPLICATION", "AMT_CREDIT")}
PREV_NUM_AGGS = {
    "AMT_ANNUITY": ["min", "max", "mean"],
    "AMT_APPLICATION": ["min", "max", "mean"],
    "AMT_CREDIT": ["min", "max", "mean"],
    "APP_CREDIT_PERC": ["min", "max", "mean", "var"],
    "AMT_DOWN_PAYMENT": ["min", "max", "mean"],
    "AMT_GOODS_PRICE": ["min", "max", "mean"],
    "HOUR_APPR_PROCESS_START": ["min", "max", "mean"],
    "RATE_DOWN_PAYMENT": ["min", "max", "mean"],
    "DAYS_DECISION": ["min", "max", "mean"],
    "CNT_PAYMENT": ["mean", "sum"],
}
PREV_SUBSETS = [("APPROVED_", "Approved"), ("REFUSED_", "Refused")]

POS_AGGS = {
    "MONTHS_BALANCE": ["max", "mean", "size"],
    "SK_DPD": ["max", "mean"],
    "SK_DPD_DEF": ["max", "mean"],
}

INS_AGGS = {
    "NUM_INSTALMENT_VERSION": ["nunique"],
    "DPD": ["max", "mean", "sum"],
    "DBD": ["max", "mean", "sum"],
    "PAYMENT_PERC": ["max", "mean", "sum", "var"],
    "PAYMENT_DIFF": ["max", "mean", "sum", "var"],
    "AMT_INSTALMENT": ["max", "mean", "sum"],
    "AMT_PAYMENT": ["min", "max", "mean", "sum"],
    "DAYS_ENTRY_PAYMENT": ["max", "mean", "sum"],
}
INS_COLUMNS = {"payment": "AMT_PAYMENT", "instalment": "AMT_INSTALMENT",
               "entry_day": "DAYS_ENTRY_PAYMENT", "due_day": "DAYS_INSTALMENT"}

CC_FUNCS = ["min", "max", "mean", "sum", "var"]
# ---------------------------------------------------------------------------


SOURCE_COL = "_rl_source"


#: widest one-hot variable of these pipelines: more output columns raise (pass
#: ``categories=`` for a wider one); the schema has a column per value
MAX_ONE_HOT = 2000


def _cap(df: DataFrame, num_rows: int | None) -> DataFrame:
    """Row cap for debug runs (the reference's ``nrows``)."""
    return df if num_rows is None else df.limit(num_rows)


def application_features(train: DataFrame, test: DataFrame | None = None, *,
                         num_rows: int | None = None, nan_as_category: bool = False,
                         drop_equal: tuple[str, str] | None = APP_DROP_EQUAL,
                         factorize_cols: Sequence[str] = APP_FACTORIZE,
                         order_by: str | None = "SK_ID_CURR",
                         sentinel_cols: Sequence[str] = APP_SENTINELS,
                         sentinel: int = SENTINEL_DAYS,
                         ratios: Mapping[str, tuple[str, str]] = APP_RATIOS,
                         categories: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """C1 (``application_train_test``): union train and test, drop the
    excluded value keeping missing ones, factorize the binary columns,
    one-hot the other string columns, sentinel -> NULL, ratio features.
    ``order_by``: a key, or ``sources.csv.INPUT_ORDER`` of tables read with
    their order (the column does not reach the result)."""
    parts = [_cap(train, num_rows).withColumn(SOURCE_COL, F.lit(0))]
    if test is not None:
        parts.append(_cap(test, num_rows).withColumn(SOURCE_COL, F.lit(1)))
    df = union_by_name(parts)
    if drop_equal:
        df = df.where(not_equal_keep_null(drop_equal[0], drop_equal[1]))
    # first appearance in the reference's row order: train rows, then test
    # rows, each by ``order_by``
    order = F.struct(F.col(SOURCE_COL), qcol(order_by)) if order_by else None
    df = factorize(df, list(factorize_cols), order_by=order, categories=categories).drop(SOURCE_COL, INPUT_ORDER)
    df, _ = one_hot(df, None, nan_as_category, categories, MAX_ONE_HOT)
    df = df.withColumns({c: sentinel_null(c, sentinel) for c in sentinel_cols})
    return df.withColumns({name: ieee_div(a, b) for name, (a, b) in ratios.items()})


def bureau_and_balance(bureau: DataFrame, bb: DataFrame, *, num_rows: int | None = None,
                       nan_as_category: bool = True, curr_key: str = "SK_ID_CURR",
                       loan_key: str = "SK_ID_BUREAU",
                       bb_num_aggs: Mapping[str, Sequence[str]] = BB_NUM_AGGS,
                       num_aggs: Mapping[str, Sequence[str]] = BUREAU_NUM_AGGS,
                       status_col: str = "CREDIT_ACTIVE",
                       subsets: Sequence[tuple[str, str]] = BUREAU_SUBSETS,
                       prefix: str = "BURO_",
                       categories: Mapping[str, Sequence[str]] | None = None,
                       max_exprs: int | None = None) -> DataFrame:
    """Two-level roll-up. Loan-month history -> per loan (min, max,
    size, category shares) -> left join onto loans -> per applicant
    (numeric spec, loan category shares, mean of the per-loan shares)
    plus the same numeric spec on Active and on Closed loans only."""
    bureau, bb = _cap(bureau, num_rows), _cap(bb, num_rows)
    bb_cat = string_columns(bb)
    bu_cat = string_columns(bureau)
    doms = dict(categories or {})
    need_bb = [c for c in bb_cat if c not in doms]
    need_bu = [c for c in bu_cat if c not in doms]
    if need_bb:
        doms.update(discover_domains(bb, need_bb, MAX_ONE_HOT))
    if need_bu:
        doms.update(discover_domains(bureau, need_bu, MAX_ONE_HOT))

    lvl1_exprs = compile_spec(bb.schema, bb_num_aggs)
    bb_share_names = []
    for c in bb_cat:
        ex = share_exprs(c, doms[c], "", nan_as_category)
        lvl1_exprs += ex
        bb_share_names += [f"{c}_{v}_MEAN" for v in doms[c]] + ([f"{c}_nan_MEAN"] if nan_as_category else [])
    per_loan = aggregate(bb, loan_key, lvl1_exprs)
    loans = bureau.join(per_loan, on=loan_key, how="left").drop(loan_key)

    exprs = compile_spec(loans.schema, num_aggs, prefix)
    for c in bu_cat:
        exprs += share_exprs(c, doms[c], prefix, nan_as_category)
    exprs += compile_spec(loans.schema, {n: ["mean"] for n in bb_share_names}, prefix)
    for sub_prefix, value in subsets:
        exprs += compile_spec(loans.schema, num_aggs, sub_prefix, qcol(status_col) == F.lit(value))
    return aggregate(loans, curr_key, exprs, max_exprs, deal=True)


def previous_applications(prev: DataFrame, *, num_rows: int | None = None,
                          nan_as_category: bool = True, curr_key: str = "SK_ID_CURR",
                          sentinel_cols: Sequence[str] = PREV_SENTINELS,
                          sentinel: int = SENTINEL_DAYS,
                          ratios: Mapping[str, tuple[str, str]] = PREV_RATIOS,
                          num_aggs: Mapping[str, Sequence[str]] = PREV_NUM_AGGS,
                          status_col: str = "NAME_CONTRACT_STATUS",
                          subsets: Sequence[tuple[str, str]] = PREV_SUBSETS,
                          prefix: str = "PREV_",
                          categories: Mapping[str, Sequence[str]] | None = None,
                          max_exprs: int | None = None) -> DataFrame:
    """Sentinel days -> NULL, application/credit ratio, numeric spec
    and category shares per applicant, plus the numeric spec on Approved
    and on Refused applications only. ``nan_as_category`` is honoured
    (the reference forces it on; on is the default here)."""
    prev = _cap(prev, num_rows)
    prev = prev.withColumns({c: sentinel_null(c, sentinel) for c in sentinel_cols})
    prev = prev.withColumns({n: ieee_div(a, b) for n, (a, b) in ratios.items()})
    cats = string_columns(prev)
    doms = dict(categories or {})
    need = [c for c in cats if c not in doms]
    if need:
        doms.update(discover_domains(prev, need, MAX_ONE_HOT))
    subs = [(p, qcol(status_col) == F.lit(v)) for p, v in subsets]
    return aggregate_spec(prev, curr_key, num_aggs, prefix, {c: doms[c] for c in cats},
                          nan_as_category, subs, max_exprs, deal=True)


def pos_cash(pos: DataFrame, *, num_rows: int | None = None, nan_as_category: bool = True,
             curr_key: str = "SK_ID_CURR", aggs: Mapping[str, Sequence[str]] = POS_AGGS,
             prefix: str = "POS_", count_name: str = "POS_COUNT",
             categories: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """C4: numeric spec, category shares and a row count per applicant.
    (The reference ignores ``num_rows`` here; it is honoured.)"""
    pos = _cap(pos, num_rows)
    cats = string_columns(pos)
    doms = dict(categories or {})
    need = [c for c in cats if c not in doms]
    if need:
        doms.update(discover_domains(pos, need, MAX_ONE_HOT))
    exprs = compile_spec(pos.schema, aggs, prefix)
    for c in cats:
        exprs += share_exprs(c, doms[c], prefix, nan_as_category)
    exprs.append(F.count(F.lit(1)).alias(count_name))
    return aggregate(pos, curr_key, exprs, deal=True)


def installment_columns(ins: DataFrame, cols: Mapping[str, str] = INS_COLUMNS) -> DataFrame:
    """PAYMENT_PERC, PAYMENT_DIFF, DPD, DBD (days past / before due, >= 0)."""
    pay, inst = qcol(cols["payment"]), qcol(cols["instalment"])
    entry, due = qcol(cols["entry_day"]), qcol(cols["due_day"])
    return ins.withColumns({
        "PAYMENT_PERC": ieee_div(pay, inst),
        "PAYMENT_DIFF": inst - pay,
        "DPD": clamp_zero(entry - due),
        "DBD": clamp_zero(due - entry),
    })


def installments_payments(ins: DataFrame, *, num_rows: int | None = None,
                          nan_as_category: bool = True, curr_key: str = "SK_ID_CURR",
                          cols: Mapping[str, str] = INS_COLUMNS,
                          aggs: Mapping[str, Sequence[str]] = INS_AGGS,
                          prefix: str = "INSTAL_", count_name: str = "INSTAL_COUNT",
                          categories: Mapping[str, Sequence[str]] | None = None,
                          spans: Mapping[str, tuple[int, int]] | None = None) -> DataFrame:
    """Payment ratio / difference, clamped day gaps, numeric spec
    (with ``nunique``), category shares and a row count per applicant.
    ``spans`` of the counted columns; without them one job finds those of
    small whole numbers, so that the roll-up has one exchange."""
    ins = installment_columns(_cap(ins, num_rows), cols)
    cats = string_columns(ins)
    doms = dict(categories or {})
    need = [c for c in cats if c not in doms]
    if need:
        doms.update(discover_domains(ins, need, MAX_ONE_HOT))
    if spans is None:
        spans = integer_spans(ins, [c for c, fns in aggs.items() if "nunique" in fns])
    exprs = compile_spec(ins.schema, aggs, prefix, spans=spans)
    for c in cats:
        exprs += share_exprs(c, doms[c], prefix, nan_as_category)
    exprs.append(F.count(F.lit(1)).alias(count_name))
    return aggregate(ins, curr_key, exprs)


def credit_card_balance(cc: DataFrame, *, num_rows: int | None = None,
                        nan_as_category: bool = True, curr_key: str = "SK_ID_CURR",
                        drop: Sequence[str] = ("SK_ID_PREV",), funcs: Sequence[str] = CC_FUNCS,
                        prefix: str = "CC_", count_name: str = "CC_COUNT",
                        categories: Mapping[str, Sequence[str]] | None = None,
                        max_exprs: int | None = None) -> DataFrame:
    """One-hot, drop the loan id, then every function on every other
    column (flags included) per applicant, plus a row count. A flag's functions come
    from one counter (``aggspec.flag_agg``), so no one-hot column is built."""
    cc = _cap(cc, num_rows).drop(*drop)
    cats = string_columns(cc)
    doms = dict(categories or {})
    need = [c for c in cats if c not in doms]
    if need:
        doms.update(discover_domains(cc, need, MAX_ONE_HOT))
    exprs = compile_spec(cc.schema, all_columns_spec(cc, curr_key, funcs), prefix)
    for c in cats:
        for name, cond in flag_conditions(c, sorted(doms[c]), nan_as_category):
            exprs += [flag_agg(cond, fn).alias(agg_name(prefix, f"{c}_{name}", fn)) for fn in funcs]
    exprs.append(F.count(F.lit(1)).alias(count_name))
    return aggregate(cc, curr_key, exprs, max_exprs, deal=True)


def feature_table(app: DataFrame, parts: Sequence[DataFrame], key: str = "SK_ID_CURR",
                  sanitize: bool = True, buckets: int | None = None) -> DataFrame:
    """C7 (``main``): left-join every per-applicant roll-up onto the
    applicant table, then clean the column names. With ``buckets`` the
    applicants and roll-ups are first written as tables bucketed and sorted
    by the key, so they are computed once and the joins exchange nothing."""
    if buckets:
        app, *parts = bucketed_tables([app.repartition(buckets, qcol(key)), *parts], key, buckets)
    df = left_join_chain(app, parts, key)
    return sanitize_names(df) if sanitize else df


def bucketed_tables(tables: Sequence[DataFrame], key: str, buckets: int) -> list[DataFrame]:
    """Each table bucketed and sorted by the key; the writes run side by side. A roll-up
    whose aggregate deals the key into as many partitions is written as it lies."""
    with ThreadPoolExecutor(max_workers=len(tables)) as pool:
        return list(pool.map(lambda t: stored_buckets(t, [key], buckets), tables))


def client_extract(train: DataFrame, test: DataFrame | None, features: DataFrame,
                   cols: Sequence[str], key: str = "SK_ID_CURR") -> DataFrame:
    """Named client columns of every applicant present in the
    feature table (a semi join; 'XNA' applicants drop out)."""
    base = union_by_name([train] + ([test] if test is not None else []))
    return semi_join(base.select(*[qcol(c) for c in cols]), features, key)
