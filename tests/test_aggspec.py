from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskloom.operators.aggspec import aggregate, compile_spec, share_exprs

ROWS = [
    # key, status, x, y, cat
    (1, "Active", 1.0, 10, "a"),
    (1, "Closed", 3.0, None, None),
    (1, "Active", None, 20, "b"),
    (2, "Closed", 5.0, 1, "a"),       # no Active row
    (3, "Active", None, None, "a"),   # all-missing numeric values
    (None, "Active", 7.0, 7, "a"),    # null key: dropped like pandas group-by
]
SCHEMA = "k bigint, status string, x double, y bigint, cat string"


def test_reference_semantics(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    spec = {"x": ["min", "max", "mean", "sum", "var", "size", "nunique"], "y": ["sum"]}
    out = {r.k: r for r in aggregate(df, "k", compile_spec(df.schema, spec, "P_")).collect()}
    assert set(out) == {1, 2, 3}
    assert out[1].P_x_SUM == 4.0 and out[1].P_x_MEAN == 2.0 and out[1].P_x_VAR == 2.0
    assert out[1].P_x_SIZE == 3 and out[1].P_x_NUNIQUE == 2
    assert out[2].P_x_VAR is None                        # one value
    assert out[3].P_x_SUM == 0.0 and out[3].P_x_MEAN is None  # all missing
    assert out[3].P_x_NUNIQUE == 0 and out[3].P_y_SUM == 0


def test_subset_group_without_match_is_all_null(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    spec = {"x": ["sum", "size", "nunique", "mean"]}
    exprs = compile_spec(df.schema, spec, "ACTIVE_", F.col("status") == "Active")
    out = {r.k: r for r in aggregate(df, "k", exprs).collect()}
    assert out[2].ACTIVE_x_SUM is None and out[2].ACTIVE_x_SIZE is None
    assert out[2].ACTIVE_x_NUNIQUE is None and out[2].ACTIVE_x_MEAN is None
    assert out[3].ACTIVE_x_SUM == 0.0 and out[3].ACTIVE_x_SIZE == 1 and out[3].ACTIVE_x_NUNIQUE == 0
    assert out[1].ACTIVE_x_SUM == 1.0 and out[1].ACTIVE_x_SIZE == 2


def test_category_share_denominator_includes_missing(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    out = {r.k: r for r in aggregate(df, "k", share_exprs("cat", ["a", "b"], "S_")).collect()}
    r = out[1]
    assert abs(r.S_cat_a_MEAN - 1 / 3) < 1e-12 and abs(r.S_cat_nan_MEAN - 1 / 3) < 1e-12
    assert abs(r.S_cat_a_MEAN + r.S_cat_b_MEAN + r.S_cat_nan_MEAN - 1.0) < 1e-12


def test_wide_split_equals_single(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    spec = {"x": ["min", "max", "mean", "sum", "var", "size"], "y": ["min", "max", "sum"]}
    one = aggregate(df, "k", compile_spec(df.schema, spec)).orderBy("k").collect()
    split = aggregate(df, "k", compile_spec(df.schema, spec), max_exprs=4)
    assert split.select(*[c for c in one[0].asDict()]).orderBy("k").collect() == one


rows_st = st.lists(st.tuples(st.integers(0, 5), st.sampled_from(["Active", "Closed", None]),
                             st.one_of(st.none(), st.integers(-50, 50).map(float))), max_size=40)


@settings(max_examples=15, deadline=None)
@given(rows_st)
def test_fused_subset_equals_filter_group_join(spark, rows):
    df = spark.createDataFrame(rows, "k bigint, status string, x double")
    spec = {"x": ["min", "max", "mean", "sum", "var", "size", "nunique"]}
    fused = aggregate(df, "k", compile_spec(df.schema, spec, "A_", F.col("status") == "Active"))
    keys = df.where(F.col("k").isNotNull()).select("k").distinct()
    sub = aggregate(df.where(F.col("status") == "Active"), "k", compile_spec(df.schema, spec, "A_"))
    joined = keys.join(sub, "k", "left")
    cols = fused.columns
    a = sorted(tuple(r) for r in fused.select(*cols).collect())
    b = sorted(tuple(r) for r in joined.select(*cols).collect())
    assert len(a) == len(b)
    for ra, rb in zip(a, b):
        for va, vb in zip(ra, rb):
            assert (va is None and vb is None) or abs(va - vb) < 1e-9


def test_dealt_rows_are_aggregated_after_the_one_exchange(spark):
    from riskloom.plans.credit import credit_card_balance
    rows = spark.createDataFrame([(k, float(v), c) for k, v, c in
                                  [(1, 2, "a"), (1, 5, "b"), (2, 1, None), (1, 2, "a"), (2, 4, "b")]] + [(None, 1.0, "a")],
                                 "SK_ID_CURR bigint, x double, c string").repartition(3)
    wide = credit_card_balance(rows, drop=[], categories={"c": ["a", "b"]})
    plan = wide._jdf.queryExecution().sparkPlan().toString()
    assert "Aggregate" not in plan[plan.index("Exchange"):]  # the rows are shuffled, not their partial aggregates
    got = {r["SK_ID_CURR"]: r for r in wide.collect()}
    assert set(got) == {1, 2} and got[1]["CC_x_SUM"] == 9.0 and got[2]["CC_c_nan_SUM"] == 1 and got[1]["CC_COUNT"] == 3
