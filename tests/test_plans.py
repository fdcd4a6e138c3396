"""Physical-plan properties the design relies on."""

from riskloom.plans import driver as D
from riskloom.plans import q_features as QF
from tests.conftest import SF_CHECK


def _plan(df, mode="formatted"):
    jvm = df.sparkSession._jvm
    return df._jdf.queryExecution().explainString(
        jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def test_scans_read_only_used_columns(spark):
    plan = _plan(QF.bureau_features(spark, SF_CHECK))
    # lineitem: key, quantity and the two flags only; orders: six columns of the view
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_returnflag:string,l_linestatus:string>" in plan
    assert "l_extendedprice" not in plan and "l_comment" not in plan
    assert "o_orderdate:timestamp_ntz" in plan


def test_filters_pushed_to_scan(spark):
    plan = _plan(D.app_test(spark, SF_CHECK))
    assert "PushedFilters: [IsNotNull(c_mktsegment), EqualTo(c_mktsegment,HOUSEHOLD)]" in plan


def test_subsets_fused_into_one_aggregate_per_level(spark):
    plan = _plan(QF.bureau_features(spark, SF_CHECK), "simple")
    # two-level roll-up: one partial+final aggregate per level, no self-join for Active/Closed
    assert plan.count("HashAggregate(keys=[SK_ID_CURR") == 2
    assert "SortMergeJoin" not in plan or plan.count("Join") == 1


def test_feature_table_shuffles_applicants_once(spark):
    plan = _plan(QF.feature_table(spark, SF_CHECK), "simple")
    import re
    exch = [l for l in plan.splitlines() if re.search(r"Exchange hashpartitioning\(SK_ID_CURR#\d+L?, \d+\)", l)]
    # one exchange per child roll-up (its own final aggregate) plus one for the
    # applicants; the joins reuse those partitionings
    assert len(exch) <= 6


def test_smote_copies_are_never_shuffled(spark):
    from pyspark.sql import functions as F
    from riskloom.operators.smote import smote
    e = spark.read.parquet(f"{SF_CHECK}/embeddings.parquet").withColumn("y", (F.col("label") == 0).cast("int"))
    lines = _plan(smote(e, "vec_id", "embedding", "y", 5, minority=1), "simple").splitlines()
    made = next(i for i, l in enumerate(lines) if "Generate explode(sequence(piece" in l)
    assert not any("Exchange" in l for l in lines[:made])


def test_knn_repeated_vector_limit_runs_before_shuffle(spark):
    # a vector repeated on most rows must not reach one task whole: the
    # k+1 smallest ids per vector are cut map-side before the exchange
    from pyspark.sql import functions as F
    from riskloom.operators.smote import distinct_vectors
    pts = spark.createDataFrame([(i, [1.0, 2.0] if i % 3 else [float(i), 0.0]) for i in range(60)],
                                "id bigint, v array<double>").withColumn("h", F.xxhash64("v"))
    out = distinct_vectors(pts, 6)
    plan = _plan(out, "simple")
    lines = plan.splitlines()
    partial = [i for i, l in enumerate(lines) if "WindowGroupLimit" in l and "Partial" in l]
    exch = [i for i, l in enumerate(lines) if "Exchange hashpartitioning(h#" in l]
    assert partial and exch and max(partial) > min(exch)   # listed below (= before) the exchange
    rows = {r.uid: r.ids for r in out.collect()}
    assert rows[1] == [1, 2, 4, 5, 7, 8]                     # the hot vector keeps its 6 smallest ids


def test_bucketed_tables_join_without_an_exchange(spark):
    from riskloom.plans import credit as C
    from riskloom.sources.store import stored_buckets
    orders = spark.read.parquet(f"{SF_CHECK}/orders.parquet")
    app = spark.read.parquet(f"{SF_CHECK}/customer.parquet").selectExpr("c_custkey AS SK_ID_CURR", "c_acctbal")
    parts = [orders.selectExpr("o_custkey AS SK_ID_CURR", "o_totalprice").groupBy("SK_ID_CURR").sum().toDF("SK_ID_CURR", f"a{i}", f"b{i}")
             for i in range(2)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = C.feature_table(app, parts, buckets=8)
        plan = _plan(joined, "simple")
        assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2
        assert joined.count() == app.count()
        assert sorted(map(tuple, joined.collect()), key=str) == sorted(map(tuple, C.feature_table(app, parts).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert stored_buckets(app.limit(0), ["SK_ID_CURR"], 4).count() == 0


def test_distinct_counts_add_no_exchange(spark):
    plan = _plan(QF.ins_features(spark, SF_CHECK), "simple")
    import re
    assert len(re.findall(r"Exchange hashpartitioning\(SK_ID_CURR", plan)) == 1
