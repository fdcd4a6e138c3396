from collections import Counter

from pyspark.sql import functions as F

from riskloom.functions.exprs import portable_hash_sql
from riskloom.operators.rank import global_position
from riskloom.operators.sampling import exact_sample, hash_sample, kfold, stratified_kfold
from tests.conftest import SF_CHECK


def test_global_position_equals_row_number(spark, duck):
    o = spark.read.parquet(f"{SF_CHECK}/orders.parquet").select("o_orderkey")
    for bits in (1, 4, 10):
        got = dict((r.o_orderkey, r.pos) for r in global_position(o, "o_orderkey", 7, bucket_bits=bits).collect())
        ref = dict(duck.execute(f"SELECT o_orderkey, row_number() OVER (ORDER BY {portable_hash_sql('o_orderkey', seed=7)}, "
                                "o_orderkey) - 1 FROM orders").fetchall())
        assert got == ref


def test_folds_partition_rows(spark):
    df = spark.range(1, 1003).withColumnRenamed("id", "k")
    f = kfold(df, "k", 5, seed=1001)
    sizes = Counter(r.fold for r in f.collect())
    assert sum(sizes.values()) == 1002 and set(sizes) == set(range(5))
    assert max(sizes.values()) - min(sizes.values()) <= 1


def test_stratified_folds_balance_labels(spark):
    df = spark.range(1, 1001).withColumn("y", (F.col("id") % 10 == 0).cast("int")).withColumnRenamed("id", "k")
    f = stratified_kfold(df, "k", "y", 5)
    pos = Counter(r.fold for r in f.where("y = 1").collect())
    assert sorted(pos.values()) == [20] * 5


def test_samples(spark):
    df = spark.range(1, 5001).withColumnRenamed("id", "k")
    assert exact_sample(df, "k", 1234, seed=3).count() == 1234
    n = hash_sample(df, "k", 0.1, seed=0).count()
    assert 400 < n < 600
    a = sorted(r.k for r in hash_sample(df.repartition(7), "k", 0.1).collect())
    b = sorted(r.k for r in hash_sample(df, "k", 0.1).collect())
    assert a == b   # repeatable whatever the partitioning


def test_hash_cut_is_where_the_exact_sample_ends(spark):
    """Counts of keys alone find the cut: rows before it and those taken at it are the sample's,
    with repeated and missing keys, and where the hashes of many rows share their high bits."""
    from riskloom.operators.sampling import hash_cut
    rows = [(f"k{i % 40}" if i % 9 else None, i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i long").cache()
    for n in (1, 7, 33, 150, 299, 300):
        cut = hash_cut(df, "k", n, seed=5)
        before, at = df.where(cut.before("k")), df.where(cut.at("k"))
        assert at.count() == cut.held and before.count() + cut.taken == n and 0 < cut.taken <= cut.held
        want = sorted(str(r.k) for r in exact_sample(df, "k", n, seed=5).collect())
        assert want == sorted([str(r.k) for r in before.collect()] + [str(r.k) for r in at.limit(cut.taken).collect()])
    assert hash_cut(df, "k", 301, seed=5) is None
    assert hash_cut(df.where("i < 0"), "k", 5) is None
