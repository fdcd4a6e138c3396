import pytest

from riskloom.operators.assemble import left_join_chain, sanitize_names, semi_join, union_by_name


def test_sanitize_and_collisions(spark):
    df = spark.createDataFrame([(1, 2)], "`a-b` int, `c d` int")
    assert sanitize_names(df).columns == ["ab", "cd"]
    with pytest.raises(ValueError):
        sanitize_names(spark.createDataFrame([(1, 2)], "`a-b` int, `ab` int"))
    with pytest.raises(ValueError):
        sanitize_names(spark.createDataFrame([(1, 2)], "`X_1` int, `x-_1` int"))


def test_union_missing_columns(spark):
    tr = spark.createDataFrame([(1, 0.0)], "k bigint, TARGET double")
    te = spark.createDataFrame([(2,)], "k bigint")
    rows = {r.k: r.TARGET for r in union_by_name([tr, te]).collect()}
    assert rows == {1: 0.0, 2: None}


def test_left_chain_and_semi(spark):
    base = spark.createDataFrame([(1,), (2,), (3,)], "k bigint")
    a = spark.createDataFrame([(1, 10)], "k bigint, a bigint")
    b = spark.createDataFrame([(2, 20), (9, 90)], "k bigint, b bigint")
    out = {r.k: (r.a, r.b) for r in left_join_chain(base, [a, b], "k").collect()}
    assert out == {1: (10, None), 2: (None, 20), 3: (None, None)}
    assert sorted(r.k for r in semi_join(base, b, "k").collect()) == [2]
