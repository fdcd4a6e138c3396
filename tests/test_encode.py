import pytest

from riskloom.operators.encode import discover_domains, factorize, one_hot


def test_one_hot_sorted_names_and_nan_flag(spark):
    df = spark.createDataFrame([(1, "b", 1.0), (2, "a", 2.0), (3, None, 3.0)], "id bigint, c string, v double")
    out, new = one_hot(df, nan_as_category=True, max_values=10)
    assert new == ["c_a", "c_b", "c_nan"]
    assert out.columns == ["id", "v", "c_a", "c_b", "c_nan"]
    rows = {r.id: (r.c_a, r.c_b, r.c_nan) for r in out.collect()}
    assert rows == {1: (0, 1, 0), 2: (1, 0, 0), 3: (0, 0, 1)}


def test_one_hot_nan_flag_emitted_without_missing_values(spark):
    df = spark.createDataFrame([(1, "x")], "id bigint, c string")
    _, new = one_hot(df, nan_as_category=True, max_values=10)
    assert new == ["c_x", "c_nan"]
    out, new = one_hot(spark.createDataFrame([(1, None)], "id bigint, c string"), nan_as_category=False,
                       categories={"c": ["x"]})
    assert new == ["c_x"] and out.first().c_x == 0


def test_factorize_first_appearance_and_missing(spark):
    df = spark.createDataFrame([(3, "F"), (1, "M"), (2, None), (4, "M"), (0, "XNA")], "k bigint, g string")
    out = {r.k: r.g for r in factorize(df, ["g"], order_by="k").collect()}
    # order of first appearance by k: XNA(0), M(1), F(3)
    assert out == {0: 0, 1: 1, 2: -1, 3: 2, 4: 1}
    sorted_codes = {r.k: r.g for r in factorize(df, ["g"]).collect()}
    assert sorted_codes == {0: 2, 1: 1, 2: -1, 3: 0, 4: 1}


def test_domain_cap(spark):
    df = spark.range(50).selectExpr("cast(id as string) as s")
    with pytest.raises(ValueError):
        discover_domains(df, ["s"], max_values=10)
    assert len(discover_domains(df, ["s"], max_values=100)["s"]) == 50


def test_one_hot_needs_a_stated_width(spark):
    df = spark.createDataFrame([(1, "b")], "id bigint, c string")
    with pytest.raises(ValueError):
        one_hot(df)


def test_factorize_of_many_values(spark):
    """5000 values, and keys above 2**40: codes by (source, key), not by a packed number."""
    from pyspark.sql import functions as F
    df = spark.range(12000).selectExpr("id", "concat('v', (id * 7919) % 5000) AS s",
                                       "CAST(IF(id % 3 = 0, NULL, 'a') AS STRING) AS t")
    seen, want = {}, {}
    for i in range(12000):
        v = f"v{i * 7919 % 5000}"
        want[i] = seen.setdefault(v, len(seen))
    got = {r.id: (r.s, r.t) for r in factorize(df, ["s", "t"], order_by="id").collect()}
    assert got == {i: (c, -1 if i % 3 == 0 else 0) for i, c in want.items()}
    big = spark.createDataFrame([(0, (1 << 41) + 1, "A"), (1, 5, "B")], "src int, k bigint, g string")
    codes = {r.g: r.code for r in factorize(big.withColumn("code", F.col("g")), ["code"],
                                            order_by=F.struct("src", "k")).collect()}
    assert codes == {"A": 0, "B": 1}
