import pytest
from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet " * 9000

#: (doc_id, text): nulls, empty, blank, ties, copies, near copies, odd characters, very long
EDGE = [
    (100001, None), (100002, ""), (100003, "  \n\t "), (100004, "one"), (100005, "One"), (100006, "one two three"),
    (100007, "one two three four five six seven eight nine ten"),
    (100008, "one two three four five six seven eight nine ten"),
    (100009, "one two three four five six seven eight nine ten eleven"),
    (100010, "日本語 テキスト 🎉🎉 naïve ÉCOLE ß İ ΑΣ x y"), (100011, LONG), (100012, LONG + "end"),
    (100013, "mail a.b+c@x-y.example.com, b@c.de_f@g.hi 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 +1 (555) 010-9999 end"),
    (100014, "4111 1111 1111 1111 and 4111-1111-1111-1112 x5500005555555559y +12345678 +4930123456"),
    (100015, "a@b.c\nb (at) host (dot) org 10 . 0 . 0 . 1 5500.0055.5555.5559 call (608) 555-3598"),
    (100016, "<|endoftext|> x<|startoftext|>Y <|ENDOFTEXT|>"), (100017, "▁mark  two   spaces \n\n\nlines\r\n"),
    (100018, "x" * 3000), (100019, "=" * 700 + " " + "ab" * 900), (100020, "don't I'LL 've \x1c\x1f 123٣४½"),
    (100021, "9" * 20000), (100022, "you are a worthless idiot and a loser, you clown"),
    (100022, "you are a worthless idiot and a loser, you clown"), (100023, "\n".join(f"line {i % 7}" for i in range(400))),
]


@pytest.fixture(scope="session")
def small(spark, tmp_path_factory):
    """A folder of tables: the smallest documents with edge cases and extra columns."""
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = spark.createDataFrame([(d, t, "xx", "src", None if t is None else len(t)) for d, t in EDGE], docs.schema)
    both = docs.unionByName(extra)
    for name, value in (("label", 1), ("score", 0.5), ("base", "b"), ("spans", "s"), ("kept", True), ("_id", 7),
                        ("key", "k"), ("component_id", 3), ("text_sha256", "t"), ("features", 1), ("p", None)):
        both = both.selectExpr("*", f"CAST({value!r} AS STRING) AS `{name}`" if value is not None
                               else f"CAST(NULL AS STRING) AS `{name}`")
    both.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{SMALL}/labels.parquet").unionByName(spark.createDataFrame(
        [(None, 1, 0), (100001, None, None), (100022, 1, 1)],
        T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()),
                      T.StructField("toxic", T.IntegerType())])), allowMissingColumns=True
    ).write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="session")
def rows(spark, small):
    return [(r["doc_id"], r["text"]) for r in
            spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def empty(spark, small, tmp_path_factory):
    """The same tables without rows."""
    path = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels"):
        spark.read.parquet(f"{small}/{name}.parquet").limit(0).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.fixture(scope="session")
def nameless(spark, small, tmp_path_factory):
    """The same tables with rows that have no doc_id."""
    path = str(tmp_path_factory.mktemp("nameless"))
    docs = spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 30 or doc_id > 100005")
    docs.selectExpr("CASE WHEN doc_id % 4 <> 0 THEN doc_id END AS doc_id",
                    *[f"`{c}`" for c in docs.columns[1:]]).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{small}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path
