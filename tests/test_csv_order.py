import os
import uuid

import pytest

from riskloom.sources import csv as CSV
from riskloom.sources import store


def _file(path, text):
    path.write_text(text)
    return str(path)


def test_a_row_with_too_many_fields_raises_as_in_pandas(spark, tmp_path):
    import pandas as pd
    path = _file(tmp_path / "x.csv", 'a,b\n1,x\n3,4,5\n2,"y,z"\n')
    with pytest.raises(pd.errors.ParserError):
        pd.read_csv(path)
    for use in (lambda d: d.count(), lambda d: d.select("b").collect(), lambda d: d.collect()):
        with pytest.raises(Exception, match="expected 2 fields: 3,4,5"):
            use(CSV.read_csv(spark, path, "a bigint, b string"))


def test_short_rows_and_quoted_commas_are_fine(spark, tmp_path):
    path = _file(tmp_path / "x.csv", 'a,b,c\n1,"p,q",r\n2\n3,"say ""hi, you""",\n"4,5",NA,x\n')
    rows = CSV.read_csv(spark, path).collect()
    assert [tuple(r) for r in rows] == [("1", "p,q", "r"), ("2", None, None), ("3", 'say "hi, you"', None), ("4,5", None, "x")]


def test_rows_and_rejects_are_the_file(spark, tmp_path):
    text = "a,b\n1,x\n3,4,5\nq,1\n7\n,\n8,\"a,b\",\n9,NA\n1.5,z\n"
    path = _file(tmp_path / "x.csv", text)
    rows, rejects = CSV.read_csv_rejects(spark, path, "a bigint, b string")
    assert [tuple(r) for r in rows.collect()] == [(1, "x"), (7, None), (None, None), (9, None)]
    bad = sorted((r["reason"], r["raw"] or "") for r in rejects.collect())
    assert bad == [("column a: not a bigint: 1.5", ""), ("column a: not a bigint: q", ""),
                   ("expected 2 fields, saw 3", "3,4,5"), ("expected 2 fields, saw 3", '8,"a,b",')]
    assert rows.count() + rejects.count() == text.count("\n") - 1


@pytest.mark.parametrize("n", [1, 10, 23, 500])
def test_cap_keeps_the_first_rows(spark, tmp_path, n):
    folder = tmp_path / "t"
    os.makedirs(folder)
    for i in range(5):
        _file(folder / f"part-{i}.csv", "k,v\n" + "".join(f"{i * 10 + j},{'z' if j % 2 else 'a'}\n" for j in range(10)))
    got = [r.k for r in CSV.read_csv(spark, str(folder), num_rows=n).collect()]
    assert got == list(range(min(n, 50)))


def test_order_within_a_large_file_cut_into_blocks(spark, tmp_path):
    from riskloom.operators.encode import factorize
    names = [f"v{(i * 7919) % 1000}" for i in range(30_000)]
    path = _file(tmp_path / "big.csv", "k,v\n" + "".join(f"{(i * 31) % 30000},{v}\n" for i, v in enumerate(names)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        df = CSV.read_csv(spark, path, "k bigint, v string", order="place")
        assert df.rdd.getNumPartitions() > 3
        coded = factorize(df, ["v"], order_by="place").select("k", "v").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    first = {}
    for v in names:
        first.setdefault(v, len(first))
    assert {r.k: r.v for r in coded} == {(i * 31) % 30000: first[v] for i, v in enumerate(names)}


def test_a_step_written_twice_has_each_metric_once(spark):
    path = store.scratch_path(spark, "metrics")
    run = uuid.uuid4().hex
    store.log_metrics(spark, path, run, {"AUC": 0.5, "a b/c=d": 1.0})
    store.log_metrics(spark, path, run, {"AUC": 0.7})
    store.log_metrics(spark, path, run, {"AUC": 0.8}, step=1)
    store.log_metrics(spark, path, "other", {"AUC": 0.1})
    store.log_metrics(spark, path, "other", {})
    frame = spark.createDataFrame([("loss", 2.0), ("AUC", 0.9)], "metric string, value double")
    for _ in range(2):
        store.log_metric_frame(frame, path, run, step=2)
    got = sorted((r.run_id == run, r.step, r.metric, r.value) for r in store.read_metrics(spark, path).collect())
    assert got == [(False, 0, "AUC", 0.1), (True, 0, "AUC", 0.7), (True, 0, "a b/c=d", 1.0), (True, 1, "AUC", 0.8),
                   (True, 2, "AUC", 0.9), (True, 2, "loss", 2.0)]
