import os
import subprocess
import sys

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskloom.operators import profile as P
from riskloom.operators import prep as PR
from riskloom.operators.model import GBTParams
from riskloom.operators.stages import fit_pipeline
from riskloom.sources import store

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _data(spark):
    return spark.range(300).select(
        F.col("id").alias("k"), F.when(F.col("id") % 5 != 0, F.col("id") % 17).alias("odd `name"), F.sin("id").alias("x2"),
        F.lit(4.0).alias("const"), F.lit(None).cast("double").alias("none"),
        (F.col("id") % 17 > 9).cast("double").alias("TARGET"))


def test_one_saved_pipeline_scores_equally_in_a_fresh_session(spark, tmp_path):
    df, feats = _data(spark), ["odd `name", "x2", "const", "none"]
    model = fit_pipeline(df, feats, GBTParams(max_iter=3, max_depth=2, min_child_weight=0.0).estimator(label_col="TARGET"))
    statistics, alone = model.stages[0].statistics(), PR.fit_prep(df, feats)
    assert statistics == alone and statistics.dropped == ["none"]
    path, rows = str(tmp_path / "m"), str(tmp_path / "rows")
    store.save_model(model, path)
    scored = model.transform(df).withColumn("score", vector_to_array("probability")[1])
    scored.drop("features", "rawPrediction", "probability", "prediction").write.parquet(rows)
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from riskloom.session import get_spark
spark = get_spark(master="local[2]", shuffle_partitions=2)
df = spark.read.parquet({rows!r})
out = PipelineModel.load({path!r}).transform(df).select("score", vector_to_array("probability")[1].alias("again"))
assert out.count() == 300 and out.where("score <> again").count() == 0
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=200, cwd=tmp_path)
    assert done.returncode == 0, done.stderr[-800:]


def test_the_audit_is_gathered_by_the_write(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), "a"), (None, float("inf"), None), (3, float("-inf"), "b"), (4, 1.0, "")],
                               "k long, `x y` double, s string").repartition(3)
    table, seen = P.observed(df)
    table.write.parquet(str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    for got, want in zip(seen.frames(spark), (P.column_profile(back), P.null_count(back), P.inf_count(back), P.table_shape(back))):
        assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert (seen.n_rows, seen.null_cells, seen.inf_cells) == (4, 3, 2)
    none, unseen = P.observed(df.limit(0))
    none.count()
    assert (unseen.n_rows, unseen.null_cells) == (0, 0)
