"""Persisted artifacts: fitted models, preprocessing statistics and
run metrics (S4, S5), all in the shared folder the cluster names."""

from __future__ import annotations

import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never a
    machine-local temporary folder: executors must see it)."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/riskloom-scratch/{name}-{uuid.uuid4().hex[:12]}"


#: Spark's setting by which a query's shuffle files go when it ends
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_released(spark: SparkSession):
    """Queries that are planned and run within leave no shuffle files: else they stay until the
    driver collects its garbage, while every exchange adds some files a partition."""
    before = spark.conf.get(RELEASE, "false")
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.set(RELEASE, before)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the planner then knows its
    size, and a lost executor does not recompute it."""
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_buckets(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """Write ``df`` to the shared folder as a table bucketed by ``keys`` and sorted by them
    inside each bucket, and read it back: joins and aggregates on the keys with tables of
    as many buckets need no exchange. Rows that are already dealt by the keys into as many
    partitions (as after an aggregate or a join on them) give one file a bucket."""
    path = scratch_path(df.sparkSession, "buckets")
    name = f"riskloom_{path.rsplit('-', 1)[1]}"
    (df.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
     .option("path", path).saveAsTable(name))
    return df.sparkSession.table(name)


#: (application, name, state of the files) -> folder, see ``stored_once``
_STORED: dict[tuple, str] = {}


def files_state(spark: SparkSession, paths: list[str]) -> tuple:
    """Path, size and time of change of every file under ``paths``."""
    jvm, conf, out = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        found = path.getFileSystem(conf).listFiles(path, True)
        while found.hasNext():
            f = found.next()
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def stored_once(spark: SparkSession, name: str, paths: list[str], build) -> DataFrame:
    """``build()`` as a table in the shared folder, for all that need it in this
    application; made anew when a file under ``paths``, its inputs, has changed."""
    key = (spark.sparkContext.applicationId, name, files_state(spark, paths))
    if key not in _STORED:
        path = scratch_path(spark, name)
        build().write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def save_model(model, path: str) -> None:
    """Spark ML model or pipeline model, overwriting."""
    model.write().overwrite().save(path)


def load_gbt(path: str):
    from pyspark.ml.classification import GBTClassificationModel
    return GBTClassificationModel.load(path)


def save_prep(spark: SparkSession, prep, path: str) -> None:
    """Fitted imputer/scaler statistics as a parquet table."""
    prep.to_frame(spark).write.mode("overwrite").parquet(path)


def load_prep(spark: SparkSession, path: str):
    from riskloom.operators.prep import PrepModel
    return PrepModel.from_frame(spark.read.parquet(path))


METRICS_SCHEMA = "run_id string, metric string, value double, ts bigint, step bigint"
METRICS_KEY = ["run_id", "step", "metric"]


def _log(rows: DataFrame, path: str) -> None:
    """Writes the rows' (run, step, metric) partitions anew and leaves all others, so a
    step that is written twice, by a retry or on purpose, has each metric once."""
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*METRICS_KEY)
     .parquet(path))


def log_metrics(spark: SparkSession, path: str, run_id: str, metrics: dict[str, float],
                step: int = 0) -> None:
    """(run_id, metric, value, ts, step) rows into a partitioned Parquet table (S5); an
    earlier value of the same run, step and metric is replaced."""
    ts = int(time.time() * 1000)
    rows = [(run_id, k, float(v), ts, step) for k, v in metrics.items()]
    if rows:
        _log(spark.createDataFrame(rows, METRICS_SCHEMA), path)


def log_metric_frame(df: DataFrame, path: str, run_id: str, step: int = 0) -> None:
    """Metrics held in a (metric, value) DataFrame, without collecting them."""
    _log(df.select(F.lit(run_id).alias("run_id"), F.col("metric"), F.col("value").cast("double").alias("value"),
                   (F.unix_timestamp() * 1000).cast("bigint").alias("ts"), F.lit(step).cast("bigint").alias("step")), path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    names = [c.split()[0] for c in METRICS_SCHEMA.split(", ")]
    return spark.read.schema(METRICS_SCHEMA).parquet(path).select(*names)
