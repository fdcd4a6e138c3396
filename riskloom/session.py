"""Session helpers.

The cluster names a shared checkpoint folder in ``spark.checkpoint.dir``.
We read it from the session and only fall back to a fresh scratch
folder when it is unset (local tests).
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


# Settings for a large cluster (not applied by get_spark; pass them to the
# session builder or spark-submit). Sizes follow the shuffle volume of the
# widest roll-up: start with many partitions and let AQE coalesce them to
# the advisory size; split skewed join partitions; keep the broadcast
# threshold modest since roll-ups are wide rows.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.codegen.maxFields": "1000",
    "spark.sql.session.timeZone": "UTC",
}


def get_spark(master: str = "local[8]", shuffle_partitions: int = 8,
              app_name: str = "riskloom", extra: dict | None = None) -> SparkSession:
    """Session for local runs and tests (cluster jobs use their own)."""
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = "16g"
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder: the session's ``spark.checkpoint.dir``. Where that is
    unset, a new scratch folder in local mode; elsewhere executors could not see one,
    so it raises."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="riskloom-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()
