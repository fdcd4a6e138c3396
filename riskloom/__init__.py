"""riskloom: Spark-native credit-risk feature building and scoring.

Plain functions from DataFrame to DataFrame: built-in Spark SQL expressions
and Spark ML stages, and one grouped Python function for distances in kNN.

Layout
------
functions/  scalar expressions (IEEE division, sentinels, clamps, hashes)
sources/    CSV/parquet scans with null tokens, sinks, model and metric stores
operators/  aggregation specs, encoding, joins, profiling, ranking,
            sampling, preprocessing, metrics, SMOTE, model training
plans/      the composite feature pipelines and the registered query catalog
llm/        operators for preparing language-model training data (optional)
"""

from riskloom.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
