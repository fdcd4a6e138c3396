"""Imputation and scaling as a pipeline stage, so that preparation and booster
are fitted, saved and loaded as one ``PipelineModel`` (E6, S4).

``Prepare`` fits the statistics of ``operators.prep`` in one aggregate;
``Prepared`` adds the imputed and scaled features as one vector column, in a
projection of SQL text. Both are written as Spark ML writes its own stages
(parameters as JSON), doubles in full.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators import prep as PR


class Prepare(Estimator, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Mean imputer and min-max scaler of ``inputCols``; columns without a value are left out."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol="features"):
        super().__init__()
        self._setDefault(outputCol="features")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> Prepared:
        m = PR.fit_prep(df, self.getInputCols())
        values = {name: [getattr(m, name)[c] for c in m.features] for name in ("mean", "lo", "hi")}
        return Prepared(inputCols=m.features, outputCol=self.getOutputCol(), dropped=m.dropped, **values)


class Prepared(Model, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    mean = Param(Params._dummy(), "mean", "mean of each input column", TypeConverters.toListFloat)
    lo = Param(Params._dummy(), "lo", "least value of each input column", TypeConverters.toListFloat)
    hi = Param(Params._dummy(), "hi", "largest value of each input column", TypeConverters.toListFloat)
    dropped = Param(Params._dummy(), "dropped", "input columns without a value", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol="features", mean=None, lo=None, hi=None, dropped=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def statistics(self) -> PR.PrepModel:
        names = self.getInputCols()
        per = {k: dict(zip(names, self.getOrDefault(k))) for k in ("mean", "lo", "hi")}
        return PR.PrepModel(list(names), per["mean"], per["lo"], per["hi"], list(self.getOrDefault("dropped")))

    def _transform(self, df: DataFrame) -> DataFrame:
        scaled = ", ".join(e.rsplit(" AS ", 1)[0] for e in self.statistics().scale_exprs())
        return df.withColumn(self.getOutputCol(), array_to_vector(F.expr(f"array({scaled})")))


def fit_pipeline(df: DataFrame, features, estimator) -> PipelineModel:
    """Preparation and ``estimator`` (of the vector column ``features``) fitted on all rows."""
    return Pipeline(stages=[Prepare(inputCols=list(features)), estimator]).fit(df)
