"""Data audit: missing and infinite cell counts, column profile, shape.

The functions that take a table scan it. ``observed`` gathers all of these
facts while some other action, such as writing the table, runs over it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from riskloom.functions.exprs import INF, NEG_INF, double_sql, is_floating, qcol, quoted


def _missing(f) -> F.Column:
    c = qcol(f.name)
    return (c.isNull() | F.isnan(c)) if is_floating(f.dataType) else c.isNull()


def null_count(df: DataFrame) -> DataFrame:
    """Total missing cells over the table, one row ``null_cells``."""
    terms = [F.count_if(_missing(f)) for f in df.schema.fields]
    return df.agg(sum(terms[1:], terms[0]).alias("null_cells"))


def inf_count(df: DataFrame) -> DataFrame:
    """Total +-inf cells over the numeric columns, one row ``inf_cells``."""
    terms = [F.count_if(qcol(f.name).isin(F.lit(INF), F.lit(NEG_INF)))
             for f in df.schema.fields if is_floating(f.dataType)]
    total = sum(terms[1:], terms[0]) if terms else F.lit(0).cast("bigint")
    return df.agg(total.alias("inf_cells"))


def column_profile(df: DataFrame) -> DataFrame:
    """(column, type, non_null) per column (A18, ``df.info()``): one wide
    aggregate, then ``stack`` to rows."""
    fields = df.schema.fields
    wide = df.agg(*[F.count_if(~_missing(f)).alias(f"c{i}") for i, f in enumerate(fields)])
    args = ", ".join(f"'{f.name.replace(chr(39), chr(39) * 2)}', '{f.dataType.simpleString()}', c{i}"
                     for i, f in enumerate(fields))
    return wide.selectExpr(f"stack({len(fields)}, {args}) AS (column_name, data_type, non_null)")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per value."""
    return df.groupBy(qcol(col)).agg(F.count(F.lit(1)).alias("n"))


def table_shape(df: DataFrame) -> DataFrame:
    """(n_rows, n_cols) as a one-row DataFrame."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_cols", F.lit(len(df.columns)).cast("bigint"))


@dataclass
class Audit:
    """What was seen of a table by the first action on it; reading waits for that action."""
    fields: list[StructField]
    observation: Observation

    @property
    def n_rows(self) -> int:
        return self.observation.get["rows"]

    @property
    def null_cells(self) -> int:
        return sum(self.n_rows - self.observation.get[f"c{i}"] for i in range(len(self.fields)))

    @property
    def inf_cells(self) -> int:
        return sum(self.observation.get[f"i{i}"] for i, f in enumerate(self.fields) if is_floating(f.dataType))

    def frames(self, spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """The tables of ``column_profile``, ``null_count``, ``inf_count`` and ``table_shape``."""
        rows = [(f.name, f.dataType.simpleString(), self.observation.get[f"c{i}"]) for i, f in enumerate(self.fields)]
        return (spark.createDataFrame(rows, "column_name string, data_type string, non_null long"),
                spark.createDataFrame([(self.null_cells,)], "null_cells long"),
                spark.createDataFrame([(self.inf_cells,)], "inf_cells long"),
                spark.createDataFrame([(self.n_rows, len(self.fields))], "n_rows long, n_cols long"))


def observed(df: DataFrame) -> tuple[DataFrame, Audit]:
    """(df, audit): the same rows, and the audit that the first action on them fills."""
    fields, facts = df.schema.fields, ["count(1) AS rows"]
    for i, f in enumerate(fields):
        c = quoted(f.name)
        present = f"{c} IS NOT NULL AND NOT isnan({c})" if is_floating(f.dataType) else f"{c} IS NOT NULL"
        facts.append(f"count_if({present}) AS c{i}")
        if is_floating(f.dataType):
            facts.append(f"count_if(abs({c}) = {double_sql(INF)}) AS i{i}")
    seen = Observation()
    return df.observe(seen, *[F.expr(x) for x in facts]), Audit(fields, seen)
