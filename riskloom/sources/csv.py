"""CSV scan and sink with the reference's missing-value rules.

pandas reads '', 'NA', 'NULL', 'nan', 'N/A' and similar cells as missing,
doubles quotes inside quoted cells, and keeps a cell such as 2.0 in an
integer column. Every cell is read as text; the null tokens become NULL,
and only then cells are converted, so a token never decides a column's
type. With a schema, a cell that does not convert raises; without one,
types are found in one pass over the text: bigint, double or string (a
date stays text, hence categorical, as in pandas).

A row with too many fields is malformed: pandas raises, and so does
``read_csv``; ``read_csv_rejects`` returns such rows, and those with a cell
that does not convert, in a table of their own. A row with too few fields
is filled up with missing cells, as in pandas.

Rows of a file have an order though Spark's rows have none: ``input_order``
names it by file, block and place in the block. ``num_rows`` keeps the
first rows of that order (of a folder: of its files by name), and
``order`` hands the column on, for codes by first appearance.

Always pass a schema at scale: finding types reads the data twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (DoubleType, FloatType, IntegralType, LongType, StringType, StructField,
                               StructType)

from riskloom.functions.exprs import qcol

# Cells pandas' read_csv treats as missing by default (fixed list).
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
               "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
WHOLE = r"^\s*[+-]?[0-9]+\s*$"
NUMBER = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?|inf|Infinity)\s*$"


#: the raw text of a row whose number of fields is not the header's
CORRUPT = "_rl_corrupt"
QUOTED = '"(?:[^"]|"")*"'


def _reader(spark: SparkSession, multi_line: bool):
    """Quotes inside a quoted cell are doubled."""
    return (spark.read.option("header", True).option("quote", '"').option("escape", '"')
            .option("multiLine", multi_line).option("mode", "PERMISSIVE"))


def _texts(spark: SparkSession, path, names, multi_line: bool) -> DataFrame:
    """Every cell as text, and CORRUPT."""
    if names is None:
        names = _reader(spark, multi_line).csv(path).columns
    schema = StructType([StructField(n, StringType()) for n in [*names, CORRUPT]])
    # a pruned row would not show that it has too many fields
    return (_reader(spark, multi_line).option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False)
            .schema(schema).csv(path))


def _n_fields() -> Column:
    """Fields of the raw text: commas outside of quotes, and one."""
    return F.size(F.split(F.regexp_replace(F.col(CORRUPT), QUOTED, ""), ",", -1))


def _too_many(names) -> Column:
    return F.col(CORRUPT).isNotNull() & (_n_fields() > len(names))


#: the column that names a row's place in the input
INPUT_ORDER = "_rl_order"


def input_order(parquet: bool = False) -> Column:
    """Place of a row in the files of a scan: file, block, place in the block (of a Parquet
    file: in the file). To be taken on the scan itself, before rows are moved."""
    file = F.col("_metadata.file_path").alias("file")
    if parquet:
        return F.struct(file, F.lit(0).cast("long").alias("block"), F.col("_metadata.row_index").alias("row"))
    return F.struct(file, F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def _first_rows(spark: SparkSession, path: str, names, multi_line: bool, n: int, order: str) -> DataFrame:
    """The first ``n`` rows by file name and place; only as many files are read as hold them."""
    files = sorted(_reader(spark, multi_line).csv(path).inputFiles())
    upto = 1
    while True:
        texts = _texts(spark, files[:upto] or path, names, multi_line).withColumn(order, input_order())
        texts = texts.orderBy(order).limit(n)
        if upto >= len(files) or texts.count() >= n:
            return texts
        upto *= 2


def _converted(field: StructField) -> tuple[Column, Column]:
    """(value, whether the cell does not convert)."""
    c = qcol(field.name)
    t = field.dataType
    if isinstance(t, StringType):
        return c, F.lit(False)
    if isinstance(t, IntegralType):
        # 2.0 is 2; 2.5 or text is an error
        number = c.try_cast("double")
        out = F.coalesce(c.try_cast(t), F.when(number == F.floor(number), number.try_cast(t)))
    elif isinstance(t, (DoubleType, FloatType)):
        out = c.try_cast(t)
        out = F.when(F.isnan(out), F.lit(None).cast(t)).otherwise(out)
    else:
        out = c.try_cast(t)
    return out, c.isNotNull() & out.isNull() & ~c.rlike("(?i)^[+-]?nan$")


def _not_a(field: StructField) -> Column:
    return F.concat(F.lit(f"column {field.name}: not a {field.dataType.simpleString()}: "), qcol(field.name))


def _convert(field: StructField) -> Column:
    out, bad = _converted(field)
    if isinstance(field.dataType, StringType):
        return out
    return F.when(bad, F.raise_error(_not_a(field)).cast(field.dataType)).otherwise(out)


def infer(texts: DataFrame) -> StructType:
    """bigint where every present cell is a whole number, double where all are numbers,
    string otherwise (also where no cell is present), in one aggregate."""
    facts = []
    for i, n in enumerate(texts.columns):
        c = qcol(n)
        facts += [F.min(F.when(c.isNotNull(), c.rlike(WHOLE) & c.try_cast("bigint").isNotNull())).alias(f"w{i}"),
                  F.min(F.when(c.isNotNull(), c.rlike(NUMBER))).alias(f"n{i}")]
    row = texts.agg(*facts).first()
    kind = lambda i: LongType() if row[f"w{i}"] else DoubleType() if row[f"n{i}"] else StringType()
    return StructType([StructField(n, kind(i)) for i, n in enumerate(texts.columns)])


def _cells(texts: DataFrame, names, tokens) -> list[Column]:
    return [F.when(qcol(n).isin(list(tokens)), F.lit(None)).otherwise(qcol(n)).alias(n) for n in names]


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None,
             num_rows: int | None = None, tokens=NULL_TOKENS, multi_line: bool = False,
             order: str | None = None) -> DataFrame:
    """Header CSV -> DataFrame (S1), optional debug row cap (S2): the first ``num_rows``
    rows. ``multi_line``: cells may hold line breaks (a file is then read by one task).
    ``order``: name of a column for the rows' places in the input. A row with too many
    fields raises, whatever columns are used."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    place = order or INPUT_ORDER
    names = None if schema is None else schema.names
    texts = _texts(spark, path, names, multi_line).withColumn(place, input_order()) if num_rows is None \
        else _first_rows(spark, path, names, multi_line, num_rows, place)
    names = [c for c in texts.columns if c not in (place, CORRUPT)]
    # the first cell is part of the message, so the scan never reads the raw text alone
    message = F.concat(F.lit(f"expected {len(names)} fields: "), F.col(CORRUPT), F.lit(" at "), F.coalesce(qcol(names[0]), F.lit("")))
    texts = texts.where(F.when(_too_many(names), F.raise_error(message).cast("boolean")).otherwise(True))
    keep = [F.col(place)] if order else []
    texts = texts.select(*_cells(texts, names, tokens), *keep)
    types = schema if schema is not None else infer(texts.select(*[qcol(n) for n in names]))
    return texts.select(*[_convert(f).alias(f.name) for f in types.fields], *keep)


def read_csv_rejects(spark: SparkSession, path: str, schema: StructType | str, tokens=NULL_TOKENS,
                     multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): every row of the files is in one of the two. Rejects: file, cells
    (as read), raw (of rows with another number of fields than the header), reason."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    texts = _texts(spark, path, schema.names, multi_line).withColumn("_rl_file", F.col("_metadata.file_path"))
    cells = texts.select(*_cells(texts, schema.names, tokens), CORRUPT, "_rl_file")
    reasons = [F.when(_too_many(schema.names), F.concat(F.lit(f"expected {len(schema.names)} fields, saw "), _n_fields()))]
    reasons += [F.when(_converted(f)[1], _not_a(f)) for f in schema.fields if not isinstance(f.dataType, StringType)]
    judged = cells.withColumn("_rl_reason", F.coalesce(*reasons))
    rows = judged.where(F.col("_rl_reason").isNull()).select(*[_converted(f)[0].alias(f.name) for f in schema.fields])
    rejects = judged.where(F.col("_rl_reason").isNotNull()).select(
        F.col("_rl_file").alias("file"), F.to_json(F.struct(*[qcol(n) for n in schema.names])).alias("cells"),
        F.col(CORRUPT).alias("raw"), F.col("_rl_reason").alias("reason"))
    return rows, rejects


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", null_value: str = "") -> None:
    """CSV with header and no index column (S3): a directory of part files written by
    the tasks. Quotes inside a cell are doubled; a missing cell is ``null_value``."""
    (df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
     .option("nullValue", null_value).option("emptyValue", "").csv(path))
