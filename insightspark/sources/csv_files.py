"""CSV load with dataframe-style null tokens and type inference."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from insightspark.errors import DataIngestionError
from insightspark.functions.kinds import column
from insightspark.functions.text import strip
from insightspark.sources.csv_records import ends_inside, record_texts

# The cell texts a dataframe CSV reader takes as missing.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# The cell texts read as booleans.
BOOLEAN_TOKENS = ["True", "TRUE", "true", "False", "FALSE", "false"]

_INTEGER = r"^[+-]?\d+$"
# Python's spelling of a float; a cast alone would also take Java's 1d and 1f.
_FLOAT = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))$"

# One bit per kind of cell; a column's type follows from the bits seen in it.
_IS_INTEGER, _IS_DOUBLE, _IS_BOOLEAN, _IS_TEXT = 1, 2, 4, 8
_COLUMNS_AT_ONCE = 20
_OVERFLOW = "\u0000overflow"

_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "enforceSchema": "true", "mode": "PERMISSIVE"}


class _Files(NamedTuple):
    """Files that are read alike: the names in their headers, and whether quotes hold line breaks."""

    paths: list[str] | str
    names: list[str]
    multi_line: bool


def load_table(spark: SparkSession, path, schema: T.StructType | str | None = None) -> DataFrame:
    """Read a CSV file, folder or list of them into a typed table.

    A first scan takes every file's header and looks for line breaks inside
    quotes; files that have some are still split, see ``csv_records``.  Headers may
    differ in order, and cells go by name.  Without a ``schema`` one aggregation over
    all cells settles the types; with one, it counts the cells that do not fit.

    Raises ``DataIngestionError`` if nothing can be read, if there are no rows,
    if the files' names or those of the schema differ, if rows have more cells than
    their header, or if cells do not fit the declared type.
    """
    try:
        groups = _alike(spark, path)
        names = groups[0].names
        for other in groups[1:]:
            if sorted(other.names) != sorted(names):
                raise DataIngestionError(f"Could not parse file: headers {names} and {other.names} in one table")
        raw = reduce(DataFrame.unionByName, [_read_text(spark, g.paths, g.names, g.multi_line) for g in groups])
        if schema is None:
            return infer_types(raw)
        declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if sorted(declared.names) != sorted(names):
            raise DataIngestionError(f"Could not parse file: header {names} instead of the declared {declared.names}")
        return _fitting(raw, declared)
    except (AnalysisException, PySparkException) as error:
        raise DataIngestionError(f"Could not parse file: {error}") from error


def _alike(spark: SparkSession, path) -> list[_Files]:
    """The files of a table by header and by line breaks inside quotes; one group is the rule."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    opens = F.col("value").contains('"') & ends_inside(F.col("value"), False)
    starts = F.col("_metadata.file_block_start") == 0
    files = (
        lines.select(F.col("_metadata.file_path").alias("file"), "value", opens.alias("open"), starts.alias("starts"))
        .withColumn("place", F.monotonically_increasing_id())
        .groupBy("file")
        .agg(F.min_by("value", F.when(F.col("starts"), F.col("place"))).alias("header"), F.bool_or("open").alias("multi_line"))
    )
    kinds = files.groupBy("header", "multi_line").agg(F.min("file").alias("file")).orderBy("file").collect()
    if not kinds:
        raise DataIngestionError("The file contains no data.")
    found: dict[tuple[tuple[str, ...], bool], list[str]] = {}
    for header, multi_line, file in kinds:
        found.setdefault((tuple(_header(spark, file, header, multi_line)), multi_line), []).append(header)
    if len(found) == 1:
        ((names, multi_line),) = found
        return [_Files(path, list(names), multi_line)]
    # Like Spark's own list of input files, these lists are held by the driver.
    return [
        _Files([r.file for r in files.where(F.col("header").isin(headers) & (F.col("multi_line") == multi_line)).collect()], list(names), multi_line)
        for (names, multi_line), headers in found.items()
    ]


def _fitting(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """The declared table, after one aggregation has found that all cells fit."""
    unfit = [F.count_if(_unfit(f.name, f.dataType)).alias(f"unfit{i}") for i, f in enumerate(schema)]
    rows, extra, *counts = raw.agg(F.count(F.lit(1)), F.count(column(_OVERFLOW)), *unfit).first()
    if not rows:
        raise DataIngestionError("The file contains no data.")
    wrong = {f.name: n for f, n in zip(schema, counts) if n}
    if extra or wrong:
        raise DataIngestionError(
            f"Could not parse file: {extra} rows have more cells than the header; cells that do not fit by column: {wrong}"
        )
    return typed_cells(raw, schema)


def with_rejects(raw: DataFrame, schema: T.StructType, malformed: Column, rejects: str, more: Sequence[Column] = ()) -> DataFrame:
    """The declared columns, ``rejects`` and ``more``; ``rejects`` says what was wrong with a row, an empty list for a good one.

    "cells" stands for a wrong number of cells, else the names of the columns
    whose cell does not fit its type and is null.
    """
    problems = [F.when(malformed, "cells"), *[F.when(_unfit(f.name, f.dataType), f.name) for f in schema]]
    return raw.select(*[_typed(f.name, f.dataType) for f in schema], F.array_compact(F.array(*problems)).alias(rejects), *more)


def _unfit(name: str, kind: T.DataType) -> Column:
    """Whether a cell holds a value that its type cannot take."""
    value = F.when(~column(name).isin(NULL_TOKENS), column(name))
    return value.isNotNull() & _typed(name, kind).isNull()


def null_tokens_to_null(df: DataFrame) -> DataFrame:
    """Turn every cell that spells a missing value into a null."""
    return df.select(
        *[
            F.when(~column(f.name).isin(NULL_TOKENS), column(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else column(f.name)
            for f in df.schema
        ]
    )


def typed_cells(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """An all-text table with null tokens as nulls and the declared types."""
    return raw.select(*[_typed(f.name, f.dataType) for f in schema])


def infer_types(raw: DataFrame) -> DataFrame:
    """Type an all-text table: BIGINT, then DOUBLE, BOOLEAN, else STRING.

    Scans keep an OR over kind bits per column, so they shuffle one row per task.
    """
    names = [n for n in raw.columns if n != _OVERFLOW]
    if not names:
        raise DataIngestionError("The file contains no data.")
    cells = null_tokens_to_null(raw)
    bits: dict[str, int] = {}
    # A scan takes so many columns that its generated code stays small.
    for start in range(0, len(names), _COLUMNS_AT_ONCE):
        some = names[start : start + _COLUMNS_AT_ONCE]
        extra = F.count(column(_OVERFLOW)) if _OVERFLOW in raw.columns else F.lit(0)
        rows, overflow, *kinds = cells.agg(F.count(F.lit(1)), extra, *[F.bit_or(_cell_kind(column(n))) for n in some]).first()
        if not rows:
            raise DataIngestionError("The file contains no data.")
        if overflow:
            raise DataIngestionError(f"Could not parse file: {overflow} rows have more cells than the header")
        bits.update(zip(some, kinds))
    return cells.select(*[_typed(n, _column_type(bits[n])) for n in names])


def _read_text(spark: SparkSession, path, names: list[str], multi_line: bool) -> DataFrame:
    if multi_line:
        cells = ", ".join(f"c{i} STRING" for i in range(len(names) + 1))
        records = record_texts(spark, path).where(~F.col("first"))
        row = F.from_csv("record", cells, {k: v for k, v in _OPTIONS.items() if k in ("quote", "escape", "mode")})
        return records.select(row.alias("row")).select("row.*").toDF(*names, _OVERFLOW)
    fields = [T.StructField(n, T.StringType()) for n in [*names, _OVERFLOW]]
    return spark.read.options(**_OPTIONS).schema(T.StructType(fields)).csv(path)


def _header(spark: SparkSession, path: str, line: str, multi_line: bool) -> list[str]:
    """Header names; blanks and repeats are renamed as dataframe readers do."""
    if multi_line and line.count('"'):
        line = record_texts(spark, path).where("first").first()["record"]
    cells = next(csv.reader([line.removeprefix("\ufeff")], strict=False))
    names: list[str] = []
    for position, cell in enumerate(cells):
        name = base = cell if cell else f"Unnamed: {position}"
        repeat = 0
        while name in names:
            repeat += 1
            name = f"{base}.{repeat}"
        names.append(name)
    return names


def _cell_kind(cell: Column) -> Column:
    trimmed = strip(cell)
    # A failing cast costs an exception per cell, so patterns go first.
    return (
        F.when(cell.isNull(), 0)
        .when(trimmed.rlike(_INTEGER) & trimmed.try_cast("bigint").isNotNull(), _IS_INTEGER)
        .when(trimmed.rlike(_FLOAT), _IS_DOUBLE)
        .when(cell.isin(BOOLEAN_TOKENS), _IS_BOOLEAN)
        .otherwise(_IS_TEXT)
    )


def _column_type(bits: int) -> T.DataType:
    if bits == _IS_INTEGER:
        return T.LongType()
    if bits in (0, _IS_DOUBLE, _IS_INTEGER | _IS_DOUBLE):
        return T.DoubleType()
    if bits == _IS_BOOLEAN:
        return T.BooleanType()
    return T.StringType()


def _typed(name: str, kind: T.DataType) -> Column:
    cell = column(name)
    value = F.when(~cell.isin(NULL_TOKENS), cell)
    if isinstance(kind, T.StringType):
        return value.alias(name)
    return strip(value).try_cast(kind).alias(name)
