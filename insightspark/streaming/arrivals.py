"""Files that keep arriving, ingested and aggregated as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from insightspark.functions.kinds import column, key_text, present
from insightspark.functions.numbers import numpy_round
from insightspark.operators.clean import normalise_names, trim_strings
from insightspark.operators.revenue import REVENUE, partial_sums, total
from insightspark.sources.csv_files import with_rejects
from insightspark.streaming.changes import latest_changes

# Column in which the reader puts rows with too many or too few cells.
_MALFORMED = "_malformed"


def arriving_files(
    spark: SparkSession,
    folder: str,
    schema: T.StructType | str,
    kind: str = "csv",
    glob: str | None = None,
    files_per_trigger: int | None = None,
    rejects: str = "_rejects",
    arrived: str | None = None,
) -> DataFrame:
    """A stream of the rows of all files in ``folder``, old and new, with declared types.

    CSV cells are read as text and typed as in the batch loader, null tokens
    included.  A file whose header differs from the declared names stops the
    stream.  The column ``rejects`` lists what is wrong with a row: "cells" for a
    number of cells other than the header's, and the columns whose cell does not fit.
    A cell may hold line breaks in quotes: each file is read whole, by one task, and files are
    what a stream spreads over tasks.  ``arrived`` names a column for the time a file was last written.
    """
    declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    reader = spark.readStream.format(kind)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    time = [F.col("_metadata.file_modification_time").alias(arrived)] if arrived else []
    if kind != "csv":
        return reader.schema(declared).load(folder).select(*[column(n) for n in declared.names], *time)
    text = T.StructType([T.StructField(name, T.StringType()) for name in [*declared.names, _MALFORMED]])
    cells = reader.options(header=True, escape='"', multiLine=True, enforceSchema=False, columnNameOfCorruptRecord=_MALFORMED).schema(text).load(folder)
    return with_rejects(cells, declared, F.col(_MALFORMED).isNotNull(), rejects, time)


def clean_stream(rows: DataFrame) -> DataFrame:
    """The part of the cleaning that works row by row: names and whitespace.

    Dates come typed from the declared schema.  For duplicates see ``first_arrivals``.
    """
    return trim_strings(normalise_names(rows))


def row_key(rows: DataFrame, names: list[str]) -> Column:
    """A digest of the named columns; equal for equal rows, nulls equal to nulls and 0.0 to -0.0."""

    def text(name: str) -> Column:
        kind, value = rows.schema[name].dataType, column(name)
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            value = F.when(value == 0, F.lit(0.0)).otherwise(value)
        if isinstance(kind, T.BinaryType):
            return F.hex(value)
        if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
            return F.to_json(value, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"})
        return value.cast("string")

    return F.unhex(F.sha2(F.to_json(F.array(*[text(n) for n in names])), 256))


def first_arrivals(rows: DataFrame, within: str, arrived: str = "_arrived") -> DataFrame:
    """The stream without rows that are equal, but for ``arrived``, to one that came before.

    The state is a digest per different row, kept until files are ``within`` (such as '30 days') newer than the
    row's own; a copy that comes later than that is a new row.
    """
    key = "_row_key"
    named = rows.withColumn(key, row_key(rows, [n for n in rows.columns if n != arrived]))
    return named.withWatermark(arrived, within).dropDuplicatesWithinWatermark([key]).drop(key)


def revenue_changes(rows: DataFrame, dimension: str, revenue: str = REVENUE) -> DataFrame:
    """Streaming (key, exact, wild): running revenue sums per key."""
    kind = rows.schema[dimension].dataType
    key = present(dimension, kind)
    return rows.where(key.isNotNull()).groupBy(key_text(key, kind).alias("key")).agg(*partial_sums(rows, revenue))


def revenue_so_far(spark: SparkSession, folder: str) -> DataFrame:
    """(key, revenue) from the written changes."""
    newest = latest_changes(spark, folder, ["key"])
    return newest.select("key", numpy_round(total(), 2).alias("revenue"))
