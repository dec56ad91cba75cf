"""Vectors by content: a table of text digests and vectors, so that a text is embedded once, whatever loads it comes in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from insightspark.functions.kinds import column
from insightspark.operators.vectors import Embed, embed

_DIGEST = "_digest"
_SCHEMA = "_digest binary, vector array<float>"


def stored_vectors(spark: SparkSession, store: str) -> DataFrame:
    """The store's digests and vectors, one row per digest; empty where nothing was stored yet."""
    try:
        rows = spark.read.schema(_SCHEMA).parquet(store)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _SCHEMA)
    # Loads at the same time may both store a text.
    return rows.groupBy(_DIGEST).agg(F.first("vector").alias("vector"))


def embed_new(df: DataFrame, store: str, make: Callable[[], Embed], text: str = "chunk", vector: str = "embedding") -> DataFrame:
    """Add an ARRAY<FLOAT> column, embedding only texts that ``store`` does not hold, once each, and storing their vectors.

    Texts meet by digest: only those that are new are shuffled, copies of one in each task before.  A null text has no vector.
    """
    spark = df.sparkSession
    digest = F.unhex(F.sha2(column(text), 256))
    texts = df.select(digest.alias(_DIGEST), column(text).alias("text")).where(F.col("text").isNotNull())
    known = stored_vectors(spark, store).select(_DIGEST)
    new = texts.join(known, _DIGEST, "left_anti").groupBy(_DIGEST).agg(F.first("text").alias("text"))
    embed(new, make, text="text", vector="vector").select(_DIGEST, "vector").write.mode("append").parquet(store)
    named = df.withColumn(_DIGEST, digest)
    return named.join(stored_vectors(spark, store).withColumnRenamed("vector", vector), _DIGEST, "left").select(*[column(n) for n in df.columns], column(vector))
