"""The fixed sequences: file to table, table to findings, questions to context."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from insightspark.operators import chart_data, chunking, profile, revenue, revenue_sets, search, vectors
from insightspark.operators.clean import clean_table
from insightspark.operators.questions import suggested_for
from insightspark.session import write_once
from insightspark.sources.csv_files import load_table
from insightspark.sources.payloads import json_rows


def open_table(spark: SparkSession, path, schema=None) -> DataFrame:
    """Load and clean a file once; the written copy feeds everything after it."""
    return write_once(clean_table(load_table(spark, path, schema)), "cleaned")


def upload_summary(table: DataFrame) -> tuple[int, list[str]]:
    """Row count and suggested questions of an opened table."""
    return table.count(), suggested_for(table)


def findings(table: DataFrame, approximate: bool = False) -> dict[str, DataFrame]:
    """The profile, the five revenue aggregates and the chart data of an opened table."""
    return {
        **profile.profile_table(table, approximate),
        **revenue_findings(table),
    }


def revenue_findings(table: DataFrame, segment: str = chart_data.SEGMENT) -> dict[str, DataFrame]:
    """The five revenue aggregates and the chart data, all from one scan of the table."""
    sets = revenue_sets.RevenueSets(table, ["build_category", "region", "vehicle_platform", "year"], [("build_category", "year")])
    return {
        "revenue_by_build_category": sets.by_dimension("build_category"),
        "revenue_by_region": sets.by_dimension("region"),
        "revenue_by_year": sets.trend("year"),
        "growth_rates": sets.growth("build_category", "year"),
        "top_vehicles": sets.top("vehicle_platform"),
        "charts": sets.charts("build_category", "region", "year", segment),
    }


def finding_rows(parts: dict[str, DataFrame]) -> DataFrame:
    """(section, row): all findings as JSON rows, for prompts and payloads."""
    sections = [json_rows(part).select(F.lit(name).alias("section"), "row") for name, part in parts.items()]
    return reduce(DataFrame.unionByName, sections)


def run_contexts(
    runs: DataFrame,
    chunks: DataFrame,
    make_embedding: Callable[[], vectors.Embed],
    k: int = vectors.TOP_K,
    anchors: list[str] = search.ANCHORS,
) -> DataFrame:
    """(run_id, context): the search queries of each run and the chunks they find.

    ``runs`` has (run_id, question, findings); ``chunks`` (chunk_id, chunk,
    embedding).
    """
    queries = search.search_queries(runs.select("run_id", "question", "findings"), anchors=anchors)
    numbered = queries.withColumn("query_id", F.concat_ws("/", F.col("run_id").cast("string"), F.col("query_idx").cast("string")))
    asked = write_once(vectors.embed(numbered, make_embedding, text="query"), "queries")
    top = vectors.cosine_topk(chunks, asked, k)
    blocks = vectors.context_blocks(vectors.retrieve(chunks, top))
    per_run = asked.select("run_id", "query_idx", "query_id").join(blocks, "query_id")
    return vectors.run_contexts(runs, per_run)


def embedded_corpus(documents: DataFrame, make_embedding: Callable[[], vectors.Embed], fail_fast: bool = True) -> DataFrame:
    """(source_file, chunk_idx, chunk, chunk_id, embedding) of loaded documents, written once."""
    chunks, _ = chunking.corpus(documents, fail_fast=fail_fast)
    named = chunks.withColumn("chunk_id", F.concat_ws("#", "source_file", F.format_string("%09d", "chunk_idx")))
    embedded = write_once(vectors.embed(named, make_embedding), "corpus")
    vectors.check_dims(embedded)
    return embedded
