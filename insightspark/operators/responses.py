"""JSON answers of external models: parse, default, normalise.  All row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from insightspark.functions.numbers import bind, clamp
from insightspark.functions.text import strip, strip_fences
from insightspark.functions.variants import as_array, as_map, as_text, field_or, json_kind

# What the answers of the three model steps hold, and of which kind.
ANALYST_FIELDS = {
    "findings": "list", "summary": "text", "anomalies": "list", "data_quality_notes": "list", "recommended_deep_dives": "list",
}
RESEARCH_FIELDS = {
    "market_summary": "text", "market_findings": "list", "supporting_data_alignment": "text", "market_gaps": "list",
    "search_queries_used": "list",
}
INSIGHT_FIELDS = {"executive_summary": "text", "opportunities": "list", "risks": "list"}

DEFAULT_CONFIDENCE = 50


def parse_responses(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``response`` VARIANT and ``error``; exactly one of them is null.

    A fence around the JSON is removed first.  Anything but a JSON object is an
    error, also the NaN and Infinity that some parsers accept.
    """

    def checked(value: Column) -> Column:
        kind = json_kind(value)
        error = F.when(value.isNull(), "Invalid JSON").when(
            kind != "object", F.concat(F.lit("Expected a JSON object, found "), kind)
        )
        return F.struct(F.when(kind == "object", value).alias("response"), error.alias("error"))

    # As generated columns they are computed once: a later filter on them stays
    # above, where it would otherwise be pushed down and parse everything again.
    return df.select("*", F.inline(F.array(bind(F.try_parse_json(strip_fences(F.col(raw))), checked))))


def valid_responses(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("error").isNull()).drop("error")


def failed_responses(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("error").isNotNull()).drop("response")


def response_fields(df: DataFrame, fields: dict[str, str], response: str = "response") -> DataFrame:
    """Add one column per field: a missing list is empty, a missing text is "", a null stays null."""
    keyed = df.withColumn("_fields", as_map(F.col(response)))
    readers = {"list": (_texts, F.array().cast("array<string>")), "text": (as_text, F.lit(""))}
    added = [field_or(F.col("_fields"), name, *readers[kind]).alias(name) for name, kind in fields.items()]
    return keyed.select(*[F.col(c) for c in df.columns], *added)


def with_recommendations(df: DataFrame, response: str = "response") -> DataFrame:
    """Add ``recommendations`` ARRAY<STRUCT<rank, action, rationale, priority, timeframe>> with defaults."""
    listed = F.element_at(as_map(F.col(response)), F.lit("recommendations"))

    def normalised(fields: Column, position: Column) -> Column:
        return F.struct(
            field_or(fields, "rank", lambda v: as_text(v).try_cast("int"), position + 1).alias("rank"),
            field_or(fields, "action", as_text, F.lit("")).alias("action"),
            field_or(fields, "rationale", as_text, F.lit("")).alias("rationale"),
            field_or(fields, "priority", as_text, F.lit("medium")).alias("priority"),
            field_or(fields, "timeframe", as_text, F.lit("short_term")).alias("timeframe"),
        )

    items = F.transform(F.coalesce(as_array(listed), F.array().cast("array<variant>")), as_map)
    return df.withColumn("recommendations", F.transform(items, normalised))


def recommendation_rows(df: DataFrame) -> DataFrame:
    """One row per recommendation: the other columns, ``position`` (from 1) and its five fields."""
    rest = [F.col(c) for c in df.columns if c not in ("recommendations", "response")]
    # The outer form keeps the optimizer from computing the array a second time
    # in a filter of its own; rows without recommendations go afterwards.
    exploded = df.select(*rest, F.posexplode_outer("recommendations").alias("position", "item")).where("position IS NOT NULL")
    return exploded.select(*rest, (F.col("position") + 1).alias("position"), "item.*")


def confidence(response: Column, key: str = "confidence_score") -> Column:
    """0-100 from the response: 50 if missing, 0 if it is not a whole number in some form."""
    return field_or(as_map(response), key, clamped_int, F.lit(DEFAULT_CONFIDENCE))


def clamped_int(value: Column, low: int = 0, high: int = 100) -> Column:
    """A JSON value cut to a whole number towards zero and clamped; ``low`` if that fails."""

    def number(kind: Column) -> Column:
        digits = F.regexp_replace(strip(as_text(value)), r"(?<=\d)_(?=\d)", "")
        return (
            F.when(kind == "number", F.try_variant_get(value, "$", "double"))
            .when(kind == "boolean", F.try_variant_get(value, "$", "int").cast("double"))
            .when((kind == "string") & digits.rlike(r"^[+-]?\d+$"), digits.try_cast("double"))
        )

    def whole(found: Column) -> Column:
        # Clamped as double, so that no value is too large for the cast.
        in_range = F.when(found.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), found)))
        return F.when(in_range < 0, F.ceil(in_range)).otherwise(F.floor(in_range)).cast("int")

    return clamp(bind(bind(json_kind(value), number), whole), low, high)


def valid_questions(df: DataFrame, raw: str = "raw", n: int = 5) -> DataFrame:
    """Add ``questions`` ARRAY<STRING>: the first ``n`` truthy items; null if there is no JSON list."""
    items = as_array(F.try_parse_json(strip_fences(F.col(raw))))
    return df.withColumn("questions", F.slice(F.transform(F.filter(items, _truthy), _as_python_text), 1, n))


def _texts(value: Column) -> Column:
    return F.transform(as_array(value), as_text)


def _truthy(value: Column) -> Column:
    def by_kind(kind: Column) -> Column:
        return (
            F.when(kind == "string", as_text(value) != "")
            .when(kind == "boolean", F.try_variant_get(value, "$", "boolean"))
            .when(kind == "number", F.try_variant_get(value, "$", "double") != 0)
            .when(kind == "array", F.size(as_array(value)) > 0)
            .when(kind == "object", F.size(as_map(value)) > 0)
            .otherwise(False)
        )

    return bind(json_kind(value), by_kind)


def _as_python_text(value: Column) -> Column:
    return F.when(json_kind(value) == "boolean", F.initcap(as_text(value))).otherwise(as_text(value))
