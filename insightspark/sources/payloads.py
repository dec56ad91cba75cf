"""Final results as JSON payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields of a final result and what stands in for a missing one.
RESULT_FIELDS = {
    "run_id": "text", "data_findings": "list", "data_summary": "text", "data_health_score": "number",
    "market_findings": "list", "market_summary": "text", "recommendations": "list", "opportunities": "list",
    "executive_summary": "text", "confidence_score": "number", "report_markdown": "text", "errors": "list",
}


def result_payload(runs: DataFrame) -> DataFrame:
    """(run_id, payload): the result fields of each run as one JSON object; missing ones get defaults."""
    defaults = {"text": F.lit(""), "list": F.array(), "number": F.lit(0)}

    def field(name: str, kind: str) -> Column:
        if name in runs.columns:
            return F.coalesce(F.col(name), defaults[kind]).alias(name)
        return defaults[kind].alias(name)

    fields = [field(name, kind) for name, kind in RESULT_FIELDS.items()]
    return runs.select("run_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("payload"))


def json_rows(df: DataFrame, name: str = "row") -> DataFrame:
    """Each row as one JSON object, for use in a prompt."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(name))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines, one file per task, nulls kept."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)
