"""Suggested questions from column names, for a catalogue of many tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The columns a rule needs, how many of them, and its question.
RULES = [
    (["total_revenue", "year"], "all", "Which year showed the strongest revenue growth and what drove it?"),
    (["region"], "all", "Which regions are underperforming relative to their market potential?"),
    (["build_category", "vehicle_platform"], "any", "Which product categories have the highest revenue per transaction?"),
    (["customer_age_bracket"], "all", "How does purchasing behavior differ across customer age groups?"),
    (["event_influence"], "all", "What impact do industry events have on sales volume and category mix?"),
]
# Questions that fit any table, in the order they fill up.
GENERIC = [
    "What are the top revenue drivers and how have they trended over time?",
    "Where are the biggest gaps between current performance and market opportunity?",
    "Which customer segments show the highest growth potential?",
    "What seasonal patterns exist and how should inventory strategy reflect them?",
    "Which product lines warrant dedicated investment based on growth trajectory?",
]


def suggested_questions(catalogue: DataFrame, n: int = 5, table: str = "table_name", name: str = "column_name") -> DataFrame:
    """(table, questions ARRAY<STRING>) from a catalogue of (table, column) rows.

    Each rule column becomes one boolean per table, so the aggregation buffer
    has a fixed size however many columns a table has.
    """
    needed = sorted({column for columns, _, _ in RULES for column in columns})
    present = catalogue.groupBy(table).agg(*[F.bool_or(F.col(name) == c).alias(f"has_{c}") for c in needed])
    return present.select(table, _questions({c: F.coalesce(f"has_{c}", F.lit(False)) for c in needed}, n).alias("questions"))


def suggested_for(df: DataFrame, n: int = 5) -> list[str]:
    """The same for one table, from its schema alone."""
    columns = set(df.columns)
    checks = {"all": all, "any": any}
    chosen = [question for needed, how, question in RULES if checks[how](c in columns for c in needed)]
    return [*chosen, *GENERIC][:n]


def question_rows(df: DataFrame) -> DataFrame:
    """One row per question: the other columns, ``question_idx``, ``question``."""
    rest = [F.col(c) for c in df.columns if c != "questions"]
    # The outer form keeps the optimizer from computing the array twice.
    exploded = df.select(*rest, F.posexplode_outer("questions").alias("question_idx", "question"))
    return exploded.where("question_idx IS NOT NULL")


def questions_or_fallback(answered: DataFrame, suggested: DataFrame, table: str = "table_name") -> DataFrame:
    """Fill the null ``questions`` of ``answered`` with those suggested for its table."""
    fallback = suggested.select(table, F.col("questions").alias("_suggested"))
    joined = answered.join(fallback, table, "left")
    generic = F.array(*[F.lit(q) for q in GENERIC])
    return joined.withColumn("questions", F.coalesce("questions", "_suggested", generic)).drop("_suggested")


def _questions(has: dict[str, Column], n: int) -> Column:
    chosen = []
    for columns, how, question in RULES:
        condition = has[columns[0]]
        for column in columns[1:]:
            condition = condition & has[column] if how == "all" else condition | has[column]
        chosen.append(F.when(condition, question))
    matched = F.array_compact(F.array(*chosen))
    return F.slice(F.concat(matched, F.array(*[F.lit(q) for q in GENERIC])), 1, n)
