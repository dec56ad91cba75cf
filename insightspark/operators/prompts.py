"""Prompt tables: one row per run, slots filled from columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from insightspark.functions.text import bullet_list, fill_template

NO_FINDINGS = "No internal findings yet."


def prompt_table(runs: DataFrame, template: str, slots: dict[str, Column | str], prompt: str = "prompt") -> DataFrame:
    """Add the filled template; a slot is a column or the name of one."""
    columns = {name: F.col(slot) if isinstance(slot, str) else slot for name, slot in slots.items()}
    return runs.withColumn(prompt, fill_template(template, columns))


def with_bullets(df: DataFrame, items: str, text: str, when_empty: str = "None available.") -> DataFrame:
    """Add an array column as one ``- item`` line each."""
    return df.withColumn(text, bullet_list(F.col(items), when_empty))
