"""Reading JSON values where a missing key, a null and a wrong type all differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from insightspark.functions.numbers import bind


def json_kind(value: Column) -> Column:
    """'object', 'array', 'string', 'boolean', 'null' or 'number'; null for no value at all."""

    def named(kind: Column) -> Column:
        return (
            F.when(F.startswith(kind, F.lit("OBJECT")), "object")
            .when(F.startswith(kind, F.lit("ARRAY")), "array")
            .when(kind == "STRING", "string")
            .when(kind == "BOOLEAN", "boolean")
            .when(kind == "VOID", "null")
            .when(kind.isNotNull(), "number")
        )

    return bind(F.schema_of_variant(value), named)


def as_array(value: Column) -> Column:
    """A JSON list as an array of variants, otherwise null."""
    return F.try_variant_get(value, "$", "array<variant>")


def as_map(value: Column) -> Column:
    """A JSON object as a map of variants, otherwise null."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def as_text(value: Column) -> Column:
    """A JSON string without quotes; any other value as its JSON text; null stays null."""
    return F.try_variant_get(value, "$", "string")


def has_key(fields: Column, key: str) -> Column:
    return F.coalesce(F.map_contains_key(fields, F.lit(key)), F.lit(False))


def field_or(fields: Column, key: str, read, default: Column) -> Column:
    """``read(value)`` if the key is present, even if null; else ``default``."""
    return F.when(has_key(fields, key), read(F.element_at(fields, F.lit(key)))).otherwise(default)
