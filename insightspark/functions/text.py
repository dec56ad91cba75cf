"""String expressions with Python's idea of whitespace, all native to Spark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's whitespace, which is wider than Spark's trim() and than regex \s.
WHITESPACE = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())
WHITESPACE_RUN = r"(?U)[\s\x1c-\x1f]+"

FENCE = "```"


def strip(text: Column) -> Column:
    """``str.strip()``."""
    return F.btrim(text, F.lit(WHITESPACE))


def words(text: Column) -> Column:
    """``str.split()``, except that an empty first or last word may remain."""
    return F.split(text, WHITESPACE_RUN, -1)


def default_text(text: Column, default: str = "") -> Column:
    return F.coalesce(text, F.lit(default))


def bullet_list(items: Column, when_empty: str = "None available.") -> Column:
    """One ``- item`` line per array element."""
    lines = F.transform(items, lambda item: F.concat(F.lit("- "), default_text(item)))
    return F.when(F.size(F.coalesce(items, F.array())) > 0, F.array_join(lines, "\n")).otherwise(when_empty)


def strip_fences(response: Column) -> Column:
    """The body of a fenced response, without a leading ``json`` tag."""
    trimmed = strip(response)
    body = F.regexp_replace(F.get(F.split(trimmed, FENCE, -1), 1), "^json", "")
    return F.when(F.startswith(trimmed, F.lit(FENCE)), strip(body)).otherwise(trimmed)


def strip_report_fence(report: Column) -> Column:
    """A fenced report without its first and last line."""
    trimmed = strip(report)
    lines = F.split(trimmed, "\n", -1)
    inner = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0)))
    return F.when(F.startswith(trimmed, F.lit(FENCE)), strip(F.array_join(inner, "\n"))).otherwise(trimmed)


def fill_template(template: str, slots: dict[str, Column]) -> Column:
    """Fill ``{name}`` slots in one concatenation.

    Slot values are never scanned for slots themselves, so values holding
    braces are safe.  ``{{`` and ``}}`` stand for single braces.
    """
    from string import Formatter

    parts: list[Column] = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            parts.append(default_text(slots[name].cast("string")))
    return F.concat(*parts) if parts else F.lit("")
