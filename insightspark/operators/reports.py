"""Report texts: recommendation blocks, gauges, and Markdown to HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from insightspark.functions.text import default_text, strip


def recommendation_block(recommendations: Column) -> Column:
    """One entry per recommendation, in input order."""

    def entry(item: Column) -> Column:
        urgency = F.concat(F.upper(default_text(item["priority"])), F.lit(" / "), F.replace(default_text(item["timeframe"]), F.lit("_"), F.lit(" ")))
        return F.concat(
            default_text(item["rank"].cast("string"), "?"),
            F.lit(". **"), default_text(item["action"]), F.lit("** ["), urgency, F.lit("]\n   "), default_text(item["rationale"]),
        )

    some = F.size(F.coalesce(recommendations, F.array())) > 0
    return F.when(some, F.array_join(F.transform(recommendations, entry), "\n")).otherwise("None available.")


def market_signal(findings: Column) -> Column:
    """15 points per finding, at most 100; 0 for a missing list."""
    return F.least(F.lit(100), F.size(F.coalesce(findings, F.array())) * 15)


def gauge_band(value: Column) -> Column:
    return F.when(value >= 75, "green").when(value >= 40, "brass").when(value > 0, "alert").otherwise("dim")


def terminal_gauge_band(value: Column) -> Column:
    """The three bands of the terminal report."""
    return F.when(value >= 75, "green").when(value >= 40, "yellow").otherwise("red")


def markdown_to_html(df: DataFrame, markdown: str = "markdown", html: str = "html") -> DataFrame:
    """Add the HTML blocks of a report; its text is not escaped.

    A report is one row, so its lines stay an array.  Whether a list opens or
    closes at a line follows from the line before, looked up by position.
    """
    lines = F.transform(F.split(default_text(F.col(markdown)), "\n", -1), strip)
    is_item = F.transform("_lines", lambda line: F.startswith(line, F.lit("- ")) | F.startswith(line, F.lit("* ")))
    marked = df.withColumn("_lines", lines).withColumn("_items", is_item)

    def block(line: Column, position: Column) -> Column:
        here = F.get(F.col("_items"), position)
        before = (position > 0) & F.coalesce(F.get(F.col("_items"), position - 1), F.lit(False))
        edge = F.when(here & ~before, "<ul>\n").when(~here & before, "</ul>\n").otherwise("")
        return F.concat(edge, _html_line(line))

    closing = F.when(F.element_at("_items", -1), "\n</ul>").otherwise("")
    body = F.array_join(F.transform("_lines", block), "\n")
    return marked.withColumn(html, F.concat(body, closing)).drop("_lines", "_items")


def inline_marks(text: Column) -> Column:
    """Bold, then italic, then code, each as short as possible."""
    bold = F.regexp_replace(text, r"(?d)\*\*(.+?)\*\*", "<strong>$1</strong>")
    italic = F.regexp_replace(bold, r"(?d)\*(.+?)\*", "<em>$1</em>")
    return F.regexp_replace(italic, r"(?d)`(.+?)`", "<code>$1</code>")


# A number, a dot and whitespace, with any script's digits and spaces.
_NUMBERED = r"(?U)^\d+\.[\s\x1c-\x1f]+"


def _html_line(line: Column) -> Column:
    def wrapped(opening: str, text: Column, closing: str) -> Column:
        return F.concat(F.lit(opening), inline_marks(text), F.lit(closing))

    def after(length: int) -> Column:
        return F.substring(line, length + 1, 2147483647)

    def starts(prefix: str) -> Column:
        return F.startswith(line, F.lit(prefix))

    return (
        F.when(starts("### "), wrapped("<h3>", after(4), "</h3>"))
        .when(starts("## "), wrapped("<h2>", after(3), "</h2>"))
        .when(starts("# "), wrapped("<h1>", after(2), "</h1>"))
        .when(starts("- ") | starts("* "), wrapped("<li>", after(2), "</li>"))
        .when(line.rlike(_NUMBERED), wrapped("<p class='numbered'>", F.regexp_replace(line, _NUMBERED, ""), "</p>"))
        .when(line == "---", "<hr>")
        .when(line == "", "")
        .otherwise(wrapped("<p>", line, "</p>"))
    )
