"""Operator inputs derived from the provided tables, whole table by whole table.

The provided tables lack nulls, duplicates, padding, fences and JSON answers.
These views add them by formula, so their size follows the tables.  The SQL
checks spell the same formulas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from insightspark.plans.sales_view import table

# Whitespace that trim() alone would leave in place.
PADDING_BEFORE = "\u00a0 \t"
PADDING_AFTER = "\u2003\n"


def padded_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation texts with whitespace of several kinds around them."""
    padded = F.concat(F.lit(PADDING_BEFORE), F.col("text"), F.lit(PADDING_AFTER))
    return table(spark, folder, "conversations").select("conv_id", "turn", "role", padded.alias("text"))


def messy_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Untidy names, padded text, dates as text, every row twice."""
    rows = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias(" Order Key"),
        F.concat(F.lit(" "), F.col("o_orderstatus"), F.lit("\t")).alias("Order Status "),
        _us_date(F.col("o_orderdate").cast("string")).alias("Order Date"),
        F.col("o_totalprice").alias("TOTAL price"),
    )
    return rows.unionAll(rows)


def dated_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Text columns with "date" in their names, one of them with values that are no dates."""
    # Cut from the text form, since formatting would go through a time zone.
    when = F.col("o_orderdate").cast("string")
    day = F.substring(when, 1, 10)
    european = F.concat_ws("/", F.substring(when, 9, 2), F.substring(when, 6, 2), F.substring(when, 1, 4))
    return table(spark, folder, "orders").select(
        "o_orderkey",
        day.alias("iso_date"),
        F.concat(european, F.lit(" "), F.substring(when, 12, 5)).alias("date_and_time"),
        F.concat(day, F.lit("T"), F.substring(when, 12, 8)).alias("update_stamp"),
        F.when(F.col("o_orderstatus") != "P", _us_date(when)).alias("date_with_gaps"),
        F.when(F.col("o_orderstatus") == "P", "unknown").otherwise(day).alias("mixed_date"),
    )


def _us_date(when: Column) -> Column:
    return F.concat_ws("/", F.substring(when, 6, 2), F.substring(when, 9, 2), F.substring(when, 1, 4))


def gappy_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with nulls in two columns."""
    return table(spark, folder, "orders").select(
        "o_orderkey",
        "o_custkey",
        F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"),
        F.when(F.col("o_totalprice") >= 100000.0, F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderdate",
        "o_orderpriority",
    )


def search_results(spark: SparkSession, folder: str) -> DataFrame:
    """Each page found by two queries of its run; the second lost some URLs."""
    pages = table(spark, folder, "pages")
    run, position = F.floor(F.col("page_id") / 10).alias("run_id"), (F.col("page_id") % 10).cast("int")
    title = F.col("page_id").cast("string")
    first = pages.select(
        run, F.lit(0).alias("query_idx"), position.alias("result_idx"),
        F.concat(F.lit("Page "), title).alias("title"), F.col("html").alias("content"), "url",
    )
    second = pages.select(
        run, F.lit(1).alias("query_idx"), (9 - position).alias("result_idx"),
        F.when(F.col("page_id") % 5 != 0, F.concat(F.lit("Copy "), title)).otherwise("").alias("title"),
        F.col("html").alias("content"),
        F.when(F.col("page_id") % 3 == 0, "").otherwise(F.col("url")).alias("url"),
    )
    return first.unionAll(second)


def search_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs with and without results."""
    with_results = table(spark, folder, "pages").select(F.floor(F.col("page_id") / 10).alias("run_id"))
    return with_results.unionAll(table(spark, folder, "benchmark").select(F.col("item_id").alias("run_id"))).distinct()


def raw_results(spark: SparkSession, folder: str) -> DataFrame:
    """Provider answers in every shape: lists of objects and strings, a JSON string, plain text, an object."""
    html, url = quoted(F.col("html")), quoted(F.col("url"))
    full = F.concat(F.lit('{"title": "T", "content": '), html, F.lit(', "url": '), url, F.lit("}"))
    other_names = F.concat(F.lit('{"snippet": '), html, F.lit(', "link": '), url, F.lit("}"))
    nulls = F.concat(F.lit('{"title": null, "content": null, "snippet": '), html, F.lit(', "url": null, "link": '), url, F.lit("}"))
    several = F.concat(F.lit("["), full, F.lit(", 7, "), html, F.lit(", null, "), other_names, F.lit("]"))
    raw = (
        F.when(shape("page_id", 6) == 0, several)
        .when(shape("page_id", 6) == 1, F.concat(F.lit("["), nulls, F.lit("]")))
        .when(shape("page_id", 6) == 2, html)
        .when(shape("page_id", 6) == 3, F.col("html"))
        .when(shape("page_id", 6) == 4, "[]")
        .otherwise(full)
    )
    return table(spark, folder, "pages").select("page_id", raw.alias("raw"))


def provider_calls(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(primary results, fallback results, call log): each page is one query of its run."""
    pages = table(spark, folder, "pages")
    run, query = F.floor(F.col("page_id") / 10).alias("run_id"), (F.col("page_id") % 10).cast("int").alias("query_idx")

    def results(title: str) -> DataFrame:
        return pages.select(run, query, F.lit(0).alias("result_idx"), F.lit(title).alias("title"), F.col("html").alias("content"), "url")

    def calls(provider: str, ok: Column, own_error: Column) -> DataFrame:
        return pages.select(run, query, F.lit(provider).alias("provider"), ok.alias("ok"), own_error.alias("own_error"))

    number = F.col("page_id")
    log = calls("primary", number % 4 != 0, number % 40 == 0).unionAll(calls("fallback", number % 24 != 0, F.lit(False)))
    return results("primary"), results("fallback"), log


def vector_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Every tenth vector asks for its neighbours."""
    vectors = table(spark, folder, "embeddings")
    return vectors.where(F.col("vec_id") % 10 == 0).select(F.col("vec_id").alias("query_id"), "embedding")


def vector_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors with the document of the same number as text; some sources are unknown."""
    documents = table(spark, folder, "documents").select(
        F.col("doc_id").alias("vec_id"), "text", F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("source")
    )
    return table(spark, folder, "embeddings").join(documents, "vec_id", "left")


def fenced_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as answers with and without fences."""
    text = F.col("text")
    raw = (
        F.when(shape("doc_id", 5) == 0, F.concat(F.lit(" ```json\n"), text, F.lit("\n```\n")))
        .when(shape("doc_id", 5) == 1, F.concat(F.lit("```"), text, F.lit("```")))
        .when(shape("doc_id", 5) == 2, F.concat(F.lit("```markdown\n"), text, F.lit("\n \n```")))
        .when(shape("doc_id", 5) == 3, F.concat(F.lit(" \n"), text, F.lit(" \n")))
        .otherwise(text)
    )
    return table(spark, folder, "documents").select("doc_id", raw.alias("raw"))


# Confidence values in the forms models send them; the last one leaves the key out.
CONFIDENCES = ["82", "150", "-10", '"85"', '"85.5"', "85.9", "true", "null", "[1]", '"bad"', "-0.5", None]


def model_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Model answers: valid, fenced, incomplete, with nulls, a list, and no JSON at all."""
    text, lang = quoted(F.col("text")), quoted(F.col("lang"))
    number = F.col("doc_id").cast("string")
    score = F.lit("")
    for i, value in enumerate(CONFIDENCES):
        if value is not None:
            score = F.when(shape("doc_id", len(CONFIDENCES)) == i, f'"confidence_score": {value}, ').otherwise(score)
    summary = F.when(shape("doc_id", 7) == 0, "").when(shape("doc_id", 7) == 1, '"executive_summary": null, ').otherwise(
        F.concat(F.lit('"executive_summary": '), text, F.lit(", "))
    )
    chances = F.when(shape("doc_id", 3) == 0, "").otherwise(F.concat(F.lit('"opportunities": ['), lang, F.lit(", "), text, F.lit("], ")))
    full = F.concat(
        F.lit('{"rank": '), number, F.lit(', "action": '), lang, F.lit(', "rationale": '), text,
        F.lit(', "priority": "high", "timeframe": "long_term"}'),
    )
    partial = F.concat(F.lit('{"action": '), lang, F.lit(', "rationale": null}'))
    numbered = F.lit('{"rank": "3", "priority": "low"}')
    body = F.concat(
        F.lit("{"), summary, score, chances, F.lit('"recommendations": ['), full, F.lit(", "), partial, F.lit(", "), numbered, F.lit("]}")
    )
    raw = (
        F.when(shape("doc_id", 10) == 7, F.concat(F.lit("no json: "), F.col("text")))
        .when(shape("doc_id", 10) == 8, F.concat(F.lit("["), text, F.lit("]")))
        .when(shape("doc_id", 2) == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .otherwise(body)
    )
    return table(spark, folder, "documents").select("doc_id", raw.alias("raw"))


def role_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Answers of several roles in one object, with some fields left out, null or empty."""
    text = quoted(F.col("text"))

    def part(name: str, value: Column, there: Column = F.lit(True)) -> Column:
        return F.when(there, F.concat(F.lit(f'"{name}": '), value, F.lit(", "))).otherwise("")

    def listed(*items: Column) -> Column:
        return F.concat(F.lit("["), F.concat_ws(", ", *items), F.lit("]"))

    raw = F.concat(
        F.lit("{"),
        part("summary", text, shape("turn", 3) != 0),
        part("findings", listed(F.lit('"first"'), text), shape("turn", 2) == 0),
        part("anomalies", listed(text)),
        part("data_quality_notes", F.lit("[]")),
        part("market_summary", F.lit("null"), shape("turn", 4) == 1),
        part("market_findings", listed(text, text)),
        part("supporting_data_alignment", text),
        part("search_queries_used", listed(F.lit('"q"')), shape("turn", 5) == 1),
        part("risks", listed(text, F.lit('"late"')), shape("turn", 2) == 1),
        F.lit('"end": 1}'),
    )
    return table(spark, folder, "conversations").select("conv_id", "turn", raw.alias("raw"))


def question_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Question lists of conversations: too long, with empty items, no list, no JSON."""
    text = quoted(F.col("text"))
    long_list = F.concat(F.lit("["), text, F.lit(', "", null, 0, false, [], {}, 7, "b", true, 2.5, '), text, F.lit(', "late"]'))
    raw = (
        F.when(shape("turn", 4) == 0, long_list)
        .when(shape("turn", 4) == 1, F.concat(F.lit("```json\n["), text, F.lit("]\n```")))
        .when(shape("turn", 4) == 2, F.concat(F.lit('{"questions": '), text, F.lit("}")))
        .otherwise(F.col("text"))
    )
    return table(spark, folder, "conversations").select("conv_id", "turn", raw.alias("raw"))


def column_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """(table_name, column_name): the events of a user's day stand for the columns of a table."""
    kind = F.col("event_type")
    name = (
        F.when(kind == "click", "total_revenue")
        .when(kind == "view", "year")
        .when(kind == "purchase", "region")
        .when(kind == "error", "vehicle_platform")
        .otherwise("event_influence")
    )
    day = F.col("ts").cast("date").cast("string")
    return table(spark, folder, "events").select(
        F.concat_ws("/", F.col("user_id").cast("string"), day).alias("table_name"), name.alias("column_name")
    )


def markdown_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as Markdown: their lines become items, steps, headings or paragraphs."""
    breaks = ["\n- ", "\n12. ", "\n\n", "\n### ", "\n* ", "\n"]
    body = F.col("text")
    for i, new in enumerate(breaks):
        body = F.when(shape("doc_id", len(breaks)) == i, F.replace(F.col("text"), F.lit("\n"), F.lit(new))).otherwise(body)
    head = F.concat(
        F.lit("# "), F.col("source"), F.lit("\n\n## Notes\n- **"), F.col("lang"), F.lit("** *is* `code`\n* **a** and **b**\n  1. step\n---\n- last\n")
    )
    return table(spark, folder, "documents").select("doc_id", F.concat(head, body).alias("markdown"))


def step_events(events: DataFrame) -> DataFrame:
    """Events as the step log of runs: a user is a run, an event type a step."""
    return events.select(
        F.col("user_id").alias("run_id"),
        F.col("event_type").alias("node"),
        F.when(F.col("event_id") % 2 == 0, "node_start").otherwise("node_complete").alias("type"),
        F.col("props").alias("status"),
        "ts",
        F.col("event_id").alias("seq"),
    )


def state_updates(spark: SparkSession, folder: str) -> DataFrame:
    """Events as state updates of runs; error events append to the errors."""
    field = F.when(F.col("event_type") == "error", "errors").otherwise(F.col("event_type"))
    return table(spark, folder, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), field.alias("field"), F.col("props").alias("value")
    )


def quoted(text: Column) -> Column:
    """A text as JSON string."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def shape(key: str, shapes: int) -> Column:
    """Which of several shapes a row takes; no row is left out."""
    return F.col(key) % shapes
