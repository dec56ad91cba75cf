"""Search queries from questions and findings, and tables of search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from insightspark.functions.numbers import bind
from insightspark.functions.text import default_text, strip, words
from insightspark.functions.variants import as_array, as_map, as_text, field_or, json_kind

# Words that carry no search signal.
STOP_WORDS = [
    "is", "the", "a", "an", "and", "or", "but", "in", "on", "at",
    "to", "for", "of", "with", "by", "from", "as", "are", "was",
    "be", "been", "being", "have", "has", "had", "do", "does", "did",
    "will", "would", "could", "should", "may", "might", "shall",
    "which", "that", "this", "these", "those", "it", "its",
    "enough", "still", "just", "our", "we", "us", "they", "their",
]
# Findings that mention one of these give a query of their own.
ANCHORS = ["baja", "pre-runner", "region", "growth"]

NO_RESULTS = "No search results available."
# Fixed value: the characters of a result that its block shows.
_SHOWN = 600


def keywords(text: Column, limit: int = 8) -> Column:
    """The first words that are longer than two letters and not stop words, lower-cased."""
    plain = F.translate(F.lower(text), "?,", "")
    kept = F.filter(words(plain), lambda word: (F.length(word) > 2) & ~word.isin(STOP_WORDS))
    return F.array_join(F.slice(kept, 1, limit), " ")


def search_queries(
    runs: DataFrame, question: str = "question", findings: str = "findings", anchors: list[str] = ANCHORS
) -> DataFrame:
    """One row per query: the columns of ``runs`` without the two inputs, ``query_idx``, ``query``.

    First the question, cut to 120 characters; then its keywords; then the
    keywords of the first finding, among three, that names an anchor and adds a
    new query.  Row by row, without a shuffle.
    """
    asked = default_text(F.col(question))
    primary = F.substring(strip(asked), 1, 120)
    by_keyword = keywords(asked)
    keyed = runs.withColumn("_primary", primary).withColumn("_keywords", by_keyword)
    secondary = F.when((F.col("_keywords") != "") & (F.col("_keywords") != F.col("_primary")), F.col("_keywords"))

    def names_anchor(finding: Column) -> Column:
        lowered = F.lower(finding)
        hits = [F.contains(lowered, F.lit(anchor)) for anchor in anchors]
        found = hits[0]
        for hit in hits[1:]:
            found = found | hit
        return found

    anchored = F.filter(F.slice(F.coalesce(F.col(findings), F.array()), 1, 3), names_anchor)
    # The keywords are either the second query or equal to the first one or
    # empty, so a new query is one that differs from both.
    fresh = F.filter(
        F.transform(anchored, lambda finding: keywords(finding)),
        lambda query: (query != "") & (query != F.col("_primary")) & (query != F.col("_keywords")),
    )
    queries = F.array_compact(F.array(F.col("_primary"), secondary, F.get(fresh, F.lit(0))))
    rest = [F.col(c) for c in runs.columns if c not in (question, findings)]
    return keyed.select(*rest, F.posexplode(queries).alias("query_idx", "query"))


def normalise_results(responses: DataFrame, raw: str = "raw") -> DataFrame:
    """Rows (…, result_idx, title, content, url) from raw provider answers.

    A JSON list gives one row per object or string in it.  ``snippet`` and
    ``link`` stand in for missing ``content`` and ``url``; a key that is present
    but null stays null.  Any other answer is one row with that text as content.
    """
    rest = [F.col(c) for c in responses.columns if c != raw]
    parsed = responses.withColumn("_value", F.try_parse_json(F.col(raw)))
    items = as_array(F.col("_value"))
    whole = F.coalesce(F.when(json_kind(F.col("_value")) == "string", as_text(F.col("_value"))), F.col(raw))

    def from_object(fields: Column) -> Column:
        content = field_or(fields, "content", as_text, field_or(fields, "snippet", as_text, F.lit("")))
        url = field_or(fields, "url", as_text, field_or(fields, "link", as_text, F.lit("")))
        return F.when(fields.isNotNull(), _result(field_or(fields, "title", as_text, F.lit("")), content, url))

    def from_item(item: Column) -> Column:
        from_string = F.when(json_kind(item) == "string", _result(F.lit(""), as_text(item), F.lit("")))
        return F.coalesce(bind(as_map(item), from_object), from_string)

    listed = F.array_compact(F.transform(items, from_item))
    single = F.when(F.col(raw).isNotNull(), F.array(_result(F.lit(""), whole, F.lit(""))))
    results = F.when(items.isNotNull(), listed).otherwise(single)
    return parsed.select(*rest, F.posexplode(results).alias("result_idx", "_result")).select(
        *rest, "result_idx", "_result.title", "_result.content", "_result.url"
    )


def merge_results(results: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run, the first result of each URL in (query_idx, result_idx) order.

    Results without a URL are all kept; each is its own group, so they never
    meet in one task.  The rank filter drops repeats before the shuffle, so a
    URL that fills a third of the table sends one row per task.
    """
    blank = default_text(F.col("url")) == ""
    apart = F.when(blank, F.struct("query_idx", "result_idx"))
    first = Window.partitionBy(run, "url", apart).orderBy("query_idx", "result_idx")
    return results.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") == 1).drop("_rank")


def previews(results: DataFrame) -> DataFrame:
    """Results with the part of their content that a block shows, so no more is shuffled."""
    return results.withColumn("content", F.substring(F.col("content"), 1, _SHOWN))


def result_blocks(results: DataFrame, runs: DataFrame | None = None, run: str = "run_id", limit: int = 8) -> DataFrame:
    """(run, block): the first results of each run as one text.

    Runs of ``runs`` without results get a fixed sentence.
    """
    order = Window.partitionBy(run).orderBy("query_idx", "result_idx")
    best = previews(results).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= limit)
    title = default_text(F.col("title"))
    heading = F.concat(F.lit("[Result "), F.col("_rank").cast("string"), F.lit("]"), F.when(title != "", F.concat(F.lit(" — "), title)).otherwise(""))
    text = F.concat(heading, F.lit("\n"), default_text(F.col("content")), F.lit("\n"), default_text(F.col("url")))
    blocks = best.groupBy(run).agg(joined_in_order("_rank", text, "\n\n").alias("block"))
    if runs is None:
        return blocks
    every_run = runs.select(run).distinct().join(blocks, run, "left")
    return every_run.select(run, default_text(F.col("block"), NO_RESULTS).alias("block"))


def joined_in_order(rank: str, text: Column, separator: str) -> Column:
    """Aggregate: the texts of a group joined by rank.  Only after a rank cut-off."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("rank"), text.alias("text"))))
    return F.array_join(F.transform(ordered, lambda item: item["text"]), separator)


def fallback_merge(primary: DataFrame, fallback: DataFrame, calls: DataFrame, run: str = "run_id") -> DataFrame:
    """Results of each query from its primary provider, or from the fallback where that failed.

    ``calls`` has (run, query_idx, provider, ok, own_error), provider being
    'primary' or 'fallback'.  A primary that failed with its own error type is
    not retried.  A run with a query that no provider answered has no results.
    """
    outcome = _outcomes(calls, run)
    lost = outcome.groupBy(run).agg(F.bool_and(F.col("provider").isNotNull()).alias("complete"))
    usable = outcome.join(lost.where("complete").select(run), run, "left_semi")
    offered = primary.withColumn("provider", F.lit("primary")).unionByName(fallback.withColumn("provider", F.lit("fallback")))
    return offered.join(usable, [run, "query_idx", "provider"], "left_semi")


def failed_runs(calls: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, failed_queries): runs that lost their results, for the error log."""
    failed = _outcomes(calls, run).where(F.col("provider").isNull())
    return failed.groupBy(run).agg(F.count(F.lit(1)).alias("failed_queries"))


def _outcomes(calls: DataFrame, run: str) -> DataFrame:
    """(run, query_idx, provider): who answered each query; null for nobody."""

    def any_call(condition: Column) -> Column:
        return F.coalesce(F.bool_or(condition), F.lit(False))

    per_query = calls.groupBy(run, "query_idx").agg(
        any_call((F.col("provider") == "primary") & F.col("ok")).alias("primary_ok"),
        any_call((F.col("provider") == "primary") & ~F.col("ok") & F.coalesce("own_error", F.lit(False))).alias("own_error"),
        any_call((F.col("provider") == "fallback") & F.col("ok")).alias("fallback_ok"),
    )
    answered = F.when(F.col("primary_ok"), "primary").when(~F.col("own_error") & F.col("fallback_ok"), "fallback")
    return per_query.select(run, "query_idx", answered.alias("provider"))


def _result(title: Column, content: Column, url: Column) -> Column:
    return F.struct(title.alias("title"), content.alias("content"), url.alias("url"))
