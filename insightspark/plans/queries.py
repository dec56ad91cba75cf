"""The registered queries: every operator over the whole of the provided tables.

Each takes (spark, folder) and returns a DataFrame whose columns have the names
and types of its check in ``sql_checks``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from insightspark.functions import kinds
from insightspark.functions import text as texts
from insightspark.functions.kinds import timestamp_text
from insightspark.operators import (
    chart_data, chunking, clean, profile, profile_states, questions, reports, responses, revenue, run_log, search, vectors,
)
from insightspark.operators.prompts import prompt_table, with_bullets
from insightspark.operators.vector_store import embed_new
from insightspark.plans import analysis, inputs
from insightspark.plans.sales_view import sales_rows, sales_view, table
from insightspark.session import shared_folder, write_once
from insightspark.sources.csv_files import load_table
from insightspark.sources.payloads import result_payload
from insightspark.sources.text_documents import read_text_documents, read_text_parts
from insightspark.streaming import arrivals, run_ends, step_status
from insightspark.streaming.changes import write_changes

Query = Callable[[SparkSession, str], DataFrame]

SEGMENT = "PROMO"
HIGHLIGHT = "promo"
# Words of the generated texts, in place of the business terms.
ANCHORS = ["heron", "tion", "sch"]
PROMPT = "Question: {question}\nRole: {role}\nLiteral {{braces}}\n{notes}"
VOWELS = "aeiouyhn"


# --- sources and sinks -----------------------------------------------------


def csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    path = shared_folder(spark, "orders-csv")
    orders.select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 7 == 0, "NA").otherwise(F.col("o_custkey").cast("string")).alias("o_custkey"),
        F.when(F.col("o_orderkey") % 11 == 0, "None").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        "o_totalprice",
        F.when(F.col("o_orderstatus") == "F", "True").otherwise("False").alias("is_done"),
        F.col("o_orderdate").cast("date").cast("string").alias("o_orderdate"),
        F.concat(F.lit('say "'), F.col("o_orderpriority"), F.lit('",\ntwice')).alias("remark"),
    ).write.option("header", True).option("escape", '"').csv(path)
    return load_table(spark, path)


def csv_with_schema(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_folder(spark, "declared-csv")
    orders = table(spark, folder, "orders")
    missing = F.when(F.col("o_orderkey") % 5 == 0, "NA").otherwise(F.col("o_totalprice").cast("string"))
    orders.select("o_orderkey", missing.alias("o_totalprice"), "o_orderstatus").write.option("header", True).csv(path)
    return load_table(spark, path, "o_orderstatus string, o_orderkey bigint, o_totalprice double")


def csv_mixed_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Files of one folder whose columns stand in different orders."""
    path = shared_folder(spark, "mixed-csv")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    even = F.col("o_orderkey") % 2 == 0
    orders.where(even).write.option("header", True).csv(path)
    orders.where(~even).select("o_totalprice", "o_orderkey", "o_orderstatus").write.mode("append").option("header", True).csv(path)
    return load_table(spark, path)


def csv_split_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """Whole documents, line breaks and quotes included, as cells of CSV files that are split over tasks."""
    path = shared_folder(spark, "quoted-csv")
    bare = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    table(spark, folder, "documents").select(
        "doc_id", "text", F.concat(F.lit('5" '), "lang", F.lit(',"\n"')).alias("size"), "source"
    ).write.options(header=True, **bare).csv(path)
    return load_table(spark, path, "doc_id bigint, text string, size string, source string")


def text_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Files in a folder per language; the language comes back from the name of the file."""
    path = shared_folder(spark, "text-docs")
    documents = table(spark, folder, "documents").select("text", "lang")
    documents.write.option("maxRecordsPerFile", 200).partitionBy("lang").text(path)
    loaded = read_text_documents(spark, path)
    # The writer ends every file with a line break; what follows it is no line.
    lines = F.explode(F.split(F.regexp_replace("text", r"\n\z", ""), "\n", -1)).alias("line")
    found = loaded.select(F.regexp_extract("source_file", "/lang=([^/]*)/", 1).alias("lang"), lines)
    return found.groupBy("lang", "line").agg(F.count(F.lit(1)).alias("n"))


def text_parts(spark: SparkSession, folder: str) -> DataFrame:
    """The same files in parts: per language the characters and line breaks that all parts hold."""
    path = shared_folder(spark, "text-parts")
    table(spark, folder, "documents").select("text", "lang").write.partitionBy("lang").text(path)
    parts = read_text_parts(spark, path)
    lang = F.regexp_extract("source_file", "/lang=([^/]*)/", 1).alias("lang")
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return parts.groupBy(lang).agg(
        F.sum(F.length("text").cast("long")).alias("n_chars"), F.sum(breaks.cast("long")).alias("n_breaks")
    )


def result_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Payloads of all fields, written as files and read back."""
    lines, user = F.split("text", "\n", -1), F.col("role") == "user"
    runs = table(spark, folder, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("run_id"),
        lines.alias("data_findings"),
        F.when(user, F.col("text")).alias("data_summary"),
        (F.col("turn") * 7 % 101).cast("int").alias("data_health_score"),
        F.when(~user, lines).alias("market_findings"),
        F.when(~user, F.col("text")).alias("market_summary"),
        F.slice(lines, 1, 2).alias("recommendations"),
        F.when(user, F.slice(lines, 1, 1)).alias("opportunities"),
        F.col("role").alias("executive_summary"),
        F.col("turn").cast("int").alias("confidence_score"),
        F.concat(F.lit("# "), F.col("text")).alias("report_markdown"),
    )
    path = shared_folder(spark, "payloads")
    result_payload(runs).select("payload").write.text(path)
    payload = F.col("value")

    def text(name: str) -> Column:
        return F.get_json_object(payload, f"$.{name}").alias(name)

    def items(name: str) -> Column:
        return F.array_join(F.from_json(F.get_json_object(payload, f"$.{name}"), "array<string>"), "|").alias(name)

    return spark.read.text(path).select(
        text("run_id"), items("data_findings"), text("data_summary"), text("data_health_score"), items("market_findings"),
        text("market_summary"), items("recommendations"), items("opportunities"), text("executive_summary"),
        text("confidence_score"), text("report_markdown"), text("errors"),
    )


def _as_pattern(folder: str, name: str) -> str:
    """A path pattern, since a stream takes a single file only as a match of one."""
    return f"{folder}/{{{name}}}.parquet"


def stream_revenue_by_dim(spark: SparkSession, folder: str) -> DataFrame:
    schema = table(spark, folder, "lineitem").schema
    lines = arrivals.arriving_files(spark, _as_pattern(folder, "lineitem"), schema, kind="parquet")
    rows = sales_rows(lines, spark, folder, ("region", "total_revenue"))
    out = shared_folder(spark, "revenue-stream")
    changes = arrivals.revenue_changes(rows, "region")
    write_changes(changes, f"{out}/revenue", f"{out}/checkpoint", keys=["key"]).awaitTermination()
    return arrivals.revenue_so_far(spark, f"{out}/revenue")


def stream_csv_clean(spark: SparkSession, folder: str) -> DataFrame:
    """CSV files with padded names and texts, and prices that are no numbers, as a stream."""
    out = shared_folder(spark, "csv-stream")
    table(spark, folder, "orders").select(
        F.col("o_orderkey").alias(" Order Key "),
        F.concat(F.lit("  "), F.col("o_orderstatus"), F.lit("\t")).alias("Order STATUS"),
        F.when(F.col("o_orderkey") % 9 == 0, "cheap").otherwise(F.col("o_totalprice").cast("string")).alias("Total Price"),
        F.concat(F.lit('say "'), F.col("o_orderpriority"), F.lit('",\ntwice')).alias("Remark"),
    ).write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{out}/inbox")
    schema = "` Order Key ` bigint, `Order STATUS` string, `Total Price` double, Remark string"
    cleaned = arrivals.clean_stream(arrivals.arriving_files(spark, f"{out}/inbox", schema))
    writer = cleaned.writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint")
    writer.trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    return rows.select("order_key", "order_status", "total_price", "remark", F.array_join("_rejects", ",").alias("rejects"))


def stream_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Order states that repeat within and across arriving files, one row each."""
    out = shared_folder(spark, "dedup-stream")
    orders = table(spark, folder, "orders").select("o_orderstatus", "o_orderpriority", F.to_date("o_orderdate").alias("o_orderdate"))
    inbox = f"{out}/inbox"
    orders.write.option("maxRecordsPerFile", -(-orders.count() // 4)).parquet(inbox)
    rows = arrivals.arriving_files(spark, inbox, orders.schema, kind="parquet", files_per_trigger=2, arrived="_arrived")
    fresh = arrivals.first_arrivals(rows, "30 days").drop("_arrived")
    writer = fresh.writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint")
    writer.trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def stream_run_end(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of a step log that end: their last status and number of steps; runs are a user's events of a day."""
    events = table(spark, folder, "events").select(
        F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("run_id"),
        F.col("event_type").alias("node"),
        "ts",
        F.col("event_id").alias("seq"),
        F.col("props").alias("status"),
    )
    last = F.row_number().over(Window.partitionBy("run_id").orderBy(F.col("seq").desc())) == 1
    out = shared_folder(spark, "run-end-stream")
    logged = events.withColumn("type", F.when(last, "result").otherwise("node_complete")).withColumn("ts", F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min("seq"), F.max("seq")).first()
    # Two drops in the log's order, each followed to its end; the checkpoint remembers what was read.
    for first in (True, False):
        half = F.col("seq") <= ((low or 0) + (high or 0)) // 2
        logged.where(half if first else ~half).write.mode("append").parquet(f"{out}/inbox")
        stream = arrivals.arriving_files(spark, f"{out}/inbox", logged.schema, kind="parquet")
        run_ends.start(run_ends.run_ends(stream, stalled_after="3650 days"), f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("run_id", "outcome", "status", "events")


# --- cleaning --------------------------------------------------------------


def clean_names(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    return clean.normalise_names(
        orders.select(
            F.col("o_orderkey").alias("  Order Key "), F.col("o_custkey").alias("CUSTOMER"), F.col("o_orderstatus").alias("Order STATUS"),
            F.col("o_totalprice").alias("Total Price\t"), timestamp_text(F.col("o_orderdate")).alias("Placed ON"), "o_orderpriority",
        )
    )


def _flags(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", "l_discount", "l_tax")


def dedup_rows(spark: SparkSession, folder: str) -> DataFrame:
    return clean.drop_duplicate_rows(_flags(spark, folder))


def trim_strings(spark: SparkSession, folder: str) -> DataFrame:
    return clean.trim_strings(inputs.padded_turns(spark, folder))


def parse_dates(spark: SparkSession, folder: str) -> DataFrame:
    parsed = clean.parse_dates(inputs.dated_orders(spark, folder))
    stamps = {"iso_date", "date_and_time", "update_stamp", "date_with_gaps"}
    # Reading a column that had stayed text would fail here.
    return parsed.select(
        *[timestamp_text(F.col(c)).alias(c) if c in stamps else F.col(c) for c in parsed.columns]
    )


def dupes_dropped(spark: SparkSession, folder: str) -> DataFrame:
    return clean.duplicate_counts(_flags(spark, folder))


def clean_orders(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = clean.clean_table(inputs.messy_orders(spark, folder))
    return cleaned.withColumn("order_date", timestamp_text(F.col("order_date")))


# --- profiling -------------------------------------------------------------


def profile_shape(spark: SparkSession, folder: str) -> DataFrame:
    return profile.shape(table(spark, folder, "lineitem")).select("rows", F.col("columns").cast("bigint").alias("columns"))


def profile_columns(spark: SparkSession, folder: str) -> DataFrame:
    return profile.column_profile(inputs.gappy_orders(spark, folder))


def profile_numeric(spark: SparkSession, folder: str) -> DataFrame:
    return profile.numeric_summary(table(spark, folder, "lineitem"))


def profile_top_values(spark: SparkSession, folder: str) -> DataFrame:
    return profile.top_values(table(spark, folder, "part"))


def profile_date_range(spark: SparkSession, folder: str) -> DataFrame:
    events = profile.date_range(table(spark, folder, "events"))
    return events.unionAll(profile.date_range(table(spark, folder, "lineitem")))


def health_score(spark: SparkSession, folder: str) -> DataFrame:
    """All columns; every tenth order stands there twice."""
    orders = inputs.gappy_orders(spark, folder)
    return profile.health_score(orders.unionAll(orders.where("o_orderkey % 10 = 0")))


def profile_table(spark: SparkSession, folder: str) -> DataFrame:
    """All profile tables of one input, as rows of (part, field, number, text)."""
    labels = {"columns": ["column"], "numeric_summary": ["column"], "categorical_summary": ["column", "rank"], "date_range": ["column"]}

    def rows(name: str, part: DataFrame) -> DataFrame:
        keys = [F.col(c).cast("string") for c in labels.get(name, [])]
        cells = []
        for value in [c for c in part.columns if c not in labels.get(name, [])]:
            is_text = part.schema[value].dataType.typeName() == "string"
            number, words = (F.lit(None), F.col(value)) if is_text else (F.col(value), F.lit(None))
            field = F.concat_ws(".", *keys, F.lit(value))
            cells.append(F.struct(field.alias("field"), number.cast("double").alias("number"), words.cast("string").alias("text")))
        return part.select(F.lit(name).alias("part"), F.inline(F.array(*cells)))

    parts = profile.profile_table(inputs.gappy_orders(spark, folder))
    return reduce(DataFrame.unionAll, [rows(name, part) for name, part in parts.items()])


def profile_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """Orders arriving year by year, profiled from their states; whether the sketches keep their bounds is counted in the table."""
    orders = inputs.gappy_orders(spark, folder)
    states = shared_folder(spark, "profile-states")
    year = F.year("o_orderdate")
    for (load,) in orders.select(year.alias("year")).distinct().collect():
        profile_states.write_states(orders.where(year.eqNullSafe(F.lit(load))), str(load), states)
    merged = write_once(profile_states.merged_profile(profile_states.read_states(spark, states)), "merged-profile")
    exact = profile.column_profile(orders).select("column", F.col("unique_count").alias("exact_count"))
    close = F.abs(F.col("unique_count") - F.col("exact_count")) <= 0.05 * F.col("exact_count")
    # Each number beside its column's three quantiles: one row per column and quantile is broadcast by its size.
    names = merged.select("column", F.col("position").cast("string").alias("position"), "p25", "p50", "p75").where("p50 IS NOT NULL")
    cells = orders.select(*[F.col(c).cast("double").alias(str(i)) for i, c in enumerate(orders.columns) if c in kinds.numeric_columns(orders)])
    ranked = cells.unpivot([], cells.columns, "position", "value").where("value IS NOT NULL").join(names, "position").groupBy("column").agg(
        *[
            ((F.avg((F.col("value") < F.col(q) - 0.01).cast("int")) <= p + 0.01) & (F.avg((F.col("value") <= F.col(q) + 0.01).cast("int")) >= p - 0.01)).alias(f"{q}_fits")
            for q, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))
        ]
    )
    return merged.join(exact, "column").join(ranked, "column", "left").select(
        "column", "position", "dtype", "null_count", "null_pct", close.alias("unique_fits"), "count", "mean", "std", "min", "max",
        (F.col("p25_fits") & F.col("p50_fits") & F.col("p75_fits")).alias("quantiles_fit"),
    )


def top_values_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """Parts arriving size by size; their columns have few enough values to be counted exactly."""
    parts = table(spark, folder, "part")
    states = shared_folder(spark, "part-states")
    size, bounds = F.coalesce("p_size", F.lit(0)), [None, 13, 26, 38, None]
    for low, high in zip(bounds, bounds[1:]):
        load = parts.where((F.lit(low is None) | (size >= F.lit(low))) & (F.lit(high is None) | (size < F.lit(high))))
        profile_states.write_states(load, f"from {low}", states)
    return profile_states.merged_top_values(profile_states.read_states(spark, states))


# --- revenue and charts ----------------------------------------------------


def _revenue_by(dimension: str) -> Query:
    return lambda spark, folder: revenue.revenue_by_dimension(sales_view(spark, folder, (dimension, revenue.REVENUE)), dimension)


def _trend_by(period: str) -> Query:
    return lambda spark, folder: revenue.revenue_trend(sales_view(spark, folder, (period, revenue.REVENUE)), period)


def top_performers(spark: SparkSession, folder: str) -> DataFrame:
    return revenue.top_performers(sales_view(spark, folder, ("vehicle_platform", revenue.REVENUE)), "vehicle_platform")


def growth_rates(spark: SparkSession, folder: str) -> DataFrame:
    return revenue.growth_rates(sales_view(spark, folder, ("build_category", "year", revenue.REVENUE)), "build_category")


def chart_year(spark: SparkSession, folder: str) -> DataFrame:
    return chart_data.year_series(sales_view(spark, folder, ("year", revenue.REVENUE)))


def chart_category(spark: SparkSession, folder: str) -> DataFrame:
    return chart_data.category_series(sales_view(spark, folder, ("build_category", revenue.REVENUE)), highlight=HIGHLIGHT)


def segment_vs_rest(spark: SparkSession, folder: str) -> DataFrame:
    return chart_data.segment_vs_rest(sales_view(spark, folder, ("build_category", "year", revenue.REVENUE)), SEGMENT)


def region_share(spark: SparkSession, folder: str) -> DataFrame:
    return chart_data.region_share(sales_view(spark, folder, ("region", revenue.REVENUE)))


def currency_labels(spark: SparkSession, folder: str) -> DataFrame:
    prices = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", (F.col("o_totalprice") * 10.0).alias("ten_times"))
    labelled = chart_data.with_currency_label(prices, "o_totalprice", "price_label")
    return chart_data.with_currency_label(labelled, "ten_times", "ten_times_label").select("o_orderkey", "price_label", "ten_times_label")


def all_charts(spark: SparkSession, folder: str) -> DataFrame:
    return chart_data.chart_data(sales_view(spark, folder, ("build_category", "region", "year", revenue.REVENUE)), SEGMENT)


def findings(spark: SparkSession, folder: str) -> DataFrame:
    """All revenue findings of the sales view as rows of (part, key, series, value, pct)."""
    sales = sales_view(spark, folder, ("build_category", "region", "vehicle_platform", "year", revenue.REVENUE))
    parts = analysis.revenue_findings(sales, segment=SEGMENT)
    none = F.lit(None)

    def rows(name: str, key: str, series: Column, value: str, pct: Column = none) -> DataFrame:
        named = F.concat(F.lit("charts."), F.col("chart")) if name == "charts" else F.lit(name)
        return parts[name].select(
            named.alias("part"), F.col(key).alias("key"), series.cast("string").alias("series"), F.col(value).alias("value"), pct.cast("double").alias("pct")
        )

    plain = [rows(name, "key", none, "revenue") for name in parts if name not in ("growth_rates", "charts")]
    rest = [rows("growth_rates", "group", F.col("year"), "revenue", F.col("yoy_pct")), rows("charts", "x", F.col("series"), "y")]
    return reduce(DataFrame.unionAll, plain + rest)


# --- search ----------------------------------------------------------------


def keywords(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", search.keywords(F.col("text")).alias("keywords"))


def search_queries(spark: SparkSession, folder: str) -> DataFrame:
    runs = table(spark, folder, "conversations").select(
        "conv_id", "turn", F.concat(F.lit(" "), "text").alias("question"), F.split("text", r"\. ", -1).alias("findings")
    )
    return search.search_queries(runs, anchors=ANCHORS)


def normalize_results(spark: SparkSession, folder: str) -> DataFrame:
    return search.normalise_results(inputs.raw_results(spark, folder))


def dedupe_results(spark: SparkSession, folder: str) -> DataFrame:
    return search.merge_results(inputs.search_results(spark, folder))


def result_block(spark: SparkSession, folder: str) -> DataFrame:
    merged = search.merge_results(search.previews(inputs.search_results(spark, folder)))
    return search.result_blocks(merged, inputs.search_runs(spark, folder))


def fallback_merge(spark: SparkSession, folder: str) -> DataFrame:
    return search.fallback_merge(*inputs.provider_calls(spark, folder))


def failed_runs(spark: SparkSession, folder: str) -> DataFrame:
    return search.failed_runs(inputs.provider_calls(spark, folder)[2])


# --- documents and retrieval -----------------------------------------------


def chunk_documents(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.chunk_documents(table(spark, folder, "documents").select("doc_id", "text"))


def corpus_errors(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    loaded = documents.select("doc_id", "source", F.when(F.col("lang") != "de", F.col("text")).alias("text"))
    return chunking.corpus(loaded, fail_fast=False)[1]


def corpus_chunks(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    loaded = documents.select("doc_id", F.col("source").alias("source_file"), F.when(F.col("lang") != "de", F.col("text")).alias("text"))
    return chunking.corpus(loaded, fail_fast=False)[0]


def count_letters():
    """A stand-in for an embedding model: how often some letters occur."""
    return lambda batch: [[float(text.count(letter)) for letter in VOWELS] for text in batch]


def embed_chunks(spark: SparkSession, folder: str) -> DataFrame:
    embedded = vectors.embed(chunk_documents(spark, folder), count_letters)
    return embedded.select("doc_id", "chunk_idx", F.posexplode("embedding").alias("position", "value"))


def embed_documents(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    embedded = vectors.embed(documents, count_letters, text="text")
    return embedded.select("doc_id", F.posexplode("embedding").alias("position", "value")).select(
        "doc_id", "position", F.col("value").cast("bigint").alias("value")
    )


def embed_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in two loads, the second with all of the first again, embedded by content."""
    store = shared_folder(spark, "vector-store")
    documents = table(spark, folder, "documents").select("doc_id", "text")
    embed_new(documents.where(F.col("doc_id") % 2 == 0), store, count_letters, text="text")
    embedded = embed_new(documents, store, count_letters, text="text")
    return embedded.select("doc_id", F.posexplode("embedding").alias("position", "value")).select(
        "doc_id", "position", F.col("value").cast("bigint").alias("value")
    )


def vector_dims(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.vector_dims(table(spark, folder, "embeddings"))


def _nearest(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.cosine_topk(
        table(spark, folder, "embeddings"), inputs.vector_queries(spark, folder), chunk_id="vec_id"
    )


def cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _nearest(spark, folder).select("query_id", "rank", "chunk_id")


def _retrieved(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.retrieve(inputs.vector_chunks(spark, folder), _nearest(spark, folder), chunk_id="vec_id", text="text")


def cosine_topk_scored(spark: SparkSession, folder: str) -> DataFrame:
    chunks = inputs.vector_chunks(spark, folder)
    return vectors.retrieve_scored(chunks, _nearest(spark, folder), chunk_id="vec_id", text="text", source="source")


def context_block(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.context_blocks(_retrieved(spark, folder))


def run_context(spark: SparkSession, folder: str) -> DataFrame:
    query = F.floor(F.col("query_id") / 10)
    blocks = vectors.context_blocks(_retrieved(spark, folder)).select(
        F.floor(query / 3).alias("run_id"), (query % 3).alias("query_idx"), F.when(query % 4 != 0, F.col("block")).otherwise("").alias("block")
    )
    runs = table(spark, folder, "benchmark").select(F.col("item_id").alias("run_id"))
    return vectors.run_contexts(runs, blocks)


# --- prompts and responses -------------------------------------------------


def prompts(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    slots = {
        "question": F.concat(F.lit("{role} "), F.col("text")),
        "role": "role",
        "notes": F.when(F.col("turn") % 2 == 0, F.col("text")),
    }
    return prompt_table(turns, PROMPT, slots).select("conv_id", "turn", "prompt")


def bullets(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    items = F.when(F.col("lang") == "de", F.array().cast("array<string>")).otherwise(F.split("text", "\n", -1))
    return with_bullets(documents.select("doc_id", items.alias("items")), "items", "bullets").drop("items")


def strip_fences(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.fenced_documents(spark, folder).select("doc_id", texts.strip_fences(F.col("raw")).alias("body"))


def strip_report_fence(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.fenced_documents(spark, folder).select("doc_id", texts.strip_report_fence(F.col("raw")).alias("body"))


def _parsed(spark: SparkSession, folder: str) -> DataFrame:
    return responses.parse_responses(inputs.model_responses(spark, folder))


def parse_responses(spark: SparkSession, folder: str) -> DataFrame:
    return _parsed(spark, folder).select("doc_id", "error")


def response_fields(spark: SparkSession, folder: str) -> DataFrame:
    valid = responses.valid_responses(_parsed(spark, folder))
    fields = responses.response_fields(valid, responses.INSIGHT_FIELDS)
    return fields.select(
        "doc_id",
        "executive_summary",
        F.array_join("opportunities", "|").alias("opportunities"),
        F.size("risks").cast("bigint").alias("n_risks"),
    )


def _role_fields(fields: dict[str, str]) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        valid = responses.valid_responses(responses.parse_responses(inputs.role_responses(spark, folder)))
        found = responses.response_fields(valid, fields)
        values = [F.array_join(n, "|").alias(n) if kind == "list" else F.col(n) for n, kind in fields.items()]
        return found.select("conv_id", "turn", *values)

    return query


def _recommended(spark: SparkSession, folder: str) -> DataFrame:
    return responses.with_recommendations(responses.valid_responses(_parsed(spark, folder))).drop("raw")


def recommendations(spark: SparkSession, folder: str) -> DataFrame:
    return responses.recommendation_rows(_recommended(spark, folder))


def recommendation_block(spark: SparkSession, folder: str) -> DataFrame:
    return _recommended(spark, folder).select("doc_id", reports.recommendation_block(F.col("recommendations")).alias("block"))


def clamp_confidence(spark: SparkSession, folder: str) -> DataFrame:
    valid = responses.valid_responses(_parsed(spark, folder))
    return valid.select("doc_id", responses.confidence(F.col("response")).alias("confidence_score"))


def _day_of(number: Column) -> Column:
    """Spreads the conversations over the days of the events."""
    return F.date_add(F.lit("2024-01-01").cast("date"), (number % 30).cast("int"))


def valid_questions(spark: SparkSession, folder: str) -> DataFrame:
    answered = responses.valid_questions(inputs.question_responses(spark, folder)).withColumn(
        "table_name", F.concat_ws("/", F.col("conv_id").cast("string"), _day_of(F.col("conv_id")).cast("string"))
    )
    suggested = questions.suggested_questions(inputs.column_catalogue(spark, folder))
    filled = questions.questions_or_fallback(answered, suggested)
    return questions.question_rows(filled.select("conv_id", "turn", "questions"))


def suggest_questions(spark: SparkSession, folder: str) -> DataFrame:
    return questions.question_rows(questions.suggested_questions(inputs.column_catalogue(spark, folder)))


def gauges(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    findings = F.when(F.length("text") > 20, F.filter(F.split("text", "\n", -1), lambda line: line != ""))
    signal = documents.select("doc_id", reports.market_signal(findings).alias("market_signal"))
    return signal.select(
        "doc_id", "market_signal", reports.gauge_band(F.col("market_signal")).alias("band"),
        reports.terminal_gauge_band(F.col("market_signal")).alias("terminal_band"),
    )


# --- reports and run log ---------------------------------------------------


def markdown_html(spark: SparkSession, folder: str) -> DataFrame:
    return reports.markdown_to_html(inputs.markdown_reports(spark, folder)).select("doc_id", "html")


def fold_run_state(spark: SparkSession, folder: str) -> DataFrame:
    return run_log.fold_state(inputs.state_updates(spark, folder))


def fold_run_errors(spark: SparkSession, folder: str) -> DataFrame:
    return run_log.fold_errors(inputs.state_updates(spark, folder))


def run_step_status(spark: SparkSession, folder: str) -> DataFrame:
    return run_log.step_status(inputs.step_events(table(spark, folder, "events")))


def stream_step_status(spark: SparkSession, folder: str) -> DataFrame:
    schema = table(spark, folder, "events").schema
    events = arrivals.arriving_files(spark, _as_pattern(folder, "events"), schema, kind="parquet")
    out = shared_folder(spark, "status-stream")
    changes = step_status.status_changes(inputs.step_events(events))
    write_changes(changes, f"{out}/status", f"{out}/checkpoint", keys=["run_id", "node"], order="seq").awaitTermination()
    return step_status.status_now(spark, f"{out}/status")


QUERIES: dict[str, Query] = {
    "csv_roundtrip": csv_roundtrip,
    "csv_with_schema": csv_with_schema,
    "csv_mixed_headers": csv_mixed_headers,
    "csv_split_quotes": csv_split_quotes,
    "stream_csv_clean": stream_csv_clean,
    "stream_dedup": stream_dedup,
    "text_docs": text_docs,
    "text_parts": text_parts,
    "result_payloads": result_payloads,
    "stream_revenue_by_dim": stream_revenue_by_dim,
    "clean_names": clean_names,
    "dedup_rows": dedup_rows,
    "trim_strings": trim_strings,
    "parse_dates": parse_dates,
    "dupes_dropped": dupes_dropped,
    "clean_orders": clean_orders,
    "profile_shape": profile_shape,
    "profile_columns": profile_columns,
    "profile_numeric": profile_numeric,
    "profile_top_values": profile_top_values,
    "profile_date_range": profile_date_range,
    "health_score": health_score,
    "profile_table": profile_table,
    "profile_incremental": profile_incremental,
    "top_values_incremental": top_values_incremental,
    "revenue_by_dimension_type": _revenue_by("build_category"),
    "revenue_by_dimension_region": _revenue_by("region"),
    "revenue_trend_year": _trend_by("year"),
    "revenue_trend_quarter": _trend_by("quarter"),
    "revenue_trend_month": _trend_by("month"),
    "top_performers": top_performers,
    "growth_rates": growth_rates,
    "chart_year": chart_year,
    "chart_category": chart_category,
    "segment_vs_rest": segment_vs_rest,
    "region_share": region_share,
    "currency_labels": currency_labels,
    "chart_data": all_charts,
    "findings": findings,
    "keywords": keywords,
    "search_queries": search_queries,
    "normalize_results": normalize_results,
    "dedupe_results": dedupe_results,
    "result_block": result_block,
    "fallback_merge": fallback_merge,
    "failed_runs": failed_runs,
    "chunk_documents": chunk_documents,
    "corpus_errors": corpus_errors,
    "corpus_chunks": corpus_chunks,
    "embed_chunks": embed_chunks,
    "embed_documents": embed_documents,
    "embed_incremental": embed_incremental,
    "vector_dims": vector_dims,
    "cosine_topk": cosine_topk,
    "cosine_topk_scored": cosine_topk_scored,
    "context_block": context_block,
    "run_context": run_context,
    "prompt_table": prompts,
    "bullets": bullets,
    "strip_fences": strip_fences,
    "parse_responses": parse_responses,
    "response_fields": response_fields,
    "analyst_fields": _role_fields(responses.ANALYST_FIELDS),
    "research_fields": _role_fields(responses.RESEARCH_FIELDS),
    "insight_fields": _role_fields(responses.INSIGHT_FIELDS),
    "recommendations": recommendations,
    "clamp_confidence": clamp_confidence,
    "valid_questions": valid_questions,
    "suggest_questions": suggest_questions,
    "recommendation_block": recommendation_block,
    "strip_report_fence": strip_report_fence,
    "gauges": gauges,
    "markdown_html": markdown_html,
    "fold_run_state": fold_run_state,
    "fold_run_errors": fold_run_errors,
    "step_status": run_step_status,
    "stream_step_status": stream_step_status,
    "stream_run_end": stream_run_end,
}
