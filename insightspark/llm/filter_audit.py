"""How filters interact: every order of them, step by step, by a recursive CTE over mask cells.

Each document becomes a mask of the filters it fails, and the table becomes cells:
the number of documents per part and mask.  The recursion starts with the empty prefix
of filters and extends every prefix by each unused letter.  A level joins the masks
that occur, carries the bits applied before, and emits what its step does to each mask.
It sees masks and no parts, so it has at most 325 prefixes x 32 masks whatever the table holds; the cells meet
its outcomes by mask and are summed per part, prefix and step.

Defined cases: a null text is empty; a null lang is the part ''; a document without a doc_id fails
E never and makes no other fail it; rows that share doc_id and text do not fail each other; a
document with several labels counts as good (toxic) if one of them says so; repeated rows count each; an
empty table has no parts and gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from insightspark.session import write_once

FILTERS = "ABCDE"
_WHITE = r"[\x20\x09-\x0D]+"


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def text_mask(text: Column) -> Column:
    """The bits of the filters that look at the text alone: A, B, C and D."""
    words = F.array_remove(F.split(text, _WHITE), "")
    n_words, n_distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = {
        "A": n_words < 100,
        "B": 100 * n_distinct < 80 * n_words,
        "C": 100 * capitals > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }
    return sum((F.when(fails[x], _bit(x)).otherwise(0) for x in fails), F.lit(0))


def mask_cells(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: numbers of documents; one row per part and mask that occur.

    Equal texts have equal bits but for E, so copies are counted per text, part and label before
    any of them meet.  A text then has as many rows as it has parts and labels, and all its
    documents fail E but those with its smallest id.
    """
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text_mask(text).alias("bits")
    )
    same = rows.groupBy("doc_id", "part", "digest", "bits").agg(F.count(F.lit(1)).alias("n"))
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    labelled = same.join(known, "doc_id", "left").withColumns(
        {c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")}
    )
    with_id = F.col("doc_id").isNotNull()
    # Written, since both the smallest ids and the counts are read from it.
    groups = write_once(
        labelled.groupBy("digest", "bits", "part", "good", "toxic").agg(
            F.coalesce(F.sum(F.when(with_id, F.col("n"))), F.lit(0)).alias("with_id"),
            F.coalesce(F.sum(F.when(~with_id, F.col("n"))), F.lit(0)).alias("without"),
            F.min("doc_id").alias("least"),
            F.coalesce(F.min(F.when(with_id, F.struct("doc_id", "n")))["n"], F.lit(0)).alias("at_least"),
        ),
        "equal-texts",
    )
    first = groups.groupBy("digest").agg(F.min("least").alias("first"))
    heads = F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    split = groups.join(first, "digest").select(
        "part", "bits", "good", "toxic", (heads + F.col("without")).alias("pass"), (F.col("with_id") - heads).alias("fail")
    )
    sides = F.explode(
        F.array(
            F.struct(F.col("bits").alias("mask"), F.col("pass").alias("n")),
            F.struct((F.col("bits") + _bit("E")).alias("mask"), F.col("fail").alias("n")),
        )
    )
    return (
        split.select("part", "good", "toxic", sides.alias("side"))
        .select("part", "good", "toxic", "side.*")
        .filter("n > 0")
        .groupBy("part", "mask")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
            F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
        )
    )


def outcomes(cells: DataFrame) -> DataFrame:
    """prefix, step, mask, and whether the step keeps, removes, finds removed already, or alone fails that mask."""
    letters = ", ".join(f"('{x}', {_bit(x)})" for x in FILTERS)
    return cells.sparkSession.sql(
        f"""
        WITH RECURSIVE letters(letter, bit) AS (VALUES {letters}),
        masks AS (SELECT DISTINCT mask FROM {{cells}}),
        steps(prefix, step, applied, mask, kept, removed, redundant, alone) AS (
            SELECT '', 0, 0, mask, 1, 0, 0, 0 FROM masks
            UNION ALL
            SELECT prefix || letter, step + 1, applied | bit, mask,
                CAST(mask & (applied | bit) = 0 AS INT),
                CAST(mask & applied = 0 AND mask & bit <> 0 AS INT),
                CAST(mask & applied <> 0 AND mask & bit <> 0 AS INT),
                CAST(mask = bit AS INT)
            FROM steps JOIN letters ON applied & bit = 0
            WHERE step < {len(FILTERS)}
        )
        SELECT prefix, step, mask, kept, removed, redundant, alone FROM steps WHERE step > 0
        """,
        cells=cells.select("mask"),
    )


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``documents`` has doc_id, text and lang, ``labels`` doc_id, quality and toxic.  A row per part, order
    of all filters and step; the step's filter is that letter of the order.
    """
    cells = write_once(mask_cells(documents, labels), "mask-cells")
    seen = write_once(outcomes(cells), "filter-outcomes")
    parts = write_once(
        cells.join(seen, "mask")
        .groupBy("part", "prefix", "step")
        .agg(
            *[F.sum(F.col("n") * F.col(c)).alias(name) for c, name in (("kept", "kept"), ("removed", "removed"), ("redundant", "redundant"), ("alone", "unique_fails"))],
            F.sum(F.col("good") * F.col("removed")).alias("good_lost"),
            F.sum(F.col("toxic") * F.col("removed")).alias("toxic_lost"),
        ),
        "filter-steps",
    )
    # Every prefix of a full order is a row of its own, so an order is cut into its prefixes.
    orders = seen.filter(F.col("step") == len(FILTERS)).select(F.col("prefix").alias("filter_order")).distinct()
    prefixes = orders.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS))))).withColumn(
        "prefix", F.expr("left(filter_order, step)")
    )
    steps = parts.join(prefixes, ["prefix", "step"])
    letter = F.right("prefix", F.lit(1))
    shapley = steps.groupBy("part", letter.alias("letter")).agg(F.sum("removed").alias("shapley"))
    return (
        steps.withColumn("letter", letter)
        .join(shapley, ["part", "letter"])
        .select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    )
