"""Mixing sources to target weights by entropy balancing, with Spark expressions only.

A document of ``size`` words gets a rate between 0 and ``CEILING``.  Among all
rates whose expected words meet each source's target, the ones of least
relative entropy are an exponential tilt of the size held below the ceiling:
``CEILING / (1 + exp(-lambda * size / mean))``.  One multiplier per source solves the
convex dual; Newton's steps are aggregations over (source, size) counts, so no
step sees single documents.  The rates are then rounded into whole copies.

Defined cases: a null text has size 0 and is never taken; a null source is a
source of its own, last in order; repeated rows each count; an empty table
gives an empty mix; sources of size 0 get target 0.  Sums are taken in fixed
point, so they do not depend on the order of rows and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from insightspark.session import write_once

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CEILING = 2
# Parts into which the documents of one (source, size) are split for ranking.
PARTS = 256
_STEPS_PER_JOB = 3
_JOBS = 20
_SCALE = 1024.0
_ROUNDS_PER_JOB = 6


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    """The source without nulls, for joins."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source))


def source_targets(sizes: DataFrame) -> DataFrame:
    """Per source: target words.  ``sizes`` has source, source_key, source_size, n_docs.

    Weights repeat over the sources in code point order, null last.  Targets
    above the ceiling stop there and the excess goes to the others by weight.
    With the sources sorted by ceiling per weight, the common level is that of
    the first source that stays below its ceiling.  One row per source meets here.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), place + 1)
    rows = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size").cast("double") * CEILING)
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "source_key")
    before = F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("total", F.sum("source_size").over(everything) * SHARE)
    rows = rows.withColumn("level", (F.col("total") - before) / rest).withColumn("rank", F.row_number().over(by_ratio))
    fits = F.col("level") <= F.col("most") / F.col("weight") * (1 + 1e-12)
    level = F.min(F.when(fits, F.struct("rank", "level"))).over(everything)["level"]
    return rows.select(
        "source_key",
        "source_size",
        "n_docs",
        F.least(F.col("most"), F.col("weight") * level).alias("target"),
        "most",
    )


def _fixed(value: Column) -> Column:
    """A number that sums up the same in any order."""
    return F.round(value * _SCALE).cast("decimal(28,0)")


def _rate(multiplier: Column, size: Column, mean: Column) -> Column:
    return CEILING / (1 + F.exp(-multiplier * size / mean))


def _newton_step(state: DataFrame, counts: DataFrame) -> DataFrame:
    rate = _rate(F.col("multiplier"), F.col("size"), F.col("mean"))
    words = F.col("size") * F.col("n")
    sums = (
        counts.join(state.select("source_key", "multiplier", "mean"), "source_key")
        .groupBy("source_key")
        .agg(
            (F.sum(_fixed(words * rate)).cast("double") / _SCALE).alias("words"),
            (
                F.sum(_fixed(words * F.col("size") / F.col("mean") * rate * (1 - rate / CEILING))).cast("double") / _SCALE
            ).alias("slope"),
        )
    )
    joined = state.drop("miss").join(sums, "source_key", "left")
    miss = F.coalesce(F.col("target") - F.col("words"), F.lit(0.0))
    step = F.when(F.col("open") & (F.col("slope") > 0), miss / F.col("slope")).otherwise(0.0)
    return joined.withColumn("multiplier", F.col("multiplier") + step).withColumn(
        "miss", F.when(F.col("open"), F.abs(miss) / F.col("source_size")).otherwise(0.0)
    ).drop("words", "slope")


def _multipliers(targets: DataFrame, counts: DataFrame) -> DataFrame:
    """The dual's solution.  From 0, Newton's steps approach the root from one side."""
    state = targets.select(
        "source_key",
        "source_size",
        "target",
        (F.col("source_size") / F.col("n_docs")).alias("mean"),
        F.lit(0.0).alias("multiplier"),
        ((F.col("target") < F.col("most") * (1 - 1e-9)) & (F.col("source_size") > 0)).alias("open"),
        F.lit(1.0).alias("miss"),
    )
    for _ in range(_JOBS):
        for _ in range(_STEPS_PER_JOB):
            state = _newton_step(state, counts)
        state = write_once(state, "mix-state")
        if not (state.agg(F.max("miss")).first()[0] or 0) > 1e-6:
            break
    return state


def copies_by_size(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """Per (source, size): how many copies its ``n`` documents get together.

    Running sums from the largest size down are rounded, so each source's
    number of copies is off by less than one at any size.  What is still
    missing in words is then settled over all sizes, until no round brings it closer.
    """
    state = _multipliers(targets, counts)
    rows = counts.join(state.select("source_key", "multiplier", "mean", "open", "target"), "source_key")
    rate = F.when(F.col("open"), _rate(F.round("multiplier", 9), F.col("size"), F.col("mean"))).otherwise(F.lit(float(CEILING)))
    running = Window.partitionBy("source_key").orderBy(F.col("size").desc())
    upto = F.sum(F.col("n") * rate).over(running)
    rounded = F.floor(upto + 0.5)
    plan = rows.withColumn("upto", rounded)
    plan = plan.withColumn("copies", F.col("upto") - F.coalesce(F.lag("upto").over(running), F.lit(0)))
    plan = plan.select("source_key", "size", "n", "target", "copies")
    while True:
        for _ in range(_ROUNDS_PER_JOB):
            plan = _repaired(plan)
        plan = write_once(plan, "mix-plan")
        if plan.filter("moved").isEmpty():
            return plan.drop("moved")


def _repaired(plan: DataFrame) -> DataFrame:
    """One round: every size that fits into what is missing, from the largest down, until it is filled.

    Where none fits, the smallest one beyond it is taken once if that leaves less than
    before; the next round goes the other way.  So what is missing shrinks with every move.
    """
    source = Window.partitionBy("source_key")
    down = source.orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = plan.select("source_key", "size", "n", "target", "copies").withColumn(
        "missing", F.round(F.max("target").over(source)).cast("long") - F.sum(F.col("copies") * F.col("size")).over(source)
    )
    rows = rows.withColumn("room", F.when(F.col("missing") > 0, F.col("n") * CEILING - F.col("copies")).otherwise(F.col("copies")))
    rows = rows.withColumn("usable", (F.col("size") <= F.abs("missing")) & (F.col("room") > 0))
    words = F.when(F.col("usable"), F.col("room") * F.col("size")).otherwise(F.lit(0))
    rows = rows.withColumn("left", F.abs("missing") - F.coalesce(F.sum(words).over(down), F.lit(0)))
    beyond = F.min(F.when((F.col("size") > F.abs("missing")) & (F.col("room") > 0), F.col("size"))).over(source)
    rows = rows.withColumn("beyond", F.when(~F.max("usable").over(source), beyond))
    closer = F.col("size").eqNullSafe(F.col("beyond")) & (F.col("size") < 2 * F.abs("missing"))
    amount = (
        F.when(F.col("usable") & (F.col("left") > 0), F.least(F.col("room"), F.floor(F.col("left") / F.col("size"))))
        .when(closer, F.lit(1))
        .otherwise(F.lit(0))
        .cast("long")
    )
    moved = amount * F.signum(F.col("missing").cast("double")).cast("long")
    return rows.select(
        "source_key", "size", "n", "target", (F.col("copies") + moved).alias("copies"), (amount > 0).alias("moved")
    )


def mix(documents: DataFrame) -> DataFrame:
    """``documents`` with size, source_size, target, copies and taken.

    The documents of one size in one source get copies that differ by one at most;
    which get more is decided by a hash of doc_id.  Ranks are counted in parts
    and the parts' counts are summed up, so a size that holds most rows is not
    ranked in one task.
    """
    own = documents.columns
    keep = [F.col(f"`{c}`").alias(f"_own_{i}") for i, c in enumerate(own)]
    shuffled = F.xxhash64(F.lit("mix"), F.col("doc_id"))
    rows = documents.select(
        *keep,
        F.col("source"),
        _source_key(F.col("source")).alias("source_key"),
        word_count(F.col("text")).alias("size"),
        shuffled.alias("order"),
        F.pmod(shuffled, F.lit(PARTS)).alias("part"),
    )
    # Counts are small and used many times, so they are written.
    parts = write_once(
        rows.groupBy("source", "source_key", "size", "part").agg(F.count(F.lit(1)).alias("n")), "mix-counts"
    )
    counts = write_once(
        parts.filter("size > 0").groupBy("source_key", "size").agg(F.sum("n").alias("n")), "mix-sizes"
    )
    sizes = parts.groupBy("source", "source_key").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs")
    )
    targets = write_once(source_targets(sizes), "mix-targets")
    plan = copies_by_size(counts, targets)
    before = Window.partitionBy("source_key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    places = (
        parts.select(
            "source_key", "size", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")
        )
        .join(plan.select("source_key", "size", F.col("n").alias("alike"), F.col("copies").alias("shared")), ["source_key", "size"], "left")
        .join(targets.select("source_key", "source_size", "target"), "source_key")
    )
    ranked = rows.withColumn(
        "place", F.row_number().over(Window.partitionBy("source_key", "size", "part").orderBy("order", "_own_0"))
    ).join(places, ["source_key", "size", "part"])
    each = F.floor(F.col("shared") / F.col("alike"))
    more = (F.col("before") + F.col("place") <= F.col("shared") - each * F.col("alike")).cast("long")
    copies = F.coalesce(each + more, F.lit(0)).cast("long")
    return ranked.withColumn("copies", copies).select(
        *[F.col(f"_own_{i}").alias(c) for i, c in enumerate(own) if c not in ("size", "source_size", "target", "copies", "taken")],
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )
