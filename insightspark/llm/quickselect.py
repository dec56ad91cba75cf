"""The rows with the k smallest keys, by distributed quickselect, and ranks for them alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from insightspark.session import write_once

# Random pivots per round; each splits the remaining keys once more.
PIVOTS = 15


def _below(keys: list[str], values: tuple) -> Column:
    """Whether a row's key comes before ``values``."""
    found = F.lit(False)
    for name, value in zip(reversed(keys), reversed(values)):
        found = (F.col(name) < value) | ((F.col(name) == value) & found)
    return found


def _equal(keys: list[str], values: tuple) -> Column:
    found = F.lit(True)
    for name, value in zip(keys, values):
        found = found & (F.col(name) == value)
    return found


def at_most(keys: list[str], values: tuple) -> Column:
    """Whether a row's key is ``values`` or before."""
    return _below(keys, values) | _equal(keys, values)


def kth_key(rows: DataFrame, keys: list[str], k: int, pivots: int = PIVOTS, seed: int = 11) -> tuple | None:
    """The k-th smallest key (from 1) of ``rows``; None if there are fewer.

    ``keys`` are BIGINT columns without nulls.  A round picks random keys as pivots and counts, in one
    aggregation, the rows before and at each of them; the rows between the two pivots around the k-th remain and
    are written.  Once no more rows than pivots remain all of them are pivots, so a round finds the key.  The driver
    sees the pivots and their counts only.
    """
    active, rank, round_ = rows.select(*keys), k, 0
    if k < 1:
        return None
    while True:
        round_ += 1
        chance = F.xxhash64(F.lit(seed + round_), *keys)
        chosen = sorted({tuple(r) for r in active.orderBy(chance).limit(pivots).collect()})
        if not chosen:
            return None
        counts = active.agg(
            *[F.count_if(_below(keys, x)).alias(f"b{i}") for i, x in enumerate(chosen)],
            *[F.count_if(_equal(keys, x)).alias(f"e{i}") for i, x in enumerate(chosen)],
        ).first()
        low, low_count, high = None, 0, None
        for i, pivot in enumerate(chosen):
            below, equal = counts[f"b{i}"], counts[f"e{i}"]
            if below < rank <= below + equal:
                return pivot
            if below + equal < rank:
                low, low_count = pivot, below + equal
            else:
                high = pivot
                break
        rank -= low_count
        if low is not None:
            active = active.filter(~_below(keys, low) & ~_equal(keys, low))
        if high is not None:
            active = active.filter(_below(keys, high))
        active = write_once(active, "quickselect")


def ranked(rows: DataFrame, keys: list[str], name: str = "rank") -> DataFrame:
    """``rows`` with their place (from 1) in the order of ``keys``.

    They are sorted over ranges and written with their place in their range; the sums over the ranges
    before, one number per range, make it a place in the whole.
    """
    placed = write_once(rows.orderBy(*keys).withColumn("_place", F.monotonically_increasing_id()), "sorted-winners")
    part = F.shiftright("_place", 33)
    sizes = sorted((r.part, r.n) for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, total = [], 0
    for number, n in sizes:
        before.append((number, total))
        total += n
    starts = placed.sparkSession.createDataFrame(before, "_part bigint, _before bigint")
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")  # one row per task that sorted
        .withColumn(name, inside + F.col("_before") + 1)
        .drop("_part", "_before", "_place")
    )
