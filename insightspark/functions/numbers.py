"""Rounding and number formatting that agree with Python to the last digit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def numpy_round(value: Column, digits: int) -> Column:
    """Array-style rounding: half to even on the scaled double."""
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def python_round(value: Column, digits: int) -> Column:
    """Scalar-style rounding: by the exact binary value of the double.

    The product with a power of ten is split into its double result and the
    exact rounding error; the error decides what looks like a tie.
    """
    scale = float(10**digits)

    def rounded(x: Column) -> Column:
        product = x * scale
        # Veltkamp split of the value: the scale has few enough bits to stay whole.
        carrier = x * 134217729.0
        high = carrier - (carrier - x)
        error = (high * scale - product) + (x - high) * scale
        whole = F.floor(product).cast("double")
        tie = product - whole == 0.5
        return F.when(tie & (error > 0), whole + 1.0).when(tie & (error < 0), whole).otherwise(F.rint(product)) / scale

    return bind(value, rounded)


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed, and written in the plan, only once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def percent(part: Column, total: Column) -> Column:
    """``part / total * 100`` as double, null where the total is zero."""
    return F.try_divide(part.cast("double"), total.cast("double")) * 100.0


def clamp(value: Column, low: int, high: int) -> Column:
    """Keep a value in range; a null becomes ``low`` (greatest/least skip nulls)."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(value, F.lit(low))))


def currency_label(value: Column) -> Column:
    """Axis label: millions with one decimal, thousands without."""
    millions = F.format_string("$%.1fM", python_round(value / 1_000_000.0, 1))
    thousands = F.format_string("$%.0fK", F.rint(value / 1_000.0))
    return F.when(value >= 1_000_000.0, millions).when(value.isNotNull(), thousands)
