"""Standard cleaning: names, exact duplicates, whitespace, dates by name."""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from insightspark.errors import DataIngestionError
from insightspark.functions.kinds import column, text_columns
from insightspark.functions.text import strip


def normalise_names(df: DataFrame) -> DataFrame:
    """Strip, lower-case, and turn spaces into underscores."""
    names = [name.strip().lower().replace(" ", "_") for name in df.columns]
    repeated = [name for name, times in Counter(names).items() if times > 1]
    if repeated:
        raise DataIngestionError(f"Column names are equal after normalising: {', '.join(repeated)}")
    return df.toDF(*names)


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """One of each set of exactly equal rows; nulls equal nulls.

    Copies collapse before the shuffle, so one row repeated without end costs
    one shuffled row per task.
    """
    return df.dropDuplicates()


def duplicate_counts(df: DataFrame) -> DataFrame:
    """One row: ``row_count``, ``distinct_count``, ``dupes_dropped``."""
    groups = df.groupBy(*[column(n) for n in df.columns]).agg(F.count(F.lit(1)).alias("copies"))
    return groups.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).cast("bigint").alias("row_count"),
        F.count(F.lit(1)).alias("distinct_count"),
        (F.coalesce(F.sum("copies"), F.lit(0)) - F.count(F.lit(1))).cast("bigint").alias("dupes_dropped"),
    )


def trim_strings(df: DataFrame) -> DataFrame:
    """Strip all Unicode whitespace around text values; other columns untouched."""
    texts = set(text_columns(df))
    return df.select(*[strip(column(n)).alias(n) if n in texts else column(n) for n in df.columns])


# Date layouts in order of preference.  Each is a pattern and its rewrite to ISO.
# The patterns keep impossible months out, which would cost an exception each.
_MONTH, _DAY = r"(0?[1-9]|1[0-2])", r"(0?[1-9]|[12]\d|3[01])"
_ISO = r"(\d{4})-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])"
_DATE_LAYOUTS = [
    (_ISO, "$1-$2-$3"),
    (rf"(\d{{4}})/{_MONTH}/{_DAY}", "$1-$2-$3"),
    (rf"{_MONTH}/{_DAY}/(\d{{4}})", "$3-$1-$2"),
    (rf"{_DAY}/{_MONTH}/(\d{{4}})", "$3-$2-$1"),
    (rf"{_MONTH}-{_DAY}-(\d{{4}})", "$3-$1-$2"),
    (rf"{_DAY}-{_MONTH}-(\d{{4}})", "$3-$2-$1"),
]
_MINUTE = r"(?:[01]\d|2[0-3]):[0-5]\d"
_TIME_LAYOUTS = ["", rf"[ T]({_MINUTE})", rf"[ T]({_MINUTE}:[0-5]\d)", rf"[ T]({_MINUTE}:[0-5]\d\.\d{{1,9}})"]
_ZONES = ["", r"(Z|[+-]\d{2}:\d{2})"]


Layout = tuple[str, str, str]


def _layouts() -> list[Layout]:
    """(pattern, rewrite, type) of every layout that can be recognised."""
    found = []
    for (date, iso), time, zone in product(_DATE_LAYOUTS, _TIME_LAYOUTS, _ZONES):
        if zone and not time:
            continue
        rewrite = iso + (" $4" if time else "") + ("$5" if zone else "")
        found.append((f"^{date}{time}{zone}$", rewrite, "timestamp" if zone else "timestamp_ntz"))
    return found


def _read_as(text: Column, layout: Layout) -> Column:
    pattern, rewrite, kind = layout
    if not pattern:
        return F.lit(None).cast(kind)
    # ISO texts are cast as they are.
    iso = text if pattern.startswith("^" + _ISO) else F.regexp_replace(text, pattern, rewrite)
    return F.when(text.rlike(pattern), iso.try_cast(kind))


def parse_dates(df: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """Parse text columns whose name contains "date", each as a whole or not at all.

    A layout is accepted only if it reads every non-null value.  A probe value per
    column, all from one aggregation, narrows the layouts to those that could be accepted; one aggregation over
    the candidate columns alone then decides.  ``evidence`` may be a cheaper
    table with the same values, such as the one before duplicates were dropped.
    """
    texts = set(text_columns(df))
    names = [n for n in df.columns if "date" in n and n in texts]
    if not names:
        return df
    source = df if evidence is None else evidence
    accepted = _accepted_layouts(source, names)
    converted = {n: _read_as(column(n), layout).alias(n) for n, layout in accepted.items() if layout}
    return df.select(*[converted.get(n, column(n)) for n in df.columns])


def _accepted_layouts(source: DataFrame, names: list[str]) -> dict[str, Layout | None]:
    # One value of every column, in one scan of these columns.
    probes = source.agg(*[F.any_value(column(n), F.lit(True)).alias(f"probe{i}") for i, n in enumerate(names)]).first()
    plausible = {n: _plausible_layouts(probe) for n, probe in zip(names, probes)}
    open_names = [n for n in names if plausible[n]]
    if not open_names:
        return {}
    checks = [F.bit_and(_readable_bits(column(n), plausible[n])).alias(f"bits{i}") for i, n in enumerate(open_names)]
    bits = source.agg(*checks).first()
    return {
        n: next((layout for bit, layout in enumerate(plausible[n]) if bits[i] is None or bits[i] >> bit & 1), None)
        for i, n in enumerate(open_names)
    }


def _plausible_layouts(probe: str | None) -> list[Layout]:
    """Layouts whose pattern fits one value of the column; an empty one if it has none."""
    if probe is None:
        return [("", "", "timestamp_ntz")]
    return [layout for layout in _layouts() if re.match(layout[0], probe)]


def _readable_bits(text: Column, layouts: list[Layout]) -> Column:
    """Bit i is set if layout i reads the text; null for a null text."""
    bits = [F.when(_read_as(text, layout).isNotNull(), 1 << i).otherwise(0) for i, layout in enumerate(layouts)]
    return F.when(text.isNotNull(), reduce(Column.__add__, bits))


def clean_table(df: DataFrame) -> DataFrame:
    """Names, then duplicates, then whitespace, then dates, in that order.

    Rows that differ only in whitespace survive: duplicates are dropped before
    trimming.  The date check runs on the undeduplicated rows, which hold the
    same values, so it costs a scan of the date columns and no shuffle.
    """
    named = normalise_names(df)
    return parse_dates(trim_strings(drop_duplicate_rows(named)), evidence=trim_strings(named))
