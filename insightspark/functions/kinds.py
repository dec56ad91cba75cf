"""Column kinds: which columns count as numeric, categorical or temporal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FLOATING = (T.FloatType, T.DoubleType)
_TEMPORAL = (T.TimestampNTZType, T.TimestampType, T.DateType)


def column(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_columns(df: DataFrame) -> list[str]:
    """Numbers only: a boolean is neither numeric nor categorical."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def temporal_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, _TEMPORAL)]


def dtype_name(kind: T.DataType) -> str:
    """The dtype names dataframe users know."""
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, T.IntegralType):
        return "int64"
    if isinstance(kind, T.NumericType):
        return "float64"
    if isinstance(kind, T.TimestampType):
        return "datetime64[ns, UTC]"
    if isinstance(kind, _TEMPORAL):
        return "datetime64[ns]"
    return "object"


def present(name: str, kind: T.DataType) -> Column:
    """The value, with a floating NaN read as missing."""
    value = column(name)
    if isinstance(kind, _FLOATING):
        return F.when(~F.isnan(value), value)
    return value


def timestamp_text(value: Column) -> Column:
    """Seconds, plus six decimals only where there is a fraction; no time zone takes part."""
    text = value.cast("timestamp_ntz").cast("string")
    return F.when(F.contains(text, F.lit(".")), F.rpad(text, 26, "0")).otherwise(text)


def key_text(value: Column, kind: T.DataType) -> Column:
    """A group key as text, spelled as Python spells it."""
    if isinstance(kind, T.BooleanType):
        return F.initcap(value.cast("string"))
    if isinstance(kind, _TEMPORAL):
        return timestamp_text(value)
    if isinstance(kind, _FLOATING):
        return float_text(value)
    return value.cast("string")


def float_text(value: Column) -> Column:
    """A float as Python spells it: plain between 1e-4 and 1e16, else with a two-digit exponent."""
    java = value.cast("string")
    sign = F.when(F.startswith(java, F.lit("-")), "-").otherwise("")
    mantissa = F.regexp_extract(java, r"^-?([0-9.]+)E", 1)
    exponent = F.regexp_extract(java, r"E(-?[0-9]+)$", 1).try_cast("int")
    digits = F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), "(?<=.)0$", "")
    whole = F.rpad(F.substr(digits, F.lit(1), exponent + 1), exponent + 1, F.lit("0"))
    rest = F.substr(digits, exponent + 2)
    large = F.concat(sign, whole, F.lit("."), F.when(rest == "", "0").otherwise(rest))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    power = F.concat(F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), F.lit("0")))
    scientific = F.concat(sign, F.regexp_replace(mantissa, r"\.0$", ""), F.lit("e"), power)
    return (
        F.when(java == "Infinity", "inf")
        .when(java == "-Infinity", "-inf")
        .when(exponent.isNull(), java)
        .when(exponent.between(0, 15), large)
        .when(exponent.between(-4, -1), small)
        .otherwise(scientific)
    )
