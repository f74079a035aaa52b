"""Numeric and text-of-number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: Column | str, digits: int) -> Column:
    """Round half up after removing binary noise beyond nine digits."""
    column = F.col(value) if isinstance(value, str) else value
    return F.round(F.round(column, 9), digits)


def fixed_text(value: Column | str, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", fixed(value, digits))


def finite(value: Column | str) -> Column:
    """NaN and infinities become NULL."""
    column = F.col(value) if isinstance(value, str) else value
    bad = F.isnan(column) | (F.abs(column) == F.lit(float("inf")))
    return F.when(~bad, column)


def nan_to_null(value: Column | str) -> Column:
    column = F.col(value) if isinstance(value, str) else value
    return F.when(~F.isnan(column), column)


def zero_to_null(value: Column | str) -> Column:
    """Zero counts as missing, as in truth-value defaults."""
    column = F.col(value) if isinstance(value, str) else value
    return F.nullif(column, F.lit(0))


def lap_time_text(seconds: Column | str) -> Column:
    """``m:ss.mmm``; rounding comes first, so 119.9996 is 2:00.000."""
    rounded = fixed(seconds, 3)
    minutes = F.floor(rounded / 60)
    return F.format_string("%d:%06.3f", minutes, F.round(rounded - minutes * 60, 3))


def interval_seconds(value: Column | str) -> Column:
    """Seconds of a day-time interval."""
    column = F.col(value) if isinstance(value, str) else value
    return (
        F.extract(F.lit("DAY"), column) * 86400
        + F.extract(F.lit("HOUR"), column) * 3600
        + F.extract(F.lit("MINUTE"), column) * 60
        + F.extract(F.lit("SECOND"), column)
    ).cast("double")


def clean_text(value: Column | str) -> Column:
    """Blank and literal missing marks become NULL."""
    column = F.col(value) if isinstance(value, str) else value
    return F.when(~column.isin("nan", "None", "<NA>", ""), column)


def int_or(value: Column, default: int | None = None) -> Column:
    """Whole number of a text, or the default."""
    parsed = value.try_cast("int")
    return F.coalesce(parsed, F.lit(default)) if default is not None else parsed


def double_or(value: Column, default: float | None = None) -> Column:
    parsed = value.try_cast("double")
    return F.coalesce(parsed, F.lit(default)) if default is not None else parsed
