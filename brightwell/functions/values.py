"""Value rules: clocks, decimal coercion, ratios and half-up rounding as column expressions."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, functions as F

DECIMAL = "decimal(20,6)"


def ntz(moment) -> Column:
    """A time-zone-free timestamp literal; columns pass through as a cast."""
    if isinstance(moment, Column):
        return moment.cast("timestamp_ntz")
    if isinstance(moment, datetime):
        moment = moment.strftime("%Y-%m-%d %H:%M:%S.%f")
    elif isinstance(moment, date):
        moment = moment.isoformat()
    return F.lit(str(moment)).cast("timestamp_ntz")


def ago(moment, **units) -> Column:
    """``moment`` minus an interval, e.g. ``ago(as_of, days=7)``."""
    return ntz(moment) - interval(**units)


def interval(days: int = 0, hours: int = 0, mins: int = 0, secs: int = 0) -> Column:
    return F.make_dt_interval(F.lit(days), F.lit(hours), F.lit(mins), F.lit(secs))


def decimal_value(col: Column) -> Column:
    """Any value as a number: null and non-numeric text become zero."""
    return F.coalesce(col.cast("string").try_cast(DECIMAL), F.lit(0).cast(DECIMAL))


def ratio(part: Column, whole: Column, scale: int = 6) -> Column:
    """``part / whole`` of two counts, rounded half up; zero when the denominator is zero."""
    quotient = F.try_divide(part.cast("decimal(20,0)"), whole.cast("decimal(20,0)"))
    return F.coalesce(F.round(quotient, scale), F.lit(0)).cast(f"decimal(20,{scale})")


def percent(part: Column, whole: Column, scale: int = 2) -> Column:
    """``part / whole * 100`` rounded half up, null when the denominator is zero."""
    quotient = F.try_divide(part.cast("decimal(18,0)") * F.lit(100), whole.cast("decimal(18,0)"))
    return F.round(quotient, scale).cast(f"decimal(20,{scale})")


def count_when(condition: Column) -> Column:
    """Number of rows for which the condition is true (null counts as false)."""
    return F.count_if(condition)


def half_open(ts: Column, start=None, end=None) -> Column:
    """``start <= ts < end`` with either side optional."""
    condition = F.lit(True)
    if start is not None:
        condition = ts >= ntz(start)
    if end is not None:
        upper = ts < ntz(end)
        condition = upper if start is None else condition & upper
    return condition


def escaped_contains(col: Column, needle: str) -> Column:
    """Case-insensitive substring test; pattern characters in the needle are plain text."""
    return F.contains(F.lower(col), F.lit(needle.lower()))
