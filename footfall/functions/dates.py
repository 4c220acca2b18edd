"""Calendar column expressions."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, functions as F, types as T

# More than the distance between any two LONGs.
_TIE_RANGE = 2 * 10**19


def month_start(moment: Column) -> Column:
    """First day of the month of a timestamp or date, as DATE."""
    return F.trunc(F.to_date(moment), "MM")


def months_apart(later: Column, earlier: Column) -> Column:
    """Whole calendar months between two month starts."""
    return (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)


def days_apart(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def micros(moment: Column) -> Column:
    """Microseconds since the epoch.

    A timestamp without time zone is read in the session's zone, which should be UTC.
    """
    return F.unix_micros(moment.cast("timestamp"))


def minutes_apart(later: Column, earlier: Column) -> Column:
    """Fractional minutes between two timestamps, exact to the microsecond."""
    return (micros(later) - micros(earlier)) / F.lit(60_000_000.0)


def in_micros(span: timedelta) -> int:
    return span // timedelta(microseconds=1)


def month_label(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def order_key(df: DataFrame, ts: str, tie: str) -> Column:
    """Orders rows by ``ts``, NULLs first, then ``tie``.

    With a whole-number tie it is one number of fixed width, so that ``min_by`` and
    ``max_by`` of fixed-width values are hash aggregates; else it is a struct.
    """
    if not isinstance(df.schema[tie].dataType, T.IntegralType):
        return F.struct(ts, tie)
    lowest = F.lit("-9900000000000000000").cast("decimal(19,0)")  # below any LONG
    moment = F.coalesce(micros(F.col(ts)), F.lit(-(10**17) * 9)).cast("decimal(18,0)")
    return (moment * F.lit(str(_TIE_RANGE)).cast("decimal(20,0)") + F.coalesce(F.col(tie).cast("decimal(19,0)"), lowest)).cast("decimal(38,0)")
