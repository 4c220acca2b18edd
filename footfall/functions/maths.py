"""Division and rounding column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as DOUBLE, NULL where ``whole`` is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    return ratio(part, whole) * 100


def half_up(value: Column, digits: int) -> Column:
    """Rounding as SQL engines do it: ties away from zero."""
    return F.round(value, digits)


def half_even(value: Column, digits: int) -> Column:
    """Rounding as Python and pandas do it: ties to the even digit."""
    return F.bround(value, digits)


def any_of(flags: Sequence[Column]) -> Column:
    """Row-wise OR over 0/1 columns."""
    return flags[0] if len(flags) == 1 else F.greatest(*flags)
