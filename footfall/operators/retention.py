"""Cohort retention and monthly revenue."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from footfall.fixed_values import RETENTION_OFFSETS, REVENUE_STATUSES
from footfall.functions.dates import month_label, month_start, months_apart
from footfall.functions.maths import half_even, half_up, percent, ratio
from footfall.functions.money import Money


def cohort_retention(
    orders: DataFrame,
    offsets: Sequence[int] = RETENTION_OFFSETS,
    statuses: Sequence[str] = REVENUE_STATUSES,
    cohort_statuses: Sequence[str] | None = None,
    user: str = "user_id",
    ts: str = "created_at",
    status: str = "status",
) -> DataFrame:
    """``cohort_month, m0, m1, ...``: users with a qualifying order k months after joining.

    A user joins in the month of the first order of any state, or of ``cohort_statuses``.
    Orders are first reduced to one row per user and month, which makes every later count
    a plain sum and leaves at most one row per calendar month to sort for any user.
    """
    flags = [F.max(F.col(status).isin(*statuses)).alias("_kept")]
    joining_month = F.col("_month")
    if cohort_statuses is not None:
        flags.append(F.max(F.col(status).isin(*cohort_statuses)).alias("_joins"))
        joining_month = F.when(F.col("_joins"), joining_month)
    monthly = (
        orders.where(F.col(user).isNotNull())
        .groupBy(F.col(user).alias("_user"), month_start(F.col(ts)).alias("_month"))
        .agg(*flags)
    )
    first_month = F.min(joining_month).over(Window.partitionBy("_user"))
    placed = (
        monthly.withColumn("cohort_month", first_month)
        .where(F.col("_kept"))
        .withColumn("_offset", months_apart(F.col("_month"), F.col("cohort_month")))
    )
    if cohort_statuses is not None:
        placed = placed.where(F.col("cohort_month").isNotNull())
    return (
        placed.groupBy("cohort_month")
        .agg(*[F.count_if(F.col("_offset") == k).alias(f"m{k}") for k in offsets])
        .orderBy("cohort_month")
    )


def retention_rates(
    cohorts: DataFrame, offsets: Sequence[int] = RETENTION_OFFSETS, digits: int = 1
) -> DataFrame:
    """Adds ``m<k>_rate`` (percent of m0, NULL where m0 is zero) and ``cohort_label``."""
    rates = {
        f"m{k}_rate": half_even(percent(F.col(f"m{k}"), F.col("m0")), digits) for k in offsets if k != 0
    }
    return cohorts.withColumns(rates).withColumn("cohort_label", month_label(F.col("cohort_month")))


def monthly_revenue(
    orders: DataFrame,
    items: DataFrame,
    as_of: date | None = None,
    statuses: Sequence[str] = REVENUE_STATUSES,
    order_id: str = "order_id",
    ts: str = "created_at",
    status: str = "status",
    price: str = "sale_price",
) -> DataFrame:
    """``month, revenue, prev_month_revenue, mom_growth_pct`` for months before ``as_of``'s.

    The previous month is the previous row, so a month without sales is skipped.
    ``as_of`` defaults to today.
    """
    today = F.current_date() if as_of is None else F.lit(as_of)
    # Compared as it is stored, so that the bound reaches the scan.
    sold = orders.where(F.col(status).isin(*statuses) & (F.col(ts) < month_start(today)))
    by_month = Window.orderBy("month")  # over the aggregated rows: one per month
    return (
        sold.select(order_id, month_start(F.col(ts)).alias("month"))
        .join(order_totals(items, order_id, price), order_id)
        .groupBy("month")
        .agg(sum_of_totals(items, price).cast("double").alias("revenue"))
        .withColumn("prev_month_revenue", F.lag("revenue").over(by_month))
        .withColumn(
            "mom_growth_pct",
            half_up(
                ratio(F.col("revenue") - F.col("prev_month_revenue"), F.col("prev_month_revenue")) * 100, 2
            ),
        )
        .orderBy("month")
    )


def order_totals(items: DataFrame, order_id: str = "order_id", price: str = "sale_price") -> DataFrame:
    """One row per order with its summed price, in parts (see ``sum_of_totals``).

    Joining orders to this and not to the items costs no extra shuffle (both sides are
    needed by order id anyway), sends combined rows through it, and leaves no order with
    more than one row to join however many items it holds.
    """
    return items.groupBy(order_id).agg(*Money.of(items, price).sums(F.col(price), "_total"))


def sum_of_totals(items: DataFrame, price: str = "sale_price") -> Column:
    """Aggregate over rows of ``order_totals(items)``: their sum, DECIMAL if the price is."""
    return Money.of(items, price).total_of("_total")


def retention_kpis(rates: DataFrame, revenue: DataFrame) -> DataFrame:
    """One row: ``avg_m1, avg_m3, latest_mom, n_cohorts``; means to six digits.

    A mean of doubles depends on row order in its last digits, hence the rounding.
    """
    latest = revenue.where(F.col("mom_growth_pct").isNotNull()).agg(F.max_by("mom_growth_pct", "month"))
    return rates.agg(
        F.round(F.avg("m1_rate"), 6).alias("avg_m1"),
        F.round(F.avg("m3_rate"), 6).alias("avg_m3"),
        F.count(F.lit(1)).alias("n_cohorts"),
    ).select("avg_m1", "avg_m3", latest.scalar().alias("latest_mom"), "n_cohorts")
