"""Recency, frequency and monetary value per customer, and their quintile scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from footfall.fixed_values import REVENUE_STATUSES, SCORE_BUCKETS
from footfall.functions.dates import days_apart
from footfall.operators.ranking import Ranking, with_ntiles
from footfall.operators.retention import order_totals, sum_of_totals
from footfall.session import materialize


def rfm_base(
    orders: DataFrame,
    items: DataFrame,
    statuses: Sequence[str] = REVENUE_STATUSES,
    order_id: str = "order_id",
    user: str = "user_id",
    ts: str = "created_at",
    status: str = "status",
    price: str = "sale_price",
) -> DataFrame:
    """``user_id, recency_days, frequency, monetary_value`` over qualifying orders with items.

    Recency counts from the last qualifying order of the whole table; frequency counts
    distinct order dates.  The per-user rows are written out once: the last date is taken
    from them, and ranking and clustering read them again, so the fact tables are scanned
    and joined a single time.
    """
    per_user = (
        orders.where(F.col(status).isin(*statuses))
        .select(order_id, F.col(user).alias("user_id"), F.to_date(ts).alias("_date"))
        .join(order_totals(items, order_id, price), order_id)
        .groupBy("user_id")
        .agg(
            F.max("_date").alias("_last"),
            F.count_distinct("_date").alias("frequency"),
            # A DECIMAL is rounded as such, so that half cents are exact.
            F.round(sum_of_totals(items, price), 2).cast("double").alias("monetary_value"),
        )
    )
    per_user = materialize(per_user, "rfm")
    return per_user.select(
        "user_id",
        days_apart(per_user.agg(F.max("_last")).scalar(), F.col("_last")).cast("long").alias("recency_days"),
        "frequency",
        "monetary_value",
    )


def rfm_scores(base: DataFrame, buckets: int = SCORE_BUCKETS) -> DataFrame:
    """Adds ``r_score, f_score, m_score``, 1 (worst) to ``buckets`` (best), ties by user."""
    scores = {
        "r_score": Ranking("recency_days", descending=True),
        "f_score": Ranking("frequency"),
        "m_score": Ranking("monetary_value"),
    }
    return with_ntiles(base, scores, buckets, tie="user_id")
