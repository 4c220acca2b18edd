"""Session funnels: which milestones a session reached and where it ended."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from footfall.fixed_values import DEEPEST_STAGE_LABELS, FUNNEL_STAGES, FUNNEL_STEPS, NO_STAGE_LABEL
from footfall.functions.maths import any_of, half_even, percent


def reached(stage: str) -> str:
    return f"reached_{stage}"


def session_funnel(
    events: DataFrame,
    session: str | Sequence[str] = "session_id",
    ts: str = "created_at",
    event_type: str = "event_type",
    labels: Mapping[str, str] = DEEPEST_STAGE_LABELS,
    no_stage: str = NO_STAGE_LABEL,
) -> DataFrame:
    """One row per session: start, event count, a 0/1 flag per milestone, deepest label.

    ``labels`` maps event types to labels, shallow to deep; milestones count whenever
    they happen in the session.  All aggregates combine before the shuffle.
    """
    keys = [session] if isinstance(session, str) else list(session)
    flags = [
        F.max(F.when(F.col(event_type) == stage, 1).otherwise(0)).alias(reached(stage)) for stage in labels
    ]
    deepest = F.lit(no_stage)
    for stage, label in labels.items():
        deepest = F.when(F.col(reached(stage)) == 1, label).otherwise(deepest)
    return (
        events.groupBy(*keys)
        .agg(F.min(ts).alias("session_start"), F.count(F.lit(1)).alias("total_events"), *flags)
        .withColumn("abandonment_stage", deepest)
    )


def funnel_kpis(funnel: DataFrame, cart: str = "cart", purchase: str = "purchase") -> DataFrame:
    """One row: sessions, share reaching cart and purchase, cart conversion and loss."""
    sessions = F.count(F.lit(1))
    carts, purchases = F.sum(reached(cart)), F.sum(reached(purchase))
    converted = percent(purchases, F.greatest(carts, F.lit(1)))
    return funnel.agg(
        sessions.alias("total_sessions"),
        percent(carts, sessions).alias("reached_cart_pct"),
        percent(purchases, sessions).alias("purchase_pct"),
        converted.alias("cart_to_purchase_pct"),
        (F.lit(100.0) - converted).alias("lost_cart_pct"),
    )


def funnel_steps(funnel: DataFrame, steps: Sequence[tuple[str, Sequence[str]]] = FUNNEL_STEPS) -> DataFrame:
    """``step, label, count, pct_of_initial``: one row per step, one pass over the sessions."""
    def sessions_at(stages: Sequence[str]) -> Column:
        if not stages:
            return F.count(F.lit(1))
        return F.coalesce(F.sum(any_of([F.col(reached(stage)) for stage in stages])), F.lit(0))

    totals = funnel.agg(*[sessions_at(stages).alias(f"_{i}") for i, (_, stages) in enumerate(steps)])
    rows = [
        F.struct(F.lit(i + 1).alias("step"), F.lit(label).alias("label"), F.col(f"_{i}").alias("count"))
        for i, (label, _) in enumerate(steps)
    ]
    return (
        totals.select(F.col("_0").alias("_initial"), F.explode(F.array(*rows)).alias("row"))
        .select("row.*", "_initial")
        .withColumn("pct_of_initial", percent(F.col("count"), F.col("_initial")))
        .drop("_initial")
        .orderBy("step")
    )


def abandonment_distribution(funnel: DataFrame) -> DataFrame:
    """``stage, count, pct``: sessions by where they ended, most frequent first."""
    overall = Window.partitionBy()  # over the aggregated rows: one per label
    return (
        funnel.groupBy(F.col("abandonment_stage").alias("stage"))
        .agg(F.count(F.lit(1)).alias("count"))
        .withColumn("pct", half_even(percent(F.col("count"), F.sum("count").over(overall)), 1))
        .orderBy(F.desc("count"), "stage")
    )


def stage_traffic(funnel: DataFrame, stages: Sequence[str] = FUNNEL_STAGES) -> DataFrame:
    """``stage, sessions, pct``: sessions that hit each milestone, in funnel order."""
    totals = funnel.agg(
        F.count(F.lit(1)).alias("_total"),
        *[F.coalesce(F.sum(reached(stage)), F.lit(0)).alias(stage) for stage in stages],
    )
    rows = [F.struct(F.lit(reached(s)).alias("stage"), F.col(s).alias("sessions")) for s in stages]
    return (
        totals.select("_total", F.posexplode(F.array(*rows)).alias("_position", "row"))
        .select("row.*", percent(F.col("row.sessions"), F.col("_total")).alias("pct"), "_position")
        .orderBy("_position")
        .drop("_position")
    )
