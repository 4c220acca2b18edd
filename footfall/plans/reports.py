"""The four reports: funnel, retention, experiment, segmentation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame

from footfall.fixed_values import ALPHA, EXPECTED_SPLIT, POWER, REVENUE_STATUSES, SEGMENT_COUNT
from footfall.operators import experiment, funnel, retention, rfm, segments
from footfall.session import materialize


@dataclass(frozen=True)
class FunnelReport:
    sessions: DataFrame
    kpis: DataFrame
    steps: DataFrame
    abandonment: DataFrame
    traffic: DataFrame


def funnel_report(events: DataFrame) -> FunnelReport:
    """Sessions are aggregated once and written; the four summaries read a few flags of them."""
    sessions = materialize(funnel.session_funnel(events), "sessions")
    return FunnelReport(
        sessions,
        funnel.funnel_kpis(sessions),
        funnel.funnel_steps(sessions),
        funnel.abandonment_distribution(sessions),
        funnel.stage_traffic(sessions),
    )


@dataclass(frozen=True)
class RetentionReport:
    cohorts: DataFrame
    revenue: DataFrame
    kpis: DataFrame


def retention_report(
    orders: DataFrame,
    items: DataFrame,
    as_of: date | None = None,
    statuses: Sequence[str] = REVENUE_STATUSES,
) -> RetentionReport:
    """Both tables are a row per month, kept so that the figures do not recompute them."""
    matrix = retention.cohort_retention(orders, statuses=statuses)
    cohorts = materialize(retention.retention_rates(matrix), "cohorts")
    revenue = materialize(retention.monthly_revenue(orders, items, as_of, statuses), "revenue")
    return RetentionReport(
        cohorts.orderBy("cohort_month"),
        revenue.orderBy("month"),
        retention.retention_kpis(cohorts, revenue),
    )


@dataclass(frozen=True)
class ExperimentReport:
    arms: DataFrame
    power: DataFrame
    srm: DataFrame
    ztest: DataFrame
    decision: DataFrame


def experiment_report(
    arms: DataFrame,
    keys: Sequence[str],
    mde: float,
    alpha: float = ALPHA,
    power: float = POWER,
    expected_split: tuple[float, float] = EXPECTED_SPLIT,
    srm_alpha: float = ALPHA,
) -> ExperimentReport:
    """Power, sample-ratio check, z-test and decision for one row of counts per experiment.

    ``arms`` comes from ``arms_side_by_side`` or, for typed-in counts, ``counts_table``.
    """
    arms = materialize(arms, "arms")
    needed = experiment.power_table(
        experiment.measured_baselines(arms, keys), [mde], keys, alpha=alpha, power=power
    )
    srm = experiment.srm_check(arms, keys, expected_split, srm_alpha)
    ztest = experiment.proportion_ztest(arms, keys, alpha)
    decision = experiment.decide(arms, mde, keys, alpha, power, expected_split, srm_alpha)
    return ExperimentReport(arms, needed, srm, ztest, decision)


@dataclass(frozen=True)
class SegmentationReport:
    customers: DataFrame
    profiles: DataFrame
    kpis: DataFrame
    revenue: DataFrame
    sample: DataFrame


def segmentation_report(
    orders: DataFrame,
    items: DataFrame,
    statuses: Sequence[str] = REVENUE_STATUSES,
    k: int = SEGMENT_COUNT,
) -> SegmentationReport:
    """Score, scale, cluster, profile and label customers."""
    base = rfm.rfm_base(orders, items, statuses)
    prepared = segments.robust_scale(base, segments.scale_parameters(base))
    fitted, _ = segments.fit_segments(prepared, k)
    fitted = materialize(fitted, "segments")
    profiles = segments.segment_actions(segments.label_segments(segments.segment_profiles(fitted)))
    customers = segments.attach_labels(fitted, profiles)
    return SegmentationReport(
        customers,
        profiles,
        segments.segment_kpis(customers),
        segments.revenue_at_stake(customers),
        segments.segment_sample(customers),
    )
