"""Every operator as a query over the star-schema files."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from footfall.operators import (
    experiment,
    funnel,
    identity,
    profiling,
    quality,
    retention,
    rfm,
    segments,
    sessions,
)
from footfall.plans import reports
from footfall.plans.result_cache import cached
from footfall.session import materialize
from footfall.sources import bucketed, footers, star_schema as shop
from footfall.sources.tables import normalise, preview
from footfall.streaming.sessions import run_available

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = date(2001, 8, 1)
SIGNUP_CUTOFF = date(1995, 6, 1)
LONG_GAP = timedelta(hours=12)
HOT_USER_EVENTS = 60
STREAM_SLICES = timedelta(days=2)
MARKET = ("market",)
PRIORITY = "1-URGENT"
SPLIT_OF_FIVE = {"control": 0.4, "wording": 0.2, "colour": 0.2, "price": 0.1, "layout": 0.1}
MDES = (0.01, 0.02, 0.05, 0.2)
DECISION_MDE = 0.2
SAMPLE_ROWS = 500
ORDER_BUCKETS = 8


# Profiles


def table_counts(spark: SparkSession, folder: str) -> DataFrame:
    return profiling.table_counts({name: shop.table(spark, folder, name) for name in shop.TABLES})


def table_counts_from_footers(spark: SparkSession, folder: str) -> DataFrame:
    return footers.footer_counts(spark, {name: f"{folder}/{name}.parquet" for name in shop.TABLES})


def order_ranges_from_footers(spark: SparkSession, folder: str) -> DataFrame:
    return footers.footer_ranges(spark, f"{folder}/orders.parquet", ["o_orderkey", "o_custkey"])


def events_preview(spark: SparkSession, folder: str) -> DataFrame:
    return preview(shop.events(spark, folder), order_by="id")


def event_type_counts(spark: SparkSession, folder: str) -> DataFrame:
    return profiling.value_counts(shop.events(spark, folder), "event_type")


def order_status_counts(spark: SparkSession, folder: str) -> DataFrame:
    return profiling.value_counts(shop.orders(spark, folder), "status")


def null_rates(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["user_id", "session_id", "created_at", "event_type", "uri"]
    return profiling.null_rates(shop.events(spark, folder), columns)


def order_time_range(spark: SparkSession, folder: str) -> DataFrame:
    return profiling.time_range(shop.orders(spark, folder), "created_at", "earliest_order", "latest_order")


def event_type_stats(spark: SparkSession, folder: str) -> DataFrame:
    return profiling.event_type_stats(shop.events(spark, folder))


def event_type_stats_from_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """Estimates over stored daily sketches, against exact counts: within four standard errors?"""
    events = shop.events(spark, folder)
    daily = materialize(profiling.daily_sketches(events), "daily-sketches")
    exact = profiling.event_type_stats(events).withColumnRenamed("total_events", "_events")

    def close(estimate: str, count: str):
        return F.abs(F.col(estimate) - F.col(count)) <= F.greatest(F.col(count) * (4 * profiling.SKETCH_ERROR), F.lit(1))

    return profiling.merged_stats(daily).join(exact, "event_type").select(
        "event_type", "total_events", close("sessions_estimate", "sessions_with_this_event").alias("sessions_close"),
        close("users_estimate", "unique_users").alias("users_close"),
    )


def user_type_share(spark: SparkSession, folder: str) -> DataFrame:
    return profiling.user_type_share(shop.events(spark, folder))


def top_users(spark: SparkSession, folder: str) -> DataFrame:
    return profiling.top_users(shop.events(spark, folder))


# Sessions and identity


def _visits(spark: SparkSession, folder: str, **options) -> DataFrame:
    events = shop.events(spark, folder).select("id", "visitor_id", "created_at", "event_type")
    return sessions.sessionize(events, user_key="visitor_id", **options)


def sessionize(spark: SparkSession, folder: str) -> DataFrame:
    return _visits(spark, folder)


def sessionize_authenticated(spark: SparkSession, folder: str) -> DataFrame:
    """Anonymous events, 40 percent of all, have no user and so no session."""
    events = shop.events(spark, folder).select("id", "user_id", "created_at", "event_type")
    return sessions.sessionize(events, gap=LONG_GAP)


def sessionize_hot_users(spark: SparkSession, folder: str) -> DataFrame:
    """About half of the users count as too large for one task; the result must not show it."""
    return _visits(spark, folder, gap=LONG_GAP, hot_rows=HOT_USER_EVENTS)


def session_summary(spark: SparkSession, folder: str) -> DataFrame:
    return sessions.session_summary(_visits(spark, folder), "visitor_id")


def _streamed(spark: SparkSession, folder: str, **options) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/events.parquet").schema

    def arriving(own: SparkSession) -> DataFrame:
        stream = own.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
        return normalise(stream).withColumn("ts", F.col("ts").cast("timestamp"))

    run = run_available(spark, arriving, "stream-sessions", ts="ts", gap=LONG_GAP, **options)
    if run.late_rows:
        raise RuntimeError(f"{run.late_rows} rows came too late for their session")
    return run.sessions


def sessionize_streaming(spark: SparkSession, folder: str) -> DataFrame:
    return _streamed(spark, folder)


def sessionize_streaming_in_slices(spark: SparkSession, folder: str) -> DataFrame:
    """State by user and two days; sessions that cross a border are stitched."""
    return _streamed(spark, folder, slices=STREAM_SLICES)


def resolve_identity(spark: SparkSession, folder: str) -> DataFrame:
    return identity.resolve_identity(shop.events(spark, folder))


def mixed_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return identity.mixed_sessions(shop.events(spark, folder))


def session_identity_audit(spark: SparkSession, folder: str) -> DataFrame:
    return identity.session_identity_audit(shop.events(spark, folder))


# Funnels


def session_funnel(spark: SparkSession, folder: str) -> DataFrame:
    return funnel.session_funnel(shop.events(spark, folder))


def funnel_of_visits(spark: SparkSession, folder: str) -> DataFrame:
    """The funnel over sessions found by inactivity instead of tracking tokens."""
    visits = _visits(spark, folder, gap=LONG_GAP)
    return funnel.session_funnel(visits, session=("visitor_id", "session_sequence"))


def funnel_kpis(spark: SparkSession, folder: str) -> DataFrame:
    return funnel.funnel_kpis(session_funnel(spark, folder))


def funnel_steps(spark: SparkSession, folder: str) -> DataFrame:
    return funnel.funnel_steps(session_funnel(spark, folder))


def abandonment_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return funnel.abandonment_distribution(session_funnel(spark, folder))


def stage_traffic(spark: SparkSession, folder: str) -> DataFrame:
    return funnel.stage_traffic(session_funnel(spark, folder))


# Retention and revenue


def cohort_retention(spark: SparkSession, folder: str) -> DataFrame:
    return retention.cohort_retention(shop.orders(spark, folder), statuses=shop.REVENUE_STATUSES)


def retention_rates(spark: SparkSession, folder: str) -> DataFrame:
    return retention.retention_rates(cohort_retention(spark, folder))


def retention_rates_two_digits(spark: SparkSession, folder: str) -> DataFrame:
    return retention.retention_rates(cohort_retention(spark, folder), digits=2)


def monthly_revenue(spark: SparkSession, folder: str) -> DataFrame:
    return retention.monthly_revenue(
        shop.orders(spark, folder), shop.order_items(spark, folder), AS_OF, shop.REVENUE_STATUSES
    )


def monthly_revenue_bucketed(spark: SparkSession, folder: str) -> DataFrame:
    """Orders and items kept by order: what joins them afterwards moves nothing."""
    orders, items = (
        bucketed.read_bucketed(spark, bucketed.write_bucketed(df, "order_id", ORDER_BUCKETS))
        for df in (shop.orders(spark, folder), shop.order_items(spark, folder))
    )
    return retention.monthly_revenue(orders, items, AS_OF, shop.REVENUE_STATUSES)


def retention_rates_cached(spark: SparkSession, folder: str) -> DataFrame:
    return cached(retention_rates(spark, folder))


def retention_kpis(spark: SparkSession, folder: str) -> DataFrame:
    return retention.retention_kpis(retention_rates(spark, folder), monthly_revenue(spark, folder))


# Customer scores


def rfm_base(spark: SparkSession, folder: str) -> DataFrame:
    return rfm.rfm_base(shop.orders(spark, folder), shop.order_items(spark, folder), shop.REVENUE_STATUSES)


def rfm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return rfm.rfm_scores(rfm_base(spark, folder))


# Experiments: a conversion is a completed or shipped urgent order, unless stated


def experiment_groups(spark: SparkSession, folder: str) -> DataFrame:
    return experiment.assign_groups(shop.users(spark, folder), SIGNUP_CUTOFF)


def _summary(
    spark: SparkSession, folder: str, keys: tuple[str, ...], urgent_only: bool = True
) -> DataFrame:
    converts = F.col("priority") == PRIORITY if urgent_only else None
    assigned = experiment.assign_groups(shop.users(spark, folder), SIGNUP_CUTOFF, keys=keys)
    return experiment.experiment_summary(
        assigned, shop.orders(spark, folder), keys, shop.REVENUE_STATUSES, converts=converts
    )


def experiment_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _summary(spark, folder, ())


def experiment_summary_all_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Any completed or shipped order converts, urgent or not."""
    return _summary(spark, folder, (), urgent_only=False)


def experiment_summary_by_market(spark: SparkSession, folder: str) -> DataFrame:
    return _summary(spark, folder, MARKET)


def _arms(spark: SparkSession, folder: str) -> DataFrame:
    return experiment.arms_side_by_side(_summary(spark, folder, MARKET), MARKET)


def srm_check(spark: SparkSession, folder: str) -> DataFrame:
    return experiment.srm_check(_arms(spark, folder), MARKET)


def srm_check_arms(spark: SparkSession, folder: str) -> DataFrame:
    """Five arms by market, of users dealt into a hundred buckets by id."""
    bucket = F.col("id") * 37 % 100
    assigned = experiment.assign_arms(shop.users(spark, folder), SPLIT_OF_FIVE, bucket, keys=MARKET)
    found = experiment.experiment_summary(assigned, shop.orders(spark, folder), MARKET, shop.REVENUE_STATUSES)
    return experiment.srm_check_arms(found, SPLIT_OF_FIVE, MARKET)


def proportion_ztest(spark: SparkSession, folder: str) -> DataFrame:
    return experiment.proportion_ztest(_arms(spark, folder), MARKET)


def power_table(spark: SparkSession, folder: str) -> DataFrame:
    baselines = experiment.measured_baselines(_arms(spark, folder), MARKET)
    return experiment.power_table(baselines, MDES, MARKET)


def power_table_bonferroni(spark: SparkSession, folder: str) -> DataFrame:
    """Every market is a slice of one experiment, so each is judged at alpha over their number."""
    baselines = experiment.bonferroni(experiment.measured_baselines(_arms(spark, folder), MARKET))
    return experiment.power_table(baselines, MDES, MARKET, alpha="alpha")


def experiment_decision(spark: SparkSession, folder: str) -> DataFrame:
    return reports.experiment_report(_arms(spark, folder), MARKET, DECISION_MDE).decision


def experiment_decision_overall(spark: SparkSession, folder: str) -> DataFrame:
    """The one experiment, not cut by market."""
    arms = experiment.arms_side_by_side(_summary(spark, folder, ()))
    return reports.experiment_report(arms, (), DECISION_MDE).decision


# Segments


def scale_parameters(spark: SparkSession, folder: str) -> DataFrame:
    return segments.scale_parameters(rfm_base(spark, folder))


def robust_scale(spark: SparkSession, folder: str) -> DataFrame:
    base = materialize(rfm_base(spark, folder), "base")
    return segments.robust_scale(base, segments.scale_parameters(base))


def fit_segments(spark: SparkSession, folder: str) -> DataFrame:
    return segments.fit_segments(robust_scale(spark, folder))[0]


def k_sweep(spark: SparkSession, folder: str) -> DataFrame:
    return segments.k_sweep(robust_scale(spark, folder))


def _quadrants(spark: SparkSession, folder: str, base: DataFrame | None = None) -> DataFrame:
    """Segments by rule: recent or not, high spend or not.  Same in SQL, unlike clusters."""
    recent, spends = F.col("r_score") > 3, F.col("m_score") > 3
    scores = rfm.rfm_scores(rfm_base(spark, folder) if base is None else base)
    return scores.withColumn("segment", recent.cast("int") * 2 + spends.cast("int"))


def silhouette_of_quadrants(spark: SparkSession, folder: str) -> DataFrame:
    base = materialize(rfm_base(spark, folder), "base")
    rows = segments.robust_scale(base, segments.scale_parameters(base))
    quadrants = _quadrants(spark, folder, base).select("user_id", "segment")
    return segments.squared_silhouette(rows.join(quadrants, "user_id"))


def segmentation_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """What any sound clustering fulfils, whatever its numbering and starts."""
    fitted, model = segments.fit_segments(robust_scale(spark, folder))
    return segments.check_fit(fitted, model)


def segment_profiles(spark: SparkSession, folder: str) -> DataFrame:
    return segments.segment_profiles(_quadrants(spark, folder))


def label_segments(spark: SparkSession, folder: str) -> DataFrame:
    return segments.label_segments(segment_profiles(spark, folder))


def segment_actions(spark: SparkSession, folder: str) -> DataFrame:
    return segments.segment_actions(label_segments(spark, folder))


def attach_labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = materialize(_quadrants(spark, folder), "quadrants")
    return segments.attach_labels(rows, segments.label_segments(segments.segment_profiles(rows)))


def revenue_at_stake(spark: SparkSession, folder: str) -> DataFrame:
    return segments.revenue_at_stake(attach_labels(spark, folder))


def segment_kpis(spark: SparkSession, folder: str) -> DataFrame:
    return segments.segment_kpis(attach_labels(spark, folder))


def segment_sample(spark: SparkSession, folder: str) -> DataFrame:
    return segments.segment_sample(attach_labels(spark, folder), SAMPLE_ROWS)


def segmentation_report(spark: SparkSession, folder: str) -> DataFrame:
    return reports.segmentation_report(
        shop.orders(spark, folder), shop.order_items(spark, folder), shop.REVENUE_STATUSES
    ).profiles


# Checks


def quality_checks(spark: SparkSession, folder: str) -> DataFrame:
    found = session_funnel(spark, folder)
    # One row per user, cohort and month: everything is checked on these, none of it on events.
    visits = materialize(quality.visits_by_user(sessionize(spark, folder), "visitor_id"), "visits")
    cohorts = materialize(cohort_retention(spark, folder), "cohorts")
    revenue = materialize(quality.with_position(monthly_revenue(spark, folder), "month"), "revenue")
    return quality.all_checks(
        [
            quality.check_funnel(found),
            quality.check_visits(visits),
            quality.check_unique("cohort is unique", cohorts, "cohort_month"),
            quality.check_cohort_decay(cohorts),
            quality.check_months_increase(revenue),
            quality.check_first_growth(revenue),
        ]
    )


def quality_checks_observed(spark: SparkSession, folder: str) -> DataFrame:
    """Checks taken along by the jobs that write sessions and funnels; events are read once."""
    events = shop.events(spark, folder).select("id", "visitor_id", "session_id", "created_at", "event_type", "traffic_source", "browser", "user_id")
    visits, of_visits = quality.observed(sessions.sessionize(events, user_key="visitor_id"), quality.visit_rules())
    visits = materialize(visits, "visits")
    found, of_sessions = quality.observed(funnel.session_funnel(visits), quality.funnel_rules())
    found = materialize(found, "funnels")
    per_user, of_users = quality.observed(
        sessions.session_summary(visits, "visitor_id"), {"sessions equal boundaries": F.col("sessions") != F.col("boundaries")}
    )
    materialize(per_user, "session-summary")
    unique = quality.check_unique("session is unique", found, "session_id")
    return quality.observed_report(spark, [of_visits, of_sessions, of_users]).unionByName(unique)


QUERIES: tuple[Query, ...] = (
    monthly_revenue,
    table_counts,
    table_counts_from_footers,
    order_ranges_from_footers,
    events_preview,
    event_type_counts,
    order_status_counts,
    null_rates,
    order_time_range,
    event_type_stats,
    event_type_stats_from_sketches,
    user_type_share,
    top_users,
    sessionize,
    sessionize_authenticated,
    sessionize_hot_users,
    session_summary,
    sessionize_streaming,
    sessionize_streaming_in_slices,
    resolve_identity,
    mixed_sessions,
    session_identity_audit,
    session_funnel,
    funnel_of_visits,
    funnel_kpis,
    funnel_steps,
    abandonment_distribution,
    stage_traffic,
    cohort_retention,
    retention_rates,
    retention_rates_two_digits,
    retention_rates_cached,
    monthly_revenue_bucketed,
    retention_kpis,
    rfm_base,
    rfm_scores,
    experiment_groups,
    experiment_summary,
    experiment_summary_all_orders,
    experiment_summary_by_market,
    srm_check,
    srm_check_arms,
    proportion_ztest,
    power_table,
    power_table_bonferroni,
    experiment_decision,
    experiment_decision_overall,
    scale_parameters,
    robust_scale,
    fit_segments,
    k_sweep,
    silhouette_of_quadrants,
    segmentation_invariants,
    segment_profiles,
    label_segments,
    segment_actions,
    attach_labels,
    revenue_at_stake,
    segment_kpis,
    segment_sample,
    segmentation_report,
    quality_checks,
    quality_checks_observed,
)
