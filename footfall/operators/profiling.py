"""Table profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from footfall.functions.maths import half_up, percent


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``table_name, row_count`` for each table."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """``<column>, count``, most frequent first."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), column)


def null_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row of ``<column>_null_pct``, in one pass."""
    rows = F.count(F.lit(1))
    return df.agg(
        *[half_up(percent(F.count_if(F.col(c).isNull()), rows), 2).alias(f"{c}_null_pct") for c in columns]
    )


def time_range(df: DataFrame, ts: str, earliest: str = "earliest", latest: str = "latest") -> DataFrame:
    return df.agg(F.min(ts).alias(earliest), F.max(ts).alias(latest))


def event_type_stats(
    events: DataFrame,
    event_type: str = "event_type",
    session: str = "session_id",
    user: str = "user_id",
    approximate: bool = False,
) -> DataFrame:
    """Events, distinct sessions and distinct users per event type, most events first.

    ``approximate`` trades exact distinct counts for sketches, in one pass.
    """
    total = F.count(F.lit(1)).alias("total_events")
    if approximate:
        found = events.groupBy(event_type).agg(
            total,
            F.approx_count_distinct(session).alias("sessions_with_this_event"),
            F.approx_count_distinct(user).alias("unique_users"),
        )
        return found.orderBy(F.desc("total_events"), event_type)

    def distinct(column: str, name: str) -> DataFrame:
        pairs = events.select(F.col(event_type).alias("_type"), F.col(column).alias("_value")).distinct()
        return pairs.groupBy("_type").agg(F.count("_value").alias(name))

    # Narrow pairs combine where they are read; what is joined has a row per type.
    found = events.groupBy(event_type).agg(total)
    for column, name in ((session, "sessions_with_this_event"), (user, "unique_users")):
        counts = distinct(column, name)
        found = found.join(counts, found[event_type].eqNullSafe(counts["_type"])).drop("_type")
    return found.orderBy(F.desc("total_events"), event_type)


# Of an estimate of distinct values, relative; about 1.04 / sqrt(2^12) for sketches of 2^12 entries.
SKETCH_BITS = 12
SKETCH_ERROR = 0.01625


def daily_sketches(
    events: DataFrame,
    event_type: str = "event_type",
    session: str = "session_id",
    user: str = "user_id",
    ts: str = "created_at",
) -> DataFrame:
    """``day, event_type, events, sessions, users``: a day's counts as sketches that can be merged.

    Kept as a table, further days are further rows: what was counted is never read again.
    """
    def sketch(column: str, name: str) -> Column:
        return F.hll_sketch_agg(F.col(column).cast("string"), F.lit(SKETCH_BITS)).alias(name)

    return events.groupBy(F.to_date(ts).alias("day"), F.col(event_type).alias("event_type")).agg(
        F.count(F.lit(1)).alias("events"), sketch(session, "sessions"), sketch(user, "users")
    )


def merged_stats(sketches: DataFrame) -> DataFrame:
    """``event_type, total_events, sessions_estimate, users_estimate`` over the days given.

    Estimates of distinct sessions and users are off by SKETCH_ERROR (one standard deviation).
    """
    def estimate(sketch: str) -> Column:
        return F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(sketch)), F.lit(0))

    return sketches.groupBy("event_type").agg(
        F.sum("events").alias("total_events"),
        estimate("sessions").alias("sessions_estimate"),
        estimate("users").alias("users_estimate"),
    )


def user_type_share(events: DataFrame, user: str = "user_id") -> DataFrame:
    """``user_type, event_count, pct_of_total`` for anonymous and authenticated events."""
    overall = Window.partitionBy()  # over the aggregated rows: two
    kind = F.when(F.col(user).isNull(), "anonymous").otherwise("authenticated")
    return (
        events.groupBy(kind.alias("user_type"))
        .agg(F.count(F.lit(1)).alias("event_count"))
        .withColumn(
            "pct_of_total", half_up(percent(F.col("event_count"), F.sum("event_count").over(overall)), 2)
        )
    )


def top_users(events: DataFrame, n: int = 10, user: str = "user_id", ts: str = "created_at") -> DataFrame:
    """The ``n`` known users with the most events, ties by user."""
    return (
        events.where(F.col(user).isNotNull())
        .groupBy(user)
        .agg(
            F.count(F.lit(1)).alias("event_count"),
            F.min(ts).alias("first_event"),
            F.max(ts).alias("last_event"),
        )
        .orderBy(F.desc("event_count"), user)
        .limit(n)
    )
