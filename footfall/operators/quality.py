"""Data-quality checks.  Each returns one row: ``check, violations, passed``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F

from footfall.fixed_values import FUNNEL_STAGES, SESSION_GAP
from footfall.functions.dates import in_micros, order_key
from footfall.operators.funnel import reached


def _report(name: str, bad_rows: DataFrame) -> DataFrame:
    return _count(name, bad_rows, F.lit(True))


def _count(name: str, rows: DataFrame, bad: Column) -> DataFrame:
    return rows.agg(F.count_if(bad).alias("violations")).select(
        F.lit(name).alias("check"), "violations", (F.col("violations") == 0).alias("passed")
    )


def all_checks(checks: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def check_unique(name: str, df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once."""
    return _report(name, df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1))


def check_funnel(
    funnel: DataFrame, session: str = "session_id", stages: Sequence[str] = FUNNEL_STAGES
) -> DataFrame:
    """Two rows: sessions that occur more than once, sessions without a single milestone."""
    hits = reduce(lambda total, stage: total + F.col(reached(stage)), stages, F.lit(0))
    per_session = funnel.groupBy(session).agg(
        F.count(F.lit(1)).alias("_rows"), F.count_if(hits == 0).alias("_bounced")
    )
    return _report_all(
        per_session,
        {
            "session is unique": F.count_if(F.col("_rows") > 1),
            "session reaches a stage": F.coalesce(F.sum("_bounced"), F.lit(0)),
        },
    )


def _report_all(rows: DataFrame, counts: Mapping[str, Column]) -> DataFrame:
    """A row per check, all counted in one pass."""
    found = rows.agg(*[count.alias(f"_{i}") for i, count in enumerate(counts.values())])
    checks = F.array(
        *[F.struct(F.lit(name).alias("check"), F.col(f"_{i}").alias("violations")) for i, name in enumerate(counts)]
    )
    return found.select(F.inline(checks)).withColumn("passed", F.col("violations") == 0)


def observed(rows: DataFrame, bad: Mapping[str, Column]) -> tuple[DataFrame, Observation]:
    """``rows``, and what a pass over them will tell: how many are ``bad``, by check.

    The counts are taken along by whatever job first computes the rows, such as the one that
    writes them; nothing is read for them.
    """
    found = Observation()
    counts = [F.count_if(condition).alias(name) for name, condition in bad.items()]
    return rows.observe(found, *counts), found


def observed_report(spark: SparkSession, observations: Sequence[Observation]) -> DataFrame:
    """A row per observed check; waits for the jobs that they are taken along with."""
    rows = [(name, int(count), count == 0) for o in observations for name, count in o.get.items()]
    return spark.createDataFrame(rows, "check string, violations long, passed boolean")


def visit_rules(gap: timedelta = SESSION_GAP) -> dict[str, Column]:
    """What is wrong with a single event of ``sessionize``: a user's first event that is not
    number 1 or not flagged, a longer gap not flagged, a shorter gap flagged."""
    limit = in_micros(gap) / 60_000_000
    minutes, flag = F.col("mins_since_last_event"), F.col("is_new_session")
    return {
        "first event opens session 1": minutes.isNull() & ((F.col("session_sequence") != 1) | (flag != 1)),
        "long gap opens a session": (minutes > limit) & (flag != 1),
        "short gap stays in session": (minutes <= limit) & (flag != 0),
    }


def funnel_rules(stages: Sequence[str] = FUNNEL_STAGES) -> dict[str, Column]:
    """What is wrong with a single session of ``session_funnel``: it reaches no stage."""
    hits = reduce(lambda total, stage: total + F.col(reached(stage)), stages, F.lit(0))
    return {"session reaches a stage": hits == 0}


def visits_by_user(
    sessionized: DataFrame, user: str = "user_id", ts: str = "created_at", tie: str = "id",
    gap: timedelta = SESSION_GAP,
) -> DataFrame:
    """Per user what ``check_visits`` looks at, in one pass over the events."""
    limit = in_micros(gap) / 60_000_000
    minutes, flag = F.col("mins_since_last_event"), F.col("is_new_session")
    first = order_key(sessionized, ts, tie)
    return sessionized.groupBy(user).agg(
        F.min_by("session_sequence", first).alias("first_sequence"),
        F.min_by("is_new_session", first).alias("first_flag"),
        F.max("session_sequence").alias("sessions"),
        F.sum("is_new_session").alias("boundaries"),
        F.count_if((minutes > limit) & (flag != 1)).alias("long_unflagged"),
        F.count_if((minutes <= limit) & (flag != 0)).alias("short_flagged"),
    )


def check_visits(visits: DataFrame) -> DataFrame:
    """Four rows: users whose first event is not number 1 or not flagged; longer gaps not
    flagged; shorter gaps flagged; users whose highest session number differs from their
    number of boundaries."""
    return _report_all(
        visits,
        {
            "first event opens session 1": F.count_if((F.col("first_sequence") != 1) | (F.col("first_flag") != 1)),
            "long gap opens a session": F.coalesce(F.sum("long_unflagged"), F.lit(0)),
            "short gap stays in session": F.coalesce(F.sum("short_flagged"), F.lit(0)),
            "sessions equal boundaries": F.count_if(F.col("sessions") != F.col("boundaries")),
        },
    )


def check_cohort_decay(cohorts: DataFrame) -> DataFrame:
    """Cohorts with more users in month 1 than in month 0."""
    return _count("month 1 within month 0", cohorts, F.col("m1") > F.col("m0"))


def with_position(report: DataFrame, order: str) -> DataFrame:
    """Adds ``position``, where a row of a small report stands; made where it is sorted."""
    return report.withColumn("position", F.row_number().over(Window.orderBy(order)))


def check_months_increase(revenue: DataFrame) -> DataFrame:
    """Rows of the monthly report whose month is not after the row before.

    ``revenue`` has one row per month, with the ``position`` it is shown at.
    """
    compared = revenue.select("month", F.lag("month").over(Window.orderBy("position")).alias("before"))
    return _count("months increase", compared, F.col("month") <= F.col("before"))


def check_first_growth(revenue: DataFrame) -> DataFrame:
    """The first month must not have a growth figure."""
    first = revenue.agg(F.min_by(F.struct("mom_growth_pct"), "month").alias("first"))
    return _count("first month has no growth", first, F.col("first.mom_growth_pct").isNotNull())
