"""Linking anonymous events to the user seen in the same tracking session."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from footfall.fixed_values import STATUS_AUTHENTICATED, STATUS_RESOLVED, STATUS_UNRESOLVED
from footfall.functions.dates import order_key


def resolve_identity(
    events: DataFrame,
    session: str = "session_id",
    user: str = "user_id",
    ts: str = "created_at",
    tie: str = "id",
    carry: Sequence[str] = ("event_type", "created_at", "traffic_source", "browser", "uri"),
) -> DataFrame:
    """Every event with ``resolved_user_id`` and ``resolution_status``.

    The resolved user is the first known one of the whole session, before or after the
    event.  It is aggregated per session (combined before the shuffle) and joined back,
    so a session holding a large share of all events is never sorted in one task: the
    adaptive skew join splits the event side.  With whole-number ids for users and ``tie``
    the aggregate is a hash aggregate; others need a sort of the known events.
    """
    owners = (
        events.where(F.col(user).isNotNull())
        .groupBy(F.col(session).alias("_session"))
        .agg(F.min_by(user, order_key(events, ts, tie)).alias("resolved_user_id"))
    )
    status = (
        F.when(F.col("raw_user_id").isNotNull(), STATUS_AUTHENTICATED)
        .when(F.col("resolved_user_id").isNotNull(), STATUS_RESOLVED)
        .otherwise(STATUS_UNRESOLVED)
    )
    return (
        events.select(F.col(session).alias("raw_session_id"), F.col(user).alias("raw_user_id"), *carry)
        # Events without a session id form one session of their own.  The null-safe key also
        # makes the join shuffle its right side by itself, without which adaptive execution
        # could not split a skewed left side.
        .join(owners, F.col("raw_session_id").eqNullSafe(F.col("_session")), "left")
        .select("raw_session_id", "resolved_user_id", "raw_user_id", *carry, status.alias("resolution_status"))
    )


def mixed_sessions(
    events: DataFrame, session: str = "session_id", user: str = "user_id", limit: int = 10
) -> DataFrame:
    """Sessions with both anonymous and authenticated events, most anonymous first."""
    return (
        events.groupBy(session)
        .agg(
            F.count_if(F.col(user).isNull()).alias("anonymous_events"),
            F.count_if(F.col(user).isNotNull()).alias("authenticated_events"),
            F.max(user).alias("authenticated_user_id"),
        )
        .where((F.col("anonymous_events") > 0) & (F.col("authenticated_events") > 0))
        .orderBy(F.desc("anonymous_events"), session)
        .limit(limit)
    )


def session_identity_audit(
    events: DataFrame, session: str = "session_id", user: str = "user_id", limit: int = 20
) -> DataFrame:
    """Distinct users and the known/unknown split of the sessions with most known events."""
    return (
        events.groupBy(session)
        .agg(
            F.count_distinct(user).alias("distinct_user_ids"),
            F.count_if(F.col(user).isNull()).alias("null_count"),
            F.count_if(F.col(user).isNotNull()).alias("not_null_count"),
        )
        .orderBy(F.desc("not_null_count"), F.desc("null_count"), session)
        .limit(limit)
    )
