"""Sessions by inactivity gap."""

from __future__ import annotations

from datetime import timedelta

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from footfall.arrow import map_batches, run_starts
from footfall.fixed_values import SESSION_GAP
from footfall.functions.dates import in_micros, minutes_apart
from footfall.operators.skew import HOT_ROWS, find_hot_keys
from footfall.session import materialize

# Rows per user and partition that are broadcast; beyond that they are joined by shuffles.
BROADCAST_SEAMS = 100_000


def sessionize(
    events: DataFrame,
    user_key: str = "user_id",
    ts: str = "created_at",
    tie: str = "id",
    gap: timedelta = SESSION_GAP,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Events with ``mins_since_last_event``, ``is_new_session``, ``session_sequence``.

    Per user in time order, ties by ``tie``: a session starts with the first event and
    after every gap strictly longer than ``gap``.  Events without a key are left out.

    One shuffle, on the user.  Users with more than ``hot_rows`` events are range-partitioned
    by user, time and ``tie`` instead, so that no task holds all of them whatever their times
    are, and stitched together through one summary row per user and partition.
    """
    keyed = events.where(F.col(user_key).isNotNull())
    hot = find_hot_keys(keyed, user_key, hot_rows)
    if hot is None:
        return _number_sessions(keyed, user_key, ts, tie, gap)
    cold = keyed.join(hot.hinted, user_key, "left_anti").select(*events.columns)
    few = _number_sessions(cold, user_key, ts, tie, gap)
    many = _sessionize_in_ranges(
        keyed.join(hot.hinted, user_key, "left_semi").select(*events.columns), user_key, ts, tie, gap
    )
    return few.unionByName(many)


def _number_sessions(events: DataFrame, user_key: str, ts: str, tie: str, gap: timedelta) -> DataFrame:
    in_order = Window.partitionBy(user_key).orderBy(ts, tie)
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    previous = F.lag(ts).over(in_order)
    return (
        events.withColumn("mins_since_last_event", minutes_apart(F.col(ts), previous))
        .withColumn("is_new_session", _starts_session(F.col("mins_since_last_event"), gap))
        .withColumn("session_sequence", F.sum("is_new_session").over(so_far))
    )


def _starts_session(minutes: Column, gap: timedelta) -> Column:
    limit = in_micros(gap) / 60_000_000
    return F.when(minutes <= limit, 0).otherwise(1)


def _sessionize_in_ranges(events: DataFrame, user_key: str, ts: str, tie: str, gap: timedelta) -> DataFrame:
    """One shuffle: each task numbers the sorted events that it has, and what it has of a user is
    moved on by what earlier partitions have.

    What is broadcast has a row per hot user and partition that holds events of that user; hot
    users are few, and all but the first and the last of a partition lie in it whole.
    """
    limit = in_micros(gap) / 60_000_000
    names = events.columns
    new = ["mins_since_last_event", "is_new_session", "session_sequence", "_part", "_opens_part"]

    def number(batches):
        part, last, before, sessions = TaskContext.get().partitionId(), [], None, 0
        for batch in batches:
            opens = run_starts(batch, [user_key], last)
            times = batch.column(ts)
            known = times.is_valid().to_numpy(zero_copy_only=False)
            micros = times.cast(pa.timestamp("us", times.type.tz)).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
            earlier = np.concatenate([[0 if before is None else before], micros[:-1]])
            compared = known & np.concatenate([[before is not None], known[:-1]]) & ~opens
            minutes = np.where(compared, (micros - earlier) / 60_000_000, np.nan)
            flags = np.where(compared & (minutes <= limit), 0, 1)
            # Sessions are counted from the first event that the partition has of the user.
            running = np.cumsum(flags)
            run = np.cumsum(opens)
            first = np.flatnonzero(opens)
            base = np.concatenate([[-sessions], running[first] - 1])
            numbers = running - base[run]
            if len(flags):
                sessions, before = int(numbers[-1]), int(micros[-1]) if known[-1] else None
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns, pa.array(minutes, mask=~compared), pa.array(flags.astype(np.int32)), pa.array(numbers.astype(np.int64)),
                    pa.array(np.full(len(flags), part, np.int32)), pa.array(opens),
                ],
                names=[*names, *new],
            )

    kinds = [T.DoubleType(), T.IntegerType(), T.LongType(), T.IntegerType(), T.BooleanType()]
    schema = T.StructType([*events.schema, *[T.StructField(n, t) for n, t in zip(new, kinds)]])
    # Written out: the ranges must be the same when they are numbered and when they are stitched.
    placed = events.repartitionByRange(user_key, ts, tie).sortWithinPartitions(user_key, ts, tie)
    numbered = materialize(map_batches(placed, number, schema), "hot-users")

    # One row per hot user and partition: what the next partition has to know.
    by_time = Window.partitionBy(user_key).orderBy("_part")
    before = by_time.rowsBetween(Window.unboundedPreceding, -1)
    untimed = F.count(F.lit(1)) > F.count(ts)  # events without a time come first
    seams = (
        numbered.groupBy(user_key, "_part")
        .agg(
            F.when(~untimed, F.min(ts)).alias("_first"),
            F.max(ts).alias("_last"),
            F.max("session_sequence").alias("_sessions"),
        )
        .withColumn("_gap", minutes_apart(F.col("_first"), F.lag("_last").over(by_time)))
        .withColumn("_opens", _starts_session(F.col("_gap"), gap))
        .withColumn("_own", F.col("_sessions") - 1 + F.col("_opens"))
        .withColumn("_shift", F.coalesce(F.sum("_own").over(before), F.lit(0)) - 1 + F.col("_opens"))
        .select(user_key, "_part", "_gap", "_opens", "_shift")
    )
    seams = materialize(seams, "seams")
    if seams.count() <= BROADCAST_SEAMS:
        seams = F.broadcast(seams)

    # The first event of a partition has no predecessor inside it; its gap is the seam's.
    at_seam = F.col("_opens_part")
    stitched = {
        "mins_since_last_event": F.when(at_seam, F.col("_gap")).otherwise(F.col("mins_since_last_event")),
        "is_new_session": F.when(at_seam, F.col("_opens")).otherwise(F.col("is_new_session")),
        "session_sequence": F.col("session_sequence") + F.col("_shift"),
    }
    return (
        numbered.join(seams, [user_key, "_part"])
        .withColumns(stitched)
        .select(*events.columns, *stitched)
    )


def session_summary(sessionized: DataFrame, user_key: str = "user_id") -> DataFrame:
    """Per user: ``sessions`` (highest number), ``boundaries`` (flags set) and ``events``."""
    return sessionized.groupBy(user_key).agg(
        F.max("session_sequence").alias("sessions"),
        F.sum("is_new_session").alias("boundaries"),
        F.count(F.lit(1)).alias("events"),
    )
