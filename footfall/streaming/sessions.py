"""Sessions by inactivity gap over a stream of events."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from footfall.fixed_values import SESSION_GAP
from footfall.functions.dates import in_micros
from footfall.session import materialize, new_scratch_path

# Later than any event; passing it closes every session.
CLOSING_TIME = datetime(9999, 1, 1)
# Progress is read every few seconds; Spark keeps that of so many batches for it.
KEPT_PROGRESS = 1_000
POLL_SECONDS = 5


def _interval(span: timedelta) -> str:
    return f"{in_micros(span)} microseconds"


def sessionize_stream(
    events: DataFrame,
    user_key: str = "user_id",
    ts: str = "created_at",
    gap: timedelta = SESSION_GAP,
    lateness: timedelta = timedelta(hours=1),
    slices: timedelta | None = None,
) -> DataFrame:
    """``user, session_start, session_end, events``: one row per session.

    With ``slices`` sessions end at the borders of time slices, and ``_slice`` says where each
    slice begins: state is kept by user and slice, so no task has more of a busy user than a
    slice.  ``stitched`` puts such parts together.

    The sessions are those of the batch ``sessionize``: a gap of exactly ``gap`` stays
    inside.  Works on a batch DataFrame as well.  On a stream in append mode a session is
    emitted once the watermark, ``lateness`` behind the newest event, passes its end; state
    is held only for open sessions.
    """
    keyed = events.where(F.col(user_key).isNotNull() & F.col(ts).isNotNull())
    if events.isStreaming:
        keyed = keyed.withWatermark(ts, _interval(lateness))
    part = []
    if slices is not None:
        keyed, part = keyed.withColumn("_slice", _slice_of(F.col(ts), slices)), ["_slice"]
    return (
        keyed.groupBy(user_key, *part, F.session_window(ts, _interval(gap)).alias("_session"))
        .agg(F.count(F.lit(1)).alias("events"))
        .select(
            user_key,
            *part,
            F.col("_session.start").alias("session_start"),
            # The window runs on for one gap after the last event.
            F.timestamp_add("MICROSECOND", F.lit(-in_micros(gap)), F.col("_session.end")).alias("session_end"),
            "events",
        )
    )


def _slice_of(moment: Column, slices: timedelta) -> Column:
    micros = F.unix_micros(moment.cast("timestamp"))
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(in_micros(slices))))


def stitched(parts: DataFrame, slices: timedelta, user_key: str = "user_id", gap: timedelta = SESSION_GAP) -> DataFrame:
    """Whole sessions of the parts that ``sessionize_stream`` gives with ``slices``.

    Only parts that lie within a gap of a border can go on beyond it, at most two of a user and
    slice if slices are longer than two gaps; all others are sessions already.  So a busy user
    has as many rows to sort as there are slices, not sessions.  Parts are written first: Spark
    would push the search for those near a border below the session windows.
    """
    return _stitched(materialize(parts, "session-parts"), slices, user_key, gap)


def _stitched(parts: DataFrame, slices: timedelta, user_key: str, gap: timedelta) -> DataFrame:
    if slices <= 2 * gap:
        raise ValueError("slices have to be longer than two gaps")
    reach, size = in_micros(gap), in_micros(slices)

    def at(column: str) -> Column:
        return F.unix_micros(F.col(column).cast("timestamp"))

    near = (at("session_start") - at("_slice") <= reach) | (at("_slice") + size - at("session_end") <= reach)
    by_time = Window.partitionBy(user_key).orderBy("session_start")
    apart = at("session_start") - F.lag(at("session_end")).over(by_time)
    joined = (
        parts.where(near)
        .withColumn("_opens", F.when(apart <= reach, 0).otherwise(1))
        .withColumn("_number", F.sum("_opens").over(by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .groupBy(user_key, "_number")
        .agg(F.min("session_start").alias("session_start"), F.max("session_end").alias("session_end"), F.sum("events").alias("events"))
    )
    columns = [user_key, "session_start", "session_end", "events"]
    return parts.where(~near).select(columns).unionByName(joined.select(columns))


@dataclass(frozen=True)
class StreamedSessions:
    """Closed sessions, and how many rows came too late to be counted in any."""

    sessions: DataFrame
    late_rows: int


def _late_rows(query: StreamingQuery) -> int:
    """Waits for the query to end and adds up the late rows of all its batches on the way.

    Progress that is gone before it was read would go uncounted, which is an error: more than
    KEPT_PROGRESS batches in POLL_SECONDS.
    """
    late, last, ended = 0, None, False
    while not ended:
        ended = query.awaitTermination(POLL_SECONDS)
        progress = query.recentProgress
        marks = [(p["batchId"], p["timestamp"]) for p in progress]
        known = marks.index(last) + 1 if last in marks else 0
        # Spark keeps one less than it is told.
        if not known and len(marks) >= KEPT_PROGRESS - 1:
            raise RuntimeError(f"late rows cannot be counted over {KEPT_PROGRESS - 1} batches or more in {POLL_SECONDS} seconds")
        late += sum(s["numRowsDroppedByWatermark"] for p in progress[known:] for s in p["stateOperators"])
        last = marks[-1] if marks else None
    return late


def run_available(
    spark: SparkSession,
    read_events: Callable[[SparkSession], DataFrame],
    label: str,
    user_key: str = "user_id",
    ts: str = "created_at",
    gap: timedelta = SESSION_GAP,
    lateness: timedelta = timedelta(hours=1),
    close: bool = True,
    state_partitions: int | None = None,
    slices: timedelta | None = None,
) -> StreamedSessions:
    """Process what the sources hold now, append sessions to a table, and read that back.

    ``read_events`` makes the stream in the session it is given: one of its own, so that the
    settings below are not the caller's.  State is kept in ``state_partitions`` parts, by
    default as many as shuffles have; the number holds for the life of a checkpoint.  Tasks
    merge the sessions of their own events before the shuffle, so a busy user sends sessions
    to the one task that keeps them, not events.  With ``slices`` (of time, longer than two
    gaps) that task has a slice of the user only, and the closed parts are stitched when they
    are read back; as a part may go on in a slice that is still open, this needs ``close``.

    With ``close`` an event at the end of time follows the last one, in a batch of its own:
    the watermark passes every open session, and only the closing event's stays open.  Leave
    it out if the stream is to go on from its checkpoint.
    """
    if slices is not None and not close:
        raise ValueError("parts of sessions can only be stitched once the stream is closed")
    own = spark.newSession()
    settings = {
        "spark.sql.session.timeZone": spark.conf.get("spark.sql.session.timeZone"),
        "spark.sql.shuffle.partitions": str(state_partitions or spark.conf.get("spark.sql.shuffle.partitions")),
        "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
        "spark.sql.streaming.numRecentProgressUpdates": str(KEPT_PROGRESS),
    }
    for key, value in settings.items():
        own.conf.set(key, value)
    path = new_scratch_path(spark, label)
    events = read_events(own).select(user_key, ts)
    schema = T.StructType([events.schema[user_key], T.StructField(ts, T.TimestampType())])
    closing = own.range(1).select(
        F.lit(0).cast(schema[user_key].dataType).alias(user_key), F.lit(CLOSING_TIME).alias(ts)
    )
    closing.limit(0).write.parquet(f"{path}/closing")
    both = events.unionByName(own.readStream.schema(schema).parquet(f"{path}/closing"))
    found = sessionize_stream(both, user_key, ts, gap, lateness, slices)

    def process() -> int:
        query = (
            found.writeStream.format("parquet")
            .outputMode("append")
            .option("path", f"{path}/rows")
            .option("checkpointLocation", f"{path}/progress")
            .trigger(availableNow=True)
            .start()
        )
        return _late_rows(query)

    late = process()
    if close:
        closing.write.mode("append").parquet(f"{path}/closing")
        late += process()
    closed = spark.read.schema(found.schema).parquet(f"{path}/rows")
    return StreamedSessions(closed if slices is None else _stitched(closed, slices, user_key, gap), late)
