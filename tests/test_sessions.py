from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from footfall.operators import identity, sessions
from footfall.operators.skew import find_hot_keys
from footfall.session import scratch_scope
from footfall.streaming import sessions as streamed
from footfall.streaming.sessions import run_available, sessionize_stream

START = datetime(2024, 1, 1)
SCHEMA = "id long, user_id long, created_at timestamp"


def at(minutes):
    return START + timedelta(minutes=minutes)


@pytest.fixture(scope="module")
def few(spark):
    return spark.createDataFrame(
        [
            (1, 1, at(0)),
            (2, 1, at(30)),
            (3, 1, at(60) + timedelta(microseconds=1)),
            (4, 2, at(5)),
            (5, None, at(6)),
        ],
        SCHEMA,
    )


def numbered(df):
    return {
        r["id"]: (r["mins_since_last_event"], r["is_new_session"], r["session_sequence"]) for r in df.collect()
    }


def test_gap_is_strict_and_first_event_opens(few):
    found = numbered(sessions.sessionize(few))
    assert found[1] == (None, 1, 1)
    assert found[2] == (30.0, 0, 1)
    assert found[3][0] > 30 and found[3][1:] == (1, 2)
    assert found[4] == (None, 1, 1)
    assert 5 not in found


def test_summary(few):
    rows = sessions.session_summary(sessions.sessionize(few)).orderBy("user_id").collect()
    assert [tuple(r) for r in rows] == [(1, 2, 2, 3), (2, 1, 1, 1)]


@pytest.fixture(scope="module")
def skewed(spark):
    """One user with a third of all events, equal times, and events without a time."""
    hashed = F.abs(F.xxhash64("id"))
    return spark.range(6000).select(
        "id",
        F.when(F.col("id") < 2000, 0).otherwise(hashed % 200 + 1).cast("long").alias("user_id"),
        F.when(
            F.col("id") % 500 != 7, F.timestamp_seconds(F.lit(1_700_000_000) + hashed % 1_500_000)
        ).alias("created_at"),
    )


@pytest.mark.parametrize("hot_rows", [1000, 500])
def test_ranges_do_not_show(skewed, hot_rows):
    whole = numbered(sessions.sessionize(skewed))
    assert numbered(sessions.sessionize(skewed, hot_rows=hot_rows)) == whole
    assert len(whole) == 6000


def test_equal_and_missing_times_are_split(spark, skewed):
    """A user with 2,000 events at one moment, 600 without a time and some others."""
    same = spark.range(10_000, 13_000).select(
        "id",
        F.lit(0).cast("long").alias("user_id"),
        F.when(F.col("id") < 12_000, F.timestamp_seconds(F.lit(1_700_000_000)))
        .when(F.col("id") >= 12_600, F.timestamp_seconds(F.lit(1_690_000_000) + F.col("id") * 700))
        .alias("created_at"),
    )
    both = skewed.unionByName(same)
    whole = numbered(sessions.sessionize(both))
    assert numbered(sessions.sessionize(both, hot_rows=500)) == whole
    assert len(whole) == 9000


def test_every_user_sliced(skewed):
    assert numbered(sessions.sessionize(skewed, hot_rows=1)) == numbered(sessions.sessionize(skewed))


def test_identity_needs_no_sort(mixed):
    plan = identity.resolve_identity(mixed, carry=("id",))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_hot_keys(skewed):
    hot = find_hot_keys(skewed, "user_id", 1000)
    assert hot.count == 1 and [r["user_id"] for r in hot.frame.collect()] == [0]
    assert find_hot_keys(skewed, "user_id", 10_000) is None


def test_hot_user_is_spread(spark, skewed):
    """No task may hold the whole hot user: it is numbered where ranges of its events lie."""
    plan = sessions.sessionize(skewed, hot_rows=1000)._jdf.queryExecution().optimizedPlan().toString()
    # The only window is over the users that are not hot, and what was numbered is only read.
    assert sum("Window [" in line and "lag(created_at" in line for line in plan.splitlines()) == 1
    hot = skewed.where("user_id = 0")
    # So few rows would be merged into one partition.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    with scratch_scope(spark) as written:
        sessions._sessionize_in_ranges(hot, "user_id", "created_at", "id", timedelta(minutes=30)).count()
        path = next(p for p in written if "hot-users" in p)
        parts = spark.read.parquet(path).groupBy("_part").count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) > 1 and max(r["count"] for r in parts) < hot.count()
    assert "LeftAnti" in plan


def arrive(spark, timed, folder):
    """Two arrivals, the second one later."""
    early = F.unix_seconds("created_at") < 1_700_750_000
    timed.where(early).coalesce(1).write.mode("append").parquet(folder)
    timed.where(~early).coalesce(1).write.mode("append").parquet(folder)
    return lambda own: own.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_streamed_sessions_equal_batch(spark, skewed, tmp_path):
    """Two arrivals; nothing is lost, and what stays open without closing is what should."""
    timed = skewed.where(F.col("created_at").isNotNull())
    lateness = timedelta(days=2)
    arriving = arrive(spark, timed, str(tmp_path / "arrivals"))
    batch = sessionize_stream(timed)
    run = run_available(spark, arriving, "test-stream", lateness=lateness, state_partitions=3)
    assert run.late_rows == 0
    assert sorted(map(tuple, run.sessions.collect())) == sorted(map(tuple, batch.collect()))

    going_on = run_available(spark, arriving, "test-open", lateness=lateness, close=False)
    closed = timed.agg(F.max("created_at")).first()[0] - lateness - timedelta(minutes=30)
    expected = batch.where(F.col("session_end") <= F.lit(closed)).collect()
    assert sorted(map(tuple, going_on.sessions.collect())) == sorted(map(tuple, expected))
    assert 0 < len(expected) < batch.count()

    whole = (
        sessions.sessionize(timed)
        .groupBy("user_id", "session_sequence")
        .agg(F.min("created_at"), F.max("created_at"), F.count("*"))
        .drop("session_sequence")
    )
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, batch.collect()))


@pytest.mark.parametrize("minutes", [61, 180, 60 * 24 * 7])
def test_slices_do_not_show(spark, skewed, minutes):
    """Parts of sessions end at borders; stitched they are the sessions."""
    timed = skewed.where(F.col("created_at").isNotNull())
    slices = timedelta(minutes=minutes)
    parts = sessionize_stream(timed, slices=slices)
    whole = sessionize_stream(timed)
    assert sorted(map(tuple, streamed.stitched(parts, slices).collect())) == sorted(map(tuple, whole.collect()))
    if minutes < 200:
        assert parts.count() > whole.count()
        # The busy user, who has most events, is spread over many keys of the state.
        busy = parts.where("user_id = 0").groupBy("_slice").agg(F.sum("events").alias("n")).collect()
        assert len(busy) > 20 and max(r["n"] for r in busy) < timed.where("user_id = 0").count() / 5


def test_parts_at_borders(spark):
    # Gaps of exactly 30 minutes and a little more, across the border at 4 hours and in a slice.
    moments = [10, 40, 200, 225, 255, 285, 315, 316, 347, 430, 479, 480, 500, 719, 749, 779]
    events = spark.createDataFrame([(i, u, at(m)) for i, m in enumerate(moments) for u in (1, 2)], SCHEMA)
    slices = timedelta(hours=4)
    found = streamed.stitched(sessionize_stream(events, slices=slices), slices).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, sessionize_stream(events).collect()))
    with pytest.raises(ValueError):
        streamed.stitched(sessionize_stream(events, slices=slices), timedelta(hours=1))
    empty = sessionize_stream(events.limit(0), slices=slices)
    assert streamed.stitched(empty, slices).count() == 0


def test_streamed_slices_equal_batch(spark, skewed, tmp_path):
    timed = skewed.where(F.col("created_at").isNotNull())
    arriving = arrive(spark, timed, str(tmp_path / "arrivals"))
    run = run_available(spark, arriving, "test-slices", lateness=timedelta(days=2), state_partitions=3, slices=timedelta(hours=3))
    assert run.late_rows == 0
    assert sorted(map(tuple, run.sessions.collect())) == sorted(map(tuple, sessionize_stream(timed).collect()))
    with pytest.raises(ValueError):
        run_available(spark, arriving, "test-open-slices", close=False, slices=timedelta(hours=3))


def test_late_rows_are_counted(spark, tmp_path):
    # Lateness is judged by the watermark of the batch before the last.
    rows = [[(1, 1, at(0)), (2, 1, at(3000))], [(3, 1, at(3001))], [(4, 2, at(1)), (5, 1, at(3002))]]
    folder = str(tmp_path / "late")
    for arrival in rows:
        spark.createDataFrame(arrival, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    schema = spark.createDataFrame([], SCHEMA).schema

    def arriving(own):
        return own.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)

    run = run_available(spark, arriving, "late", lateness=timedelta(minutes=5))
    assert run.late_rows == 1
    assert run.sessions.agg(F.sum("events")).first()[0] == 4


def test_late_rows_of_more_batches_than_progress_is_kept(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streamed, "KEPT_PROGRESS", 5)
    monkeypatch.setattr(streamed, "POLL_SECONDS", 0.02)
    folder = str(tmp_path / "long")
    # The two late rows come early, and their progress is gone at the end.
    for i, minute in enumerate([0, 3000, 3001, 1, 2, 3002, 3003, 3004, 3005, 3006, 3007, 3008]):
        spark.createDataFrame([(i, 1, at(minute))], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    schema = spark.createDataFrame([], SCHEMA).schema

    def arriving(own):
        return own.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)

    run = run_available(spark, arriving, "long", lateness=timedelta(minutes=5))
    assert run.late_rows == 2
    assert run.sessions.agg(F.sum("events")).first()[0] == 10


def test_late_rows_of_unread_progress_fail(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streamed, "KEPT_PROGRESS", 4)
    monkeypatch.setattr(streamed, "POLL_SECONDS", 600)
    folder = str(tmp_path / "many")
    for i in range(6):
        spark.createDataFrame([(i, 1, at(i))], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    schema = spark.createDataFrame([], SCHEMA).schema

    def arriving(own):
        return own.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)

    with pytest.raises(RuntimeError, match="late rows"):
        run_available(spark, arriving, "many")


EVENTS = StructType(
    [
        StructField("id", LongType()),
        StructField("session_id", StringType()),
        StructField("user_id", LongType()),
        StructField("created_at", TimestampType()),
        StructField("event_type", StringType()),
    ]
)


@pytest.fixture(scope="module")
def mixed(spark):
    return spark.createDataFrame(
        [
            (1, "a", None, at(0), "home"),
            (2, "a", 7, at(1), "cart"),
            (3, "a", None, at(2), "product"),
            (4, "b", None, at(0), "home"),
            (5, "b", None, at(1), "home"),
            (6, "c", 9, at(0), "cart"),
            (7, None, None, at(0), "home"),
            (8, None, 3, at(1), "cart"),
            # Two users at the same moment: the smaller event id is first.
            (11, "d", 5, at(0), "cart"),
            (10, "d", 6, at(0), "cart"),
            (12, "d", None, at(9), "home"),
        ],
        EVENTS,
    )


def test_identity(mixed):
    rows = identity.resolve_identity(mixed, carry=("id",)).collect()
    found = {r["id"]: (r["resolved_user_id"], r["resolution_status"]) for r in rows}
    assert found == {
        1: (7, "anonymous resolved"),
        2: (7, "authenticated"),
        3: (7, "anonymous resolved"),
        4: (None, "anonymous unresolved"),
        5: (None, "anonymous unresolved"),
        6: (9, "authenticated"),
        7: (3, "anonymous resolved"),
        8: (3, "authenticated"),
        10: (6, "authenticated"),
        11: (6, "authenticated"),
        12: (6, "anonymous resolved"),
    }


def test_mixed_sessions_and_audit(mixed):
    rows = [tuple(r) for r in identity.mixed_sessions(mixed).collect()]
    assert rows == [("a", 2, 1, 7), (None, 1, 1, 3), ("d", 1, 2, 6)]
    audit = [tuple(r) for r in identity.session_identity_audit(mixed, limit=2).collect()]
    assert audit == [("d", 2, 1, 2), ("a", 1, 2, 1)]


def test_hot_session_is_split_by_the_join(spark):
    """Half of the events belong to one session."""
    events = spark.range(0, 40_000, 1, 8).select(
        "id",
        F.when(F.col("id") < 20_000, "hot").otherwise(F.md5(F.col("id").cast("string"))).alias("session_id"),
        F.when(F.col("id") == 15_000, 7).cast("long").alias("user_id"),
        F.timestamp_seconds("id").alias("created_at"),
    )
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {key: spark.conf.get(key, None) for key in small}
    try:
        for key, value in small.items():
            spark.conf.set(key, value)
        resolved = identity.resolve_identity(events, carry=("id",))
        rows = resolved.where("resolution_status = 'anonymous resolved'").count()
        resolved.collect()
        plan = resolved._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert rows == 19_999
    assert "skew=true" in plan
