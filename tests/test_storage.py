"""Footers, bucketed tables, kept results, sketches and observed checks."""

import os
import time
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from footfall.operators import profiling, quality, retention
from footfall.plans import result_cache
from footfall.plans.queries import AS_OF, monthly_revenue_bucketed, order_ranges_from_footers, table_counts_from_footers
from footfall.session import materialize, new_scratch_path
from footfall.sources import bucketed, footers, star_schema as shop

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    df._jdf.queryExecution().executedPlan()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("query", [table_counts_from_footers, order_ranges_from_footers])
def test_footers_are_all_that_is_read(spark, query):
    scans = [line for line in plan_of(query(spark, FOLDER)).splitlines() if "Scan" in line]
    assert scans and all("PushedAggregation: [COUNT(*)" in s and "PushedGroupBy: []" in s for s in scans)
    # The caller's own session reads as before.
    assert "PushedAggregation: [COUNT" not in plan_of(spark.read.parquet(f"{FOLDER}/orders.parquet").agg(F.count(F.lit(1))))


def test_ranges_of_several_files(spark, tmp_path):
    path = f"{tmp_path}/numbers"
    spark.range(1000).select(F.col("id").alias("a"), (F.col("id") % 7 - 3).cast("int").alias("b"), F.lit("x").alias("c")).repartition(5).write.parquet(path)
    rows = {r["column"]: (r["rows"], r["smallest"], r["largest"]) for r in footers.footer_ranges(spark, path, ["a", "b"]).collect()}
    assert rows == {"a": (1000, "0", "999"), "b": (1000, "-3", "3")}
    with pytest.raises(ValueError, match="c"):
        footers.footer_ranges(spark, path, ["a", "c"])


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_bucketed_join_moves_nothing_below_the_months(spark, no_broadcast):
    plan = plan_of(monthly_revenue_bucketed(spark, FOLDER))
    join = plan[plan.index("Join") :]
    assert "Exchange" not in join and "Bucketed: true" in join
    assert "Exchange" in plan_of(retention.monthly_revenue(shop.orders(spark, FOLDER), shop.order_items(spark, FOLDER), AS_OF, shop.REVENUE_STATUSES)).split("Join", 1)[1]


def test_bucketed_table_holds_every_row(spark):
    rows = spark.range(500).select(F.when(F.col("id") > 3, F.col("id") % 50).alias("k"), "id")
    stored = bucketed.read_bucketed(spark, bucketed.write_bucketed(rows, "k", buckets=4))
    assert sorted(stored.collect(), key=lambda r: r["id"]) == sorted(rows.collect(), key=lambda r: r["id"])
    assert "Exchange" not in plan_of(stored.groupBy("k").count())


def test_results_are_used_again(spark, tmp_path):
    source, folder = f"{tmp_path}/source", f"{tmp_path}/kept"
    spark.range(100).withColumn("k", F.col("id") % 3).coalesce(1).write.parquet(source)

    def result():
        return result_cache.cached(spark.read.parquet(source).groupBy("k").agg(F.sum("id").alias("s")), folder=folder)

    def read(df):
        return {os.path.dirname(f.replace("file://", "")) for f in df.inputFiles()}

    first, second = result(), result()
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, second.collect())) == [(0, 1683), (1, 1617), (2, 1650)]
    # Both read the one stored result, and no source.
    assert read(first) == read(second) and not any(source in f for f in second.inputFiles())
    # Another plan over the same files is another result.
    other = result_cache.cached(spark.read.parquet(source).groupBy("k").agg(F.max("id").alias("s")), folder=folder)
    assert read(other) != read(first)
    # Too old.
    third = result_cache.cached(spark.read.parquet(source).groupBy("k").agg(F.sum("id").alias("s")), max_age=timedelta(0), folder=folder)
    assert read(third) != read(first) and sorted(map(tuple, third.collect())) == sorted(map(tuple, first.collect()))
    # A file that was changed, or one more.
    time.sleep(0.01)
    spark.range(100, 103).withColumn("k", F.lit(0).cast("long")).coalesce(1).write.mode("append").parquet(source)
    spark.catalog.refreshByPath(source)
    fourth = result()
    assert read(fourth) not in (read(first), read(third))
    assert dict(map(tuple, fourth.collect()))[0] == 1683 + 303


def test_sketches_of_days_merge(spark):
    events = spark.range(20_000).select(
        (F.col("id") % 4000).cast("string").alias("session_id"), F.when(F.col("id") % 2 == 0, F.col("id") % 3000).alias("user_id"),
        F.timestamp_seconds(F.col("id") * 60).alias("created_at"), F.when(F.col("id") % 5 == 0, "cart").otherwise("home").alias("event_type"),
    )
    daily = materialize(profiling.daily_sketches(events), "daily")
    days = daily.select("day").distinct().count()
    assert days == 14 and daily.count() == 2 * days
    exact = {r["event_type"]: r for r in profiling.event_type_stats(events).collect()}
    for r in profiling.merged_stats(daily).collect():
        e = exact[r["event_type"]]
        assert r["total_events"] == e["total_events"]
        for estimate, count in (("sessions_estimate", "sessions_with_this_event"), ("users_estimate", "unique_users")):
            assert abs(r[estimate] - e[count]) <= 4 * profiling.SKETCH_ERROR * e[count]
    nobody = profiling.merged_stats(profiling.daily_sketches(events.withColumn("user_id", F.lit(None).cast("long"))))
    assert {r["users_estimate"] for r in nobody.collect()} == {0}
    assert profiling.merged_stats(daily.limit(0)).count() == 0


def test_checks_come_with_the_pass(spark):
    rows = spark.createDataFrame(
        [(1, None, 1, 1), (1, 40.0, 1, 2), (1, 40.0, 0, 2), (1, 5.0, 1, 3), (2, None, 0, 1), (3, None, 1, 2)],
        "visitor_id int, mins_since_last_event double, is_new_session int, session_sequence int",
    )
    watched, found = quality.observed(rows, quality.visit_rules())
    path = new_scratch_path(spark, "observed")
    watched.write.parquet(path)
    report = {r["check"]: (r["violations"], r["passed"]) for r in quality.observed_report(spark, [found]).collect()}
    assert report == {"first event opens session 1": (2, False), "long gap opens a session": (1, False), "short gap stays in session": (1, False)}
    assert spark.read.parquet(path).count() == 6
