import os
from datetime import date, datetime

import pytest

from footfall.operators import funnel, profiling, quality
from footfall.session import is_one_machine, scratch_scope, build_session, materialize, scratch_folder
from footfall.sources.tables import normalise, preview, read_files, read_table


@pytest.fixture(scope="module")
def events(spark):
    at = datetime(2024, 1, 1)
    return spark.createDataFrame(
        [(1, "a", "home", None, at), (2, "a", "cart", 5, at), (3, "b", "cart", 5, None), (4, "c", None, 6, at)],
        "id long, session_id string, event_type string, user_id long, created_at timestamp",
    )


def test_counts(events):
    assert [tuple(r) for r in profiling.table_counts({"x": events, "y": events.limit(1)}).collect()] == [
        ("x", 4), ("y", 1),
    ]
    assert [tuple(r) for r in profiling.value_counts(events, "event_type").collect()] == [
        ("cart", 2), (None, 1), ("home", 1),
    ]


def test_nulls_and_range(events):
    assert tuple(profiling.null_rates(events, ["user_id", "event_type"]).first()) == (25.0, 25.0)
    assert tuple(profiling.time_range(events, "created_at").first()) == (datetime(2024, 1, 1),) * 2
    empty = events.where("id < 0")
    assert tuple(profiling.null_rates(empty, ["user_id"]).first()) == (None,)


def test_types_and_users(events):
    stats = {r["event_type"]: tuple(r)[1:] for r in profiling.event_type_stats(events).collect()}
    assert stats == {"cart": (2, 2, 1), "home": (1, 1, 0), None: (1, 1, 1)}
    near = profiling.event_type_stats(events, approximate=True).first()
    assert near["sessions_with_this_event"] == 2
    shares = {r["user_type"]: r["pct_of_total"] for r in profiling.user_type_share(events).collect()}
    assert shares == {"anonymous": 25.0, "authenticated": 75.0}
    assert [r["user_id"] for r in profiling.top_users(events, 1).collect()] == [5]


def row(df):
    r = df.first()
    return (r["violations"], r["passed"])


def test_checks_find_bad_rows(spark):
    sessions = spark.createDataFrame([("a", 0), ("a", 1)], "session_id string, reached_home int")
    assert row(quality.check_unique("x", sessions, "session_id")) == (1, False)
    funnel = [tuple(r) for r in quality.check_funnel(sessions, stages=["home"]).collect()]
    assert funnel == [("session is unique", 1, False), ("session reaches a stage", 1, False)]
    bad = spark.createDataFrame(
        [(1, 1, datetime(2024, 1, 1), None, 0, 1), (2, 1, datetime(2024, 1, 2), 1440.0, 0, 1),
         (3, 1, datetime(2024, 1, 2, 0, 5), 5.0, 1, 2)],
        "id long, user_id long, created_at timestamp, mins_since_last_event double, "
        "is_new_session int, session_sequence long",
    )
    found = {r["check"]: (r["violations"], r["passed"]) for r in quality.check_visits(quality.visits_by_user(bad)).collect()}
    assert found["first event opens session 1"] == (1, False)
    assert found["long gap opens a session"] == found["short gap stays in session"] == (1, False)
    assert found["sessions equal boundaries"][1] in (True, False)
    cohorts = spark.createDataFrame([(1, 2), (3, 3)], "m0 long, m1 long")
    assert row(quality.check_cohort_decay(cohorts)) == (1, False)
    months = spark.createDataFrame(
        [(1, date(2024, 2, 1), 5.0), (2, date(2024, 1, 1), 1.0)], "position int, month date, mom_growth_pct double"
    )
    assert row(quality.check_months_increase(months)) == (1, False)
    assert row(quality.check_first_growth(months)) == (1, False)


def test_readers(spark, tmp_path):
    folder = str(tmp_path / "mixed")
    spark.createDataFrame([(2, "b"), (1, "a")], "Order_ID long, STATUS string").write.parquet(folder)
    found = read_files(spark, folder, {"order_id": "id"})
    assert found.columns == ["id", "status"]
    assert preview(found, 1, order_by="id").first()["status"] == "a"
    spark.read.parquet(folder).createOrReplaceTempView("mixed_case")
    assert read_table(spark, "mixed_case").columns == ["order_id", "status"]
    assert preview(normalise(spark.range(10))).count() == 5


def test_only_needed_columns_and_filters_reach_the_scan(spark):
    from footfall.plans.queries import AS_OF, session_funnel
    from footfall.operators.retention import monthly_revenue
    from footfall.sources import star_schema as shop

    folder = "/root/testdata/sf0.001"
    revenue = monthly_revenue(
        shop.orders(spark, folder), shop.order_items(spark, folder), AS_OF, shop.REVENUE_STATUSES
    )
    plan = revenue._jdf.queryExecution().executedPlan().toString()
    assert "In(o_orderstatus, [F,O])" in plan and "LessThan(o_orderdate" in plan
    assert "l_shipdate" not in plan and "o_totalprice" not in plan
    assert "props" not in session_funnel(spark, folder)._jdf.queryExecution().executedPlan().toString()


def test_scratch_folder_is_the_configured_one(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    if before:
        assert scratch_folder(spark) == before.rstrip("/")
    table = materialize(spark.range(3), "numbers")
    assert table.count() == 3
    assert table.inputFiles()[0].removeprefix("file://").startswith(
        scratch_folder(spark).removeprefix("file:").removeprefix("//")
    )
    assert build_session() is not None


def test_a_scope_leaves_nothing(spark):
    folder = scratch_folder(spark).removeprefix("file:")
    with scratch_scope(spark) as written:
        first = materialize(spark.range(3), "kept-a-while")
        with scratch_scope(spark) as inner:
            assert materialize(first.where("id > 0"), "inner").count() == 2
        assert first.count() == 3 and len(written) == 2 and len(inner) == 1
    for path in written:
        assert path.startswith(scratch_folder(spark)) and not os.path.exists(path.removeprefix("file:"))
    assert os.path.isdir(folder)


def test_only_one_machine_has_a_folder_of_its_own():
    assert is_one_machine("local") and is_one_machine("local[4]") and is_one_machine("local[*]")
    assert not any(map(is_one_machine, ("local-cluster[3,2,1024]", "yarn", "spark://host:7077", "k8s://x")))
