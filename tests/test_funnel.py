from datetime import datetime, timedelta

import pytest

from footfall.operators import funnel
from footfall.plans.queries import funnel_of_visits
from footfall.plans.reports import funnel_report

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def events(spark):
    visits = {
        "only cancel": ["cancel"],
        "only home": ["home"],
        "department": ["department", "home"],
        "no product": ["cart", "home"],
        "product": ["product"],
        "bought twice": ["purchase", "cart", "purchase"],
        "bought out of order": ["purchase", "product"],
    }
    rows = [
        (session, START + timedelta(minutes=i), kind)
        for session, kinds in visits.items()
        for i, kind in enumerate(kinds)
    ]
    return spark.createDataFrame(rows, "session_id string, created_at timestamp, event_type string")


def test_deepest_stage(events):
    rows = {r["session_id"]: r for r in funnel.session_funnel(events).collect()}
    assert {s: r["abandonment_stage"] for s, r in rows.items()} == {
        "only cancel": "Bounced Immediately",
        "only home": "Abandoned at Department",
        "department": "Abandoned at Product",
        "no product": "Abandoned at Checkout",
        "product": "Abandoned at Cart",
        "bought twice": "Completed Purchase",
        "bought out of order": "Completed Purchase",
    }
    assert rows["bought twice"]["total_events"] == 3
    assert rows["bought twice"]["session_start"] == START
    assert rows["no product"]["reached_product"] == 0


def test_summaries(events):
    report = funnel_report(events)
    kpis = report.kpis.first()
    assert kpis["total_sessions"] == 7
    assert kpis["reached_cart_pct"] == pytest.approx(200 / 7)
    assert kpis["cart_to_purchase_pct"] == 100 and kpis["lost_cart_pct"] == 0
    assert [tuple(r) for r in report.steps.select("label", "count").collect()] == [
        ("Total Sessions", 7),
        ("Browsed Products", 3),
        ("Reached Cart", 2),
        ("Completed Purchase", 2),
    ]
    first = report.abandonment.first()
    assert tuple(first) == ("Completed Purchase", 2, 28.6)
    assert [r["sessions"] for r in report.traffic.collect()] == [3, 1, 2, 2, 2]


def test_funnel_after_sessions_needs_one_shuffle(spark):
    """Sessions are already placed by user; grouping by user and session stays there."""
    plan = funnel_of_visits(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_no_carts_does_not_divide_by_zero(events):
    kpis = funnel.funnel_kpis(funnel.session_funnel(events.where("session_id = 'only home'"))).first()
    assert kpis["cart_to_purchase_pct"] == 0 and kpis["lost_cart_pct"] == 100
