from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from footfall.functions.money import exact_sum
from footfall.operators import retention, rfm
from footfall.plans.reports import retention_report


def orders_of(spark, rows):
    return spark.createDataFrame(rows, "order_id long, user_id long, status string, created_at timestamp")


@pytest.fixture(scope="module")
def orders(spark):
    return orders_of(
        spark,
        [
            (1, 1, "Cancelled", datetime(2024, 1, 5)),
            (2, 1, "Complete", datetime(2024, 2, 5)),
            (3, 2, "Complete", datetime(2024, 3, 1)),
            (4, 2, "Shipped", datetime(2024, 3, 31, 23, 59, 59)),
            (5, 2, "Complete", datetime(2024, 9, 2)),
            (6, 3, "Returned", datetime(2024, 5, 1)),
            (7, None, "Complete", datetime(2024, 5, 1)),
            (8, 4, "Complete", datetime(2023, 12, 31)),
            (9, 4, "Complete", datetime(2024, 1, 1)),
            (10, 4, "Complete", datetime(2024, 4, 1)),
        ],
    )


def test_cohorts(orders):
    found = {r["cohort_month"]: tuple(r)[1:] for r in retention.cohort_retention(orders).collect()}
    assert found == {
        date(2023, 12, 1): (1, 1, 0, 0, 0),
        date(2024, 1, 1): (0, 1, 0, 0, 0),  # joined with a cancelled order
        date(2024, 3, 1): (1, 0, 0, 0, 1),  # two orders in a month are one user
    }  # user 3 never completed an order: no May cohort


def test_cohorts_by_completed_orders_only(orders):
    kept = retention.cohort_retention(orders, cohort_statuses=("Complete", "Shipped")).collect()
    assert {r["cohort_month"]: r["m0"] for r in kept}[date(2024, 2, 1)] == 1


def test_rates(orders):
    rows = retention.retention_rates(retention.cohort_retention(orders)).collect()
    rate = {r["cohort_label"]: r["m1_rate"] for r in rows}
    assert rate == {"2023-12": 100.0, "2024-01": None, "2024-03": 0.0}


@pytest.fixture(scope="module")
def items(spark):
    rows = [(8, "1.005"), (9, "0.00"), (10, "30.00"), (10, "20.00"), (2, "0.00"), (5, "75.00"), (1, "999.00")]
    return spark.createDataFrame(
        [(o, Decimal(p)) for o, p in rows], "order_id long, sale_price decimal(10,3)"
    )


def test_revenue(orders, items):
    rows = [tuple(r) for r in retention.monthly_revenue(orders, items, date(2024, 10, 15)).collect()]
    assert rows == [
        (date(2023, 12, 1), 1.005, None, None),
        (date(2024, 1, 1), 0.0, 1.005, -100.0),
        (date(2024, 2, 1), 0.0, 0.0, None),  # zero base
        (date(2024, 4, 1), 50.0, 0.0, None),  # the row before is February
        (date(2024, 9, 1), 75.0, 50.0, 50.0),
    ]


def test_revenue_drops_current_month(orders, items):
    months = [r["month"] for r in retention.monthly_revenue(orders, items, date(2024, 4, 30)).collect()]
    assert months[-1] == date(2024, 2, 1)
    assert len(retention.monthly_revenue(orders, items).collect()) == 5  # today is later


def test_doubles_are_summed_exactly(spark, orders):
    prices = spark.createDataFrame([(8, 0.1)] * 3, "order_id long, sale_price double")
    assert retention.monthly_revenue(orders, prices, date(2024, 10, 1)).first()["revenue"] == 0.3


def test_kpis(orders, items):
    kpis = retention_report(orders, items, date(2024, 10, 1)).kpis.first()
    assert tuple(kpis) == (50.0, 0.0, 50.0, 3)


def test_rfm(orders, items):
    found = {r["user_id"]: tuple(r)[1:] for r in rfm.rfm_base(orders, items).collect()}
    assert found == {
        1: (210, 1, 0.0),
        2: (0, 1, 75.0),  # orders without items are left out
        4: (154, 3, 51.01),  # half a cent rounds up
    }


def test_quintiles(spark):
    base = spark.createDataFrame(
        [(u, u % 3, 1 if u < 5 else 2, float(-u)) for u in range(1, 8)],
        "user_id long, recency_days long, frequency long, monetary_value double",
    )
    rows = {r["user_id"]: r for r in rfm.rfm_scores(base).collect()}
    assert [rows[u]["f_score"] for u in range(1, 8)] == [1, 1, 2, 2, 3, 4, 5]
    assert [rows[u]["m_score"] for u in range(7, 0, -1)] == [1, 1, 2, 2, 3, 4, 5]
    # Longest ago first: users 2, 5 (two days), 1, 4, 7 (one), 3, 6 (none).
    assert [rows[u]["r_score"] for u in (2, 5, 1, 4, 7, 3, 6)] == [1, 1, 2, 2, 3, 4, 5]


def test_money_parts_do_not_overflow(spark):
    """A total far beyond LONG units, exact to the last digit, with refunds."""
    amounts = spark.range(2000).select(F.lit("8000000000.5").cast("decimal(17,6)").alias("a")).union(
        spark.range(3).select(F.lit("-0.000001").cast("decimal(17,6)"))
    )
    total = amounts.agg(exact_sum(amounts, "a").alias("t")).first()["t"]
    assert total == Decimal("16000000000999.999997")
    assert amounts.where("a > 99999999999").agg(exact_sum(amounts, "a").alias("t")).first()["t"] is None


def total(spark, values, kind):
    frame = spark.createDataFrame([(v,) for v in values], "a string").select(F.col("a").cast(kind).alias("a"))
    row = frame.agg(exact_sum(frame, "a").alias("mine"), F.sum("a").alias("sum")).first()
    return row["mine"], row["sum"]


@pytest.mark.parametrize("values, kind", [
    (["0.0000004"] * 1000, "double"), (["NaN", "1.5"], "double"), (["Infinity", "1"], "double"),
    (["Infinity", "-Infinity"], "double"), (["1e13", "2.25"], "double"), (["-1e300", "1"], "double"), ([None], "double"),
    ([None, "0.1"], "float"), (["0.000000001"] * 7 + ["123.5"], "decimal(38,9)"), (["0.123456789012"] * 5, "decimal(18,12)"),
    (["12345678901234567.8"] * 3, "decimal(18,1)"), (["7", "-2", None], "long"), ([str(2**62)], "long"),
])
def test_sums_are_those_of_sql(spark, values, kind):
    mine, plain = total(spark, values, kind)
    if plain is None or plain != plain:
        assert (mine is None) == (plain is None) and (mine != mine) == (plain != plain)
    else:
        assert float(mine) == pytest.approx(float(plain), rel=1e-12)
        if kind.startswith("decimal"):
            assert mine == plain


def test_tiny_prices_are_not_lost(spark):
    orders = spark.createDataFrame([(1, "Complete", date(2024, 1, 5))], "order_id long, status string, created_at date")
    items = spark.range(1000).select(F.lit(1).cast("long").alias("order_id"), F.lit(4e-7).alias("sale_price"))
    row = retention.monthly_revenue(orders, items, date(2024, 3, 1)).first()
    assert row["revenue"] == pytest.approx(4e-4)
