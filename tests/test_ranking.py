from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from footfall.operators.ranking import Ranking, exact_quantiles, rank_columns, with_ntiles


@pytest.fixture(scope="module")
def rows(spark):
    """Four fifths share one value; some are NULL."""
    picked = F.abs(F.xxhash64("id"))
    return (
        spark.range(0, 5003, 1, 7)
        .select(
            "id",
            F.when(picked % 10 < 8, 1).when(picked % 10 == 8, picked % 1000).alias("common"),
            (F.rand(3) * 1e6).alias("spread"),
        )
        .cache()
    )


def test_ranks_are_a_permutation(rows):
    both = rows.withColumn("again", F.col("spread") * 2)
    for columns in ([Ranking("common"), Ranking("id", True)], [Ranking("spread", True), Ranking("again")]):
        check_permutations(rank_columns(both, columns, "id"))
    with pytest.raises(ValueError):
        rank_columns(rows, [Ranking("common"), Ranking("spread")], "id")


def check_permutations(ranked):
    for which in (0, 1):
        found = ranked.where(F.col("which") == which).orderBy("rank").collect()
        assert [r["rank"] for r in found] == list(range(5003))
        assert {r["total"] for r in found} == {5003}
        key = [(r["nulls"], r["value"] if r["value"] is not None else 0.0, r["tie"]) for r in found]
        assert key == sorted(key)


@pytest.mark.parametrize("buckets", [1, 2, 5, 7])
def test_ntile_equals_window(rows, buckets):
    scores = {
        "a": Ranking("common"),
        "b": Ranking("common", descending=True),
        "c": Ranking("spread", descending=True),
    }
    one_task = {
        "a": Window.orderBy(F.asc_nulls_first("common"), "id"),
        "b": Window.orderBy(F.desc_nulls_last("common"), "id"),
        "c": Window.orderBy(F.desc("spread"), "id"),
    }
    found = with_ntiles(rows, scores, buckets, "id")
    found = found.withColumns({f"{n}_window": F.ntile(buckets).over(w) for n, w in one_task.items()})
    wrong = found.where(" OR ".join(f"{n} <> {n}_window" for n in one_task))
    assert wrong.count() == 0 and found.count() == 5003


def test_fewer_rows_than_buckets(rows):
    few = with_ntiles(rows.limit(3), {"s": Ranking("spread")}, 5, "id")
    assert sorted(r["s"] for r in few.collect()) == [1, 2, 3]


def test_quantiles(rows):
    levels = {"q1": 0.25, "q2": 0.5, "q3": 0.75, "low": 0.0, "high": 1.0}
    found = {r["column"]: r for r in exact_quantiles(rows, ["common", "spread"], levels, "id").collect()}
    data = rows.toPandas()
    for column in ("common", "spread"):
        values = data[column].dropna().to_numpy(dtype=float)
        for name, q in levels.items():
            assert found[column][name] == pytest.approx(np.percentile(values, q * 100), rel=1e-12)


def test_no_single_partition_and_no_shuffle_of_rows(rows):
    plan = with_ntiles(rows, {"s": Ranking("spread")}, 5, "id")._jdf.queryExecution().executedPlan().toString()
    outer = plan.split("Subquery")[0]
    assert "Exchange" not in outer


def test_values_are_compared_in_their_own_type(spark):
    """LONG beyond 2^53 and wide DECIMAL keep all digits; NULL, NaN and the extremes have their places."""
    big = [2**53 + 1, 2**53, 2**63 - 1, -(2**63), None, 2**62 + 1, 2**62]
    rows = [
        (i, v, None if v is None else Decimal(v) + Decimal("0.0000000001") * i, [1.5, float("nan"), None, -1.0, float("inf"), 0.0, -0.5][i])
        for i, v in enumerate(big)
    ]
    df = spark.createDataFrame(rows, "id long, whole long, exact decimal(38,10), real double").withColumn(
        "day", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 3).cast("int"))
    )
    scores, one_task = {}, {}
    for column in ("whole", "exact", "real", "day"):
        for descending in (False, True):
            name = f"{column}_{descending}"
            scores[name] = Ranking(column, descending)
            one_task[name] = F.desc_nulls_last(column) if descending else F.asc_nulls_first(column)
    for buckets in (2, 3, 7):
        found = with_ntiles(df, scores, buckets, "id")
        found = found.withColumns({f"{n}_window": F.ntile(buckets).over(Window.orderBy(o, "id")) for n, o in one_task.items()})
        for r in found.collect():
            assert {n: r[n] for n in scores} == {n: r[f"{n}_window"] for n in scores}
    with pytest.raises(ValueError):
        with_ntiles(df.withColumn("text", F.lit("x")), {"s": Ranking("text")}, 2, "id")
