import math
from datetime import date, datetime
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from footfall.functions import stats
from footfall.functions.stats import normal_cdf
from footfall.operators import experiment
from footfall.plans.reports import experiment_report

KEYS = ("name",)


@pytest.fixture(scope="module")
def arms(spark):
    return experiment.counts_table(
        spark,
        [
            ("gain", 10000, 500, 10000, 650),
            ("small", 100, 5, 100, 6),
            ("real", 51724, 27445, 48276, 25511),
            ("loss", 10000, 650, 10000, 500),
            ("skewed", 3000, 300, 7000, 700),
            ("even", 5000, 250, 5000, 250),
            ("nobody", 0, 0, 10, 1),
            ("none bought", 500, 0, 500, 0),
            ("empty", 0, 0, 0, 0),
        ],
        KEYS,
    ).cache()


def by_name(df):
    return {r["name"]: r for r in df.collect()}


def test_srm(arms):
    found = by_name(experiment.srm_check(arms, KEYS))
    assert found["even"]["chi2_stat"] == 0 and found["even"]["p_value"] == 1
    assert found["even"]["verdict"] == "PASS" and found["even"]["srm_detected"] is False
    assert found["skewed"]["chi2_stat"] == 1600 and found["skewed"]["p_value"] == 0
    assert found["skewed"]["verdict"].startswith("ABORT") and found["skewed"]["srm_detected"] is True
    assert found["real"]["chi2_stat"] == pytest.approx(118.887, abs=1e-3)
    assert found["real"]["srm_detected"] is True
    assert found["empty"]["p_value"] is None and found["empty"]["srm_detected"] is False


def test_srm_against_the_designed_split(arms):
    found = by_name(experiment.srm_check(arms, KEYS, expected_split=(0.3, 0.7)))
    assert found["skewed"]["verdict"] == "PASS"


def test_ztest(arms):
    found = by_name(experiment.proportion_ztest(arms, KEYS))
    gain = found["gain"]
    assert (gain["absolute_lift"], gain["relative_lift_pct"]) == (0.015, 30.0)
    assert (gain["z_stat"], gain["p_value"]) == (4.5562, 0.000005)
    assert (gain["ci_lower"], gain["ci_upper"], gain["significant"]) == (0.008551, 0.021449, True)
    small = found["small"]
    assert (small["z_stat"], small["p_value"], small["significant"]) == (0.3102, 0.756438, False)
    assert (small["ci_lower"], small["ci_upper"]) == (-0.053177, 0.073177)
    real = found["real"]
    assert (real["absolute_lift"], real["relative_lift_pct"]) == (-0.002164, -0.41)
    assert (real["z_stat"], real["p_value"]) == (-0.6851, 0.493253)
    assert (real["ci_lower"], real["ci_upper"]) == (-0.008355, 0.004027)
    loss = found["loss"]
    assert (loss["z_stat"], loss["significant"], loss["significant_negative"]) == (-4.5562, False, True)


def test_ztest_without_data_is_null(arms):
    found = by_name(experiment.proportion_ztest(arms, KEYS))
    for name in ("nobody", "none bought", "empty"):
        assert found[name]["z_stat"] is None and found[name]["significant"] is False
    assert found["none bought"]["relative_lift_pct"] is None


def test_decisions(arms):
    decided = by_name(experiment_report(arms, KEYS, mde=0.02).decision)
    assert {name: r["decision"] for name, r in decided.items()} == {
        "gain": "SHIP",
        "small": "INCONCLUSIVE",
        "real": "BLOCKED",
        "loss": "ABORT",
        "skewed": "BLOCKED",
        "even": "INCONCLUSIVE",
        "nobody": "BLOCKED",
        "none bought": "INCONCLUSIVE",
        "empty": "INCONCLUSIVE",
    }
    gain = decided["gain"]
    assert (gain["required_users"], gain["smaller_arm"]) == (2198, 10000)
    assert (gain["absolute_lift"], gain["p_value"], gain["alpha"]) == (0.015, 5e-06, 0.05)
    plan = experiment.decide(arms, 0.02, KEYS)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_decision_of_one_experiment_without_keys(spark):
    counts = experiment.counts_table(spark, [(10000, 500, 10000, 650)])
    decided = experiment_report(counts, (), 0.02).decision.collect()
    assert [r["decision"] for r in decided] == ["SHIP"]


def test_decision_with_the_designed_split(arms):
    real = arms.where("name = 'real'")
    decided = experiment_report(real, KEYS, mde=0.02, expected_split=(0.51724, 0.48276)).decision.first()
    assert decided["decision"] == "INCONCLUSIVE"


@pytest.mark.parametrize(
    "baseline, mde, alpha, power, effect, users",
    [
        (0.05, 0.02, 0.05, 0.8, -0.0845, 2198),
        (0.05, 0.01, 0.05, 0.8, None, 8143),
        (0.05, 0.05, 0.05, 0.8, None, 424),
        (0.5306, 0.02, 0.05, 0.8, -0.0401, 9745),
        (0.5306, 0.02, 0.2, 0.5, None, 1996),
    ],
)
def test_power(spark, baseline, mde, alpha, power, effect, users):
    rates = spark.createDataFrame([(baseline,)], "baseline_rate double")
    row = experiment.power_table(rates, [mde], alpha=alpha, power=power).first()
    assert (row["n_per_group"], row["n_total"]) == (users, 2 * users)
    assert effect is None or row["effect_size_h"] == effect


def test_power_without_solution_is_null(spark):
    rates = spark.createDataFrame([(0.95,), (None,)], "baseline_rate double")
    rows = experiment.power_table(rates, [0.1, 0.0]).collect()
    assert [r["n_per_group"] for r in rows] == [None] * 4


def test_tail_falls_to_zero_and_stays(spark):
    zs = spark.createDataFrame([(z,) for z in (7.0, 8.0, 8.5, 12.0, 20.0, 40.0)], "z double")
    row = zs.select("z", normal_cdf(F.col("z")).alias("p"), normal_cdf(-F.col("z")).alias("q")).collect()
    assert all(1 - r["p"] < 1e-11 and abs(r["q"]) < 1e-11 for r in row)
    assert [r["p"] for r in row if r["z"] > 8] == [1.0] * 4


def test_summary(spark):
    users = spark.createDataFrame(
        [
            (1, datetime(2022, 12, 31, 23)),
            (2, datetime(2023, 1, 1)),
            (3, None),
            (4, datetime(2020, 1, 1)),
            (4, datetime(2020, 1, 1)),
        ],
        "id long, created_at timestamp",
    )
    orders = spark.createDataFrame(
        [(1, "Complete"), (1, "Shipped"), (1, "Cancelled"), (2, "Cancelled"), (9, "Complete")],
        "user_id long, status string",
    )
    groups = experiment.assign_groups(users, date(2023, 1, 1))
    assert {r["user_id"]: r["experiment_group"] for r in groups.collect()} == {
        1: "control",
        2: "treatment",
        3: "treatment",
        4: "control",
    }
    rows = [tuple(r) for r in experiment.experiment_summary(groups, orders).collect()]
    assert rows == [("control", 2, 1, 50.0), ("treatment", 2, 0, 0.0)]


def chi_square_tail(x, n):
    """Closed forms: a Poisson sum for even degrees, the error function and a sum for odd ones."""
    if n % 2 == 0:
        return math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(n // 2))
    total, term = math.erfc(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for j in range(1, n, 2):
        total, term = total + term, term * x / (j + 2)
    return total


def test_chi_square_tail(spark):
    cases = [(x, n) for n in range(1, 21) for x in (0.001, 0.1, 0.5, 1.0, 2.0, 3.84, 7.0, n * 1.0, n + 2.0, 20.0, 31.4, 60.0, 150.0, 600.0)]
    rows = spark.createDataFrame([(float(x), n, chi_square_tail(x, n)) for x, n in cases], "x double, n int, wanted double")
    for r in rows.withColumn("found", stats.chi_square_tail(F.col("x"), F.col("n"))).collect():
        assert r["found"] == pytest.approx(r["wanted"], rel=1e-9, abs=1e-14), (r["x"], r["n"])
    # Tabulated 5 percent points.
    table = [(3.841459, 1), (5.991465, 2), (7.814728, 3), (9.487729, 4), (18.307038, 10), (31.410433, 20)]
    found = spark.createDataFrame(table, "x double, n int").select(stats.chi_square_tail(F.col("x"), F.col("n")).alias("p")).collect()
    assert [r["p"] for r in found] == pytest.approx([0.05] * 6, abs=1e-7)
    odd = spark.createDataFrame([(0.0, 3), (float("inf"), 3), (1.0, 0), (None, 2)], "x double, n int")
    assert [r[0] for r in odd.select(stats.chi_square_tail(F.col("x"), F.col("n"))).collect()] == [1.0, 0.0, None, None]


def test_normal_quantile_of_a_column(spark):
    given = [1e-6, 1e-4, 0.001, 0.02, 0.025, 0.1, 0.5, 0.77, 0.9, 0.975, 0.995, 0.9999, 0.05 / 7]
    rows = spark.createDataFrame([(p,) for p in given], "p double").select("p", stats.normal_quantile_of(F.col("p")).alias("z")).collect()
    for r in rows:
        assert r["z"] == pytest.approx(NormalDist().inv_cdf(r["p"]), rel=1e-10, abs=1e-12)
    outside = spark.createDataFrame([(0.0,), (1.0,), (-1.0,), (None,)], "p double")
    assert {r[0] for r in outside.select(stats.normal_quantile_of(F.col("p"))).collect()} == {None}


def test_power_with_a_level_of_each_row(spark):
    rows = [("a", 0.05, 0.05, 0.8), ("b", 0.05, 0.01, 0.9), ("c", 0.5306, 0.2, 0.5)]
    frame = spark.createDataFrame(rows, "name string, baseline_rate double, alpha double, power double")
    found = by_name(experiment.power_table(frame, [0.02], KEYS, alpha="alpha", power="power"))
    for name, rate, alpha, power in rows:
        alone = spark.createDataFrame([(name, rate)], "name string, baseline_rate double")
        wanted = experiment.power_table(alone, [0.02], KEYS, alpha=alpha, power=power).first()
        assert found[name] == wanted
    assert found["c"]["n_per_group"] == 1996
    slices = experiment.bonferroni(frame.drop("alpha"))
    assert {r["alpha"] for r in slices.collect()} == {0.05 / 3}


def test_ratio_of_many_arms(spark):
    split = {"a": 0.5, "b": 0.3, "c": 0.2}
    rows = [("even", "a", 500), ("even", "b", 300), ("even", "c", 200), ("off", "a", 560), ("off", "b", 260), ("off", "c", 180),
            ("lost", "a", 500), ("lost", "b", 500), ("new", "a", 500), ("new", "b", 300), ("new", "c", 200), ("new", "d", 1), ("empty", "a", 0)]
    found = by_name(experiment.srm_check_arms(spark.createDataFrame(rows, "name string, experiment_group string, total_users long"), split, KEYS))
    assert (found["even"]["chi2_stat"], found["even"]["p_value"], found["even"]["verdict"]) == (0, 1, "PASS")
    x = 60**2 / 500 + 40**2 / 300 + 20**2 / 200
    assert found["off"]["chi2_stat"] == round(x, 4) and found["off"]["p_value"] == round(math.exp(-x / 2), 6) and found["off"]["srm_detected"]
    assert found["lost"]["srm_detected"] and found["new"]["srm_detected"] and found["new"]["p_value"] == 0
    assert found["empty"]["p_value"] is None and not found["empty"]["srm_detected"]
    assert {(r["arms"], r["degrees"]) for r in found.values()} == {(3, 2)}
    # Two arms are what the check of two arms says.
    two = experiment.counts_table(spark, [("x", 51724, 0, 48276, 0)], KEYS)
    long = spark.createDataFrame([("x", "control", 51724), ("x", "treatment", 48276)], "name string, experiment_group string, total_users long")
    a, b = experiment.srm_check(two, KEYS).first(), experiment.srm_check_arms(long, {"control": 0.5, "treatment": 0.5}, KEYS).first()
    assert (a["chi2_stat"], a["p_value"], a["verdict"]) == (b["chi2_stat"], b["p_value"], b["verdict"])
    with pytest.raises(ValueError):
        experiment.srm_check_arms(long, {"control": 1.0}, KEYS)
