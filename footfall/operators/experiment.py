"""Experiment read-outs: assignment, summary, sample-ratio check, z-test, power, decision.

After the summary everything is a projection: one row per experiment, so thousands of
experiments or slices are judged in the same plan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from footfall.fixed_values import (
    ALPHA,
    ARM_CONTROL,
    ARM_TREATMENT,
    DECISION_ABORT,
    DECISION_BLOCKED,
    DECISION_INCONCLUSIVE,
    DECISION_SHIP,
    EXPECTED_SPLIT,
    POWER,
    REVENUE_STATUSES,
    SRM_BROKEN,
    SRM_PASS,
)
from footfall.functions.maths import half_even, half_up, ratio
from footfall.functions.stats import (
    chi_square_p,
    chi_square_tail,
    effect_size,
    normal_quantile,
    sample_size,
    two_sided_p,
)

COUNTS = ("n_control", "x_control", "n_treatment", "x_treatment")


def assign_groups(
    users: DataFrame, cutoff: date, user: str = "id", ts: str = "created_at", keys: Sequence[str] = ()
) -> DataFrame:
    """``user_id, experiment_group``: control before the cutoff date, treatment otherwise."""
    arm = F.when(F.to_date(ts) < F.lit(cutoff), ARM_CONTROL).otherwise(ARM_TREATMENT)
    return users.select(F.col(user).alias("user_id"), arm.alias("experiment_group"), *keys)


def experiment_summary(
    assigned: DataFrame,
    orders: DataFrame,
    keys: Sequence[str] = (),
    statuses: Sequence[str] = REVENUE_STATUSES,
    user: str = "user_id",
    status: str = "status",
    converts: Column | None = None,
) -> DataFrame:
    """``[keys,] experiment_group, total_users, conversions, conversion_rate_pct``.

    A user converts with any qualifying order, or any that ``converts`` holds for as well.  Qualifying orders shrink to one row per
    buyer before the join, so a user with very many orders weighs as much as any other.
    """
    buyers = (
        orders.where(F.col(status).isin(*statuses) & (F.lit(True) if converts is None else converts))
        .groupBy(F.col(user).alias("user_id"))
        .agg(F.lit(1).alias("_bought"))
    )
    return (
        assigned.join(buyers, "user_id", "left")
        # A user listed twice in an arm counts once; the join's partitioning serves this too.
        .groupBy("user_id", *keys, "experiment_group")
        .agg(F.max(F.coalesce("_bought", F.lit(0))).alias("_converted"))
        .groupBy(*keys, "experiment_group")
        .agg(
            F.count(F.lit(1)).alias("total_users"),
            F.sum("_converted").alias("conversions"),
            half_up(F.avg("_converted") * 100, 4).alias("conversion_rate_pct"),
        )
        .orderBy(*keys, "experiment_group")
    )


def counts_table(spark: SparkSession, rows: Sequence[tuple], keys: Sequence[str] = ()) -> DataFrame:
    """Arm counts typed in by hand: (keys..., n_control, x_control, n_treatment, x_treatment)."""
    schema = ", ".join([f"{key} string" for key in keys] + [f"{name} long" for name in COUNTS])
    return spark.createDataFrame(rows, schema)


def arms_side_by_side(summary: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per experiment with the counts of both arms; a missing arm counts zero."""
    def of(arm: str, count: str, name: str) -> Column:
        value = F.when(F.col("experiment_group") == arm, F.col(count))
        return F.coalesce(F.sum(value), F.lit(0)).alias(name)

    return summary.groupBy(*keys).agg(
        of(ARM_CONTROL, "total_users", "n_control"),
        of(ARM_CONTROL, "conversions", "x_control"),
        of(ARM_TREATMENT, "total_users", "n_treatment"),
        of(ARM_TREATMENT, "conversions", "x_treatment"),
    )


def srm_check(
    arms: DataFrame,
    keys: Sequence[str] = (),
    expected_split: tuple[float, float] = EXPECTED_SPLIT,
    alpha: float = ALPHA,
) -> DataFrame:
    """``[keys,] n_control, n_treatment, chi2_stat, p_value, srm_detected, verdict``.

    ``expected_split`` is the designed share of each arm.  Testing the observed shares
    against themselves would always pass.
    """
    return _with_srm(arms, expected_split, alpha).select(
        *keys,
        "n_control",
        "n_treatment",
        half_even(F.col("_chi2"), 4).alias("chi2_stat"),
        half_even(F.col("_srm_p"), 6).alias("p_value"),
        F.col("_srm").alias("srm_detected"),
        F.when(F.col("_srm"), SRM_BROKEN).otherwise(SRM_PASS).alias("verdict"),
    )


def _with_srm(arms: DataFrame, expected_split: tuple[float, float], alpha: float) -> DataFrame:
    """Adds ``_chi2, _srm_p, _srm``."""
    total = F.col("n_control") + F.col("n_treatment")
    parts = [
        ratio((F.col(n) - total * share) * (F.col(n) - total * share), total * share)
        for n, share in zip(("n_control", "n_treatment"), expected_split)
    ]
    return (
        arms.withColumn("_chi2", parts[0] + parts[1])
        .withColumn("_srm_p", chi_square_p(F.col("_chi2")))
        # An empty experiment has no p.
        .withColumn("_srm", F.coalesce(F.col("_srm_p") < alpha, F.lit(False)))
    )


def assign_arms(
    users: DataFrame, split: Mapping[str, float], bucket: Column, buckets: int = 100, user: str = "id", keys: Sequence[str] = ()
) -> DataFrame:
    """``user_id, experiment_group``: the arm whose share of ``buckets`` holds the user's ``bucket``.

    ``split`` is the designed share of each arm, in the order in which buckets are dealt out; a
    user beyond all shares is in no arm and left out.
    """
    edges, arm = 0.0, F.lit(None).cast("string")
    for name, share in split.items():
        low, edges = edges, edges + share
        arm = F.when(bucket.between(round(low * buckets), round(edges * buckets) - 1), name).otherwise(arm)
    found = users.select(F.col(user).alias("user_id"), arm.alias("experiment_group"), *keys)
    return found.where(F.col("experiment_group").isNotNull())


def srm_check_arms(
    summary: DataFrame,
    split: Mapping[str, float],
    keys: Sequence[str] = (),
    alpha: float = ALPHA,
) -> DataFrame:
    """``[keys,] arms, total_users, chi2_stat, degrees, p_value, srm_detected, verdict``.

    ``summary`` has a row per experiment and arm, as ``experiment_summary`` returns it, and
    ``split`` the designed share of every arm.  An arm of the design without users counts zero;
    users of an arm that the design does not have break it.  An experiment without users has
    no p.
    """
    whole = sum(split.values())
    if len(split) < 2 or min(split.values()) <= 0:
        raise ValueError("a split has two arms or more, each with a share")

    def users_of(arm: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("experiment_group") == arm, F.col("total_users"))), F.lit(0))

    names = {arm: f"_n{i}" for i, arm in enumerate(split)}
    counted = summary.groupBy(*keys).agg(
        F.coalesce(F.sum("total_users"), F.lit(0)).alias("total_users"), *[users_of(a).alias(n) for a, n in names.items()]
    )
    total = F.col("total_users")
    planned = {n: total * (split[a] / whole) for a, n in names.items()}
    parts = [ratio((F.col(n) - e) * (F.col(n) - e), e) for n, e in planned.items()]
    outside = total - reduce(lambda a, b: a + b, [F.col(n) for n in names.values()])
    statistic = F.when(outside > 0, F.lit(float("inf"))).otherwise(reduce(lambda a, b: a + b, parts))
    degrees = F.lit(len(split) - 1)
    return (
        counted.withColumn("_chi2", statistic)
        .withColumn("_p", chi_square_tail(F.col("_chi2"), degrees))
        .withColumn("_srm", F.coalesce(F.col("_p") < alpha, F.lit(False)))
        .select(
            *keys,
            F.lit(len(split)).alias("arms"),
            "total_users",
            half_even(F.col("_chi2"), 4).alias("chi2_stat"),
            degrees.alias("degrees"),
            half_even(F.col("_p"), 6).alias("p_value"),
            F.col("_srm").alias("srm_detected"),
            F.when(F.col("_srm"), SRM_BROKEN).otherwise(SRM_PASS).alias("verdict"),
        )
    )


def bonferroni(rows: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Adds ``alpha`` divided by the number of rows, one per experiment or slice."""
    return rows.withColumn("alpha", alpha / rows.agg(F.count(F.lit(1))).scalar())


def proportion_ztest(arms: DataFrame, keys: Sequence[str] = (), alpha: float = ALPHA) -> DataFrame:
    """Two-sample z-test of conversion rates, one row per experiment.

    The statistic uses the pooled standard error (both arms share one rate if nothing
    changed), the interval of level 1 - alpha the unpooled one.  ``significant`` means a
    significant gain, ``significant_negative`` a significant loss.  Figures that would
    divide by zero are NULL.
    """
    lift = F.col("_lift")
    return _with_ztest(arms, alpha).select(
        *keys,
        half_even(F.col("_p_c"), 6).alias("p_control"),
        half_even(F.col("_p_t"), 6).alias("p_treatment"),
        half_even(lift, 6).alias("absolute_lift"),
        half_even(F.try_divide(lift, F.col("_p_c")) * 100, 2).alias("relative_lift_pct"),
        half_even(F.col("_z"), 4).alias("z_stat"),
        half_even(F.col("_p"), 6).alias("p_value"),
        half_even(F.col("_low"), 6).alias("ci_lower"),
        half_even(F.col("_high"), 6).alias("ci_upper"),
        F.col("_gain").alias("significant"),
        F.col("_loss").alias("significant_negative"),
    )


def _with_ztest(arms: DataFrame, alpha: float) -> DataFrame:
    """Adds ``_p_c, _p_t, _lift, _z, _p, _low, _high, _gain, _loss``."""
    n_c, x_c, n_t, x_t = (F.col(name) for name in COUNTS)
    p_c, p_t, lift = F.col("_p_c"), F.col("_p_t"), F.col("_lift")
    pooled = ratio(x_c + x_t, n_c + n_t)
    inverse_sizes = ratio(F.lit(1), n_c) + ratio(F.lit(1), n_t)
    unpooled_error = F.sqrt(ratio(p_c * (1 - p_c), n_c) + ratio(p_t * (1 - p_t), n_t))
    reach = unpooled_error * normal_quantile(1 - alpha / 2)
    below_alpha = F.coalesce(F.col("_p") < alpha, F.lit(False))
    return (
        arms.withColumns({"_p_c": ratio(x_c, n_c), "_p_t": ratio(x_t, n_t)})
        .withColumn("_lift", p_t - p_c)
        .withColumn("_z", F.try_divide(lift, F.sqrt(pooled * (1 - pooled) * inverse_sizes)))
        .withColumns({"_p": two_sided_p(F.col("_z")), "_low": lift - reach, "_high": lift + reach})
        .withColumns({"_gain": below_alpha & (F.col("_low") > 0), "_loss": below_alpha & (F.col("_high") < 0)})
    )


def power_table(
    baselines: DataFrame,
    mdes: Sequence[float],
    keys: Sequence[str] = (),
    baseline: str = "baseline_rate",
    alpha: float | str = ALPHA,
    power: float | str = POWER,
) -> DataFrame:
    """Users needed per arm for each baseline and minimum detectable effect.

    ``baselines`` are measured rates, one row per experiment.  ``alpha`` and ``power`` are
    numbers or the names of columns of ``baselines``.  An effect that would push
    the rate outside [0, 1], or no effect at all, has no sample size: NULL.
    """
    level, strength = (F.col(x) if isinstance(x, str) else F.lit(float(x)) for x in (alpha, power))
    return (
        baselines.select(
            *keys,
            level.cast("double").alias("_alpha"),
            strength.cast("double").alias("_power"),
            F.col(baseline).cast("double").alias("baseline_rate"),
            F.explode(F.array(*[F.lit(float(m)) for m in mdes])).alias("mde"),
        )
        .withColumn("treatment_rate", F.col("baseline_rate") + F.col("mde"))
        .withColumn("_h", effect_size(F.col("baseline_rate"), F.col("treatment_rate")))
        .withColumn("n_per_group", half_even(sample_size(F.col("_h"), F.col("_alpha") if isinstance(alpha, str) else alpha, F.col("_power") if isinstance(power, str) else power), 0).cast("long"))
        .select(
            *keys,
            "baseline_rate",
            "treatment_rate",
            "mde",
            half_even(F.col("_h"), 4).alias("effect_size_h"),
            "n_per_group",
            (F.col("n_per_group") * 2).alias("n_total"),
            F.col("_alpha").alias("alpha"),
            F.col("_power").alias("power"),
        )
    )


def measured_baselines(arms: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The control arm's conversion rate, to plan the next experiment with."""
    return arms.select(*keys, ratio(F.col("x_control"), F.col("n_control")).alias("baseline_rate"))


def decide(
    arms: DataFrame,
    mde: float,
    keys: Sequence[str] = (),
    alpha: float = ALPHA,
    power: float = POWER,
    expected_split: tuple[float, float] = EXPECTED_SPLIT,
    srm_alpha: float = ALPHA,
) -> DataFrame:
    """``[keys,] decision, reason`` and the figures behind them, one row per experiment.

    The figures: ``required_users`` per arm, ``smaller_arm``, ``absolute_lift``, ``p_value``
    of the z-test and its ``alpha``.  A broken split blocks; too few users is inconclusive;
    then a significant gain ships and a significant loss aborts.  All of it is computed on
    the one row of counts, so there is nothing to join.
    """
    shift = effect_size(F.col("_p_c"), F.col("_p_c") + float(mde))
    enough = F.coalesce(F.col("smaller_arm") >= F.col("required_users"), F.lit(False))
    ruling = (
        F.when(F.col("_srm"), _ruling(DECISION_BLOCKED, "arm sizes do not match the design"))
        .when(~enough, _ruling(DECISION_INCONCLUSIVE, "fewer users per arm than required"))
        .when(F.col("_gain") & (F.col("_lift") > 0), _ruling(DECISION_SHIP, "significant gain over control"))
        .when(F.col("_loss") & (F.col("_lift") < 0), _ruling(DECISION_ABORT, "significant loss against control"))
        .otherwise(_ruling(DECISION_INCONCLUSIVE, "no reliable difference between the arms"))
    )
    return (
        _with_ztest(_with_srm(arms, expected_split, srm_alpha), alpha)
        .withColumn("_h", shift)
        .withColumn("required_users", half_even(sample_size(F.col("_h"), alpha, power), 0).cast("long"))
        .withColumn("smaller_arm", F.least("n_control", "n_treatment"))
        .withColumn("_ruling", ruling)
        .select(
            *keys,
            F.col("_ruling.decision").alias("decision"),
            F.col("_ruling.reason").alias("reason"),
            "required_users",
            "smaller_arm",
            half_even(F.col("_lift"), 6).alias("absolute_lift"),
            half_even(F.col("_p"), 6).alias("p_value"),
            F.lit(float(alpha)).alias("alpha"),
        )
    )


def _ruling(decision: str, reason: str) -> Column:
    return F.struct(F.lit(decision).alias("decision"), F.lit(reason).alias("reason"))
