import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from footfall.operators import segments
from footfall.plans.queries import rfm_base
from footfall.session import materialize

RFM = "user_id long, recency_days long, frequency long, monetary_value double"


@pytest.fixture(scope="module")
def blobs(spark):
    """Three groups far apart."""
    noise = np.random.default_rng(1).normal(0, 1, (90, 3))
    centres = [(10, 5, 100), (200, 50, 1000), (400, 5, 5000)]
    rows = [
        (i, int(c[0] + noise[i, 0]), int(c[1]), float(c[2] + noise[i, 2]))
        for i, c in ((i, centres[i // 30]) for i in range(90))
    ]
    return spark.createDataFrame(rows, RFM).cache()


def test_scaling(blobs):
    parameters = {r["feature"]: r for r in segments.scale_parameters(blobs).collect()}
    values = blobs.toPandas()
    for feature in segments.RFM_FEATURES:
        q1, q2, q3 = np.percentile(values[feature], [25, 50, 75])
        assert parameters[feature]["center"] == pytest.approx(q2)
        assert parameters[feature]["scale"] == pytest.approx(q3 - q1 if q3 > q1 else 1)
    done = segments.robust_scale(blobs, segments.scale_parameters(blobs)).toPandas()
    assert done["monetary_value_scaled"].median() == pytest.approx(0)


def test_constant_column(spark):
    flat = spark.createDataFrame([(i, 7, i, 1.5) for i in range(5)], RFM)
    done = segments.robust_scale(flat, segments.scale_parameters(flat)).collect()
    assert {r["recency_days_scaled"] for r in done} == {0.0}


def test_clusters(spark, blobs):
    prepared = segments.robust_scale(blobs, segments.scale_parameters(blobs))
    fitted, model = segments.fit_segments(prepared, 3, restarts=3)
    found = fitted.toPandas()
    groups = found.groupby(found["user_id"] // 30)["segment"].agg(["nunique", "first"])
    assert (groups["nunique"] == 1).all() and groups["first"].nunique() == 3
    assert set(found.columns) == set(prepared.columns) | {"segment"}
    # Every row belongs to its nearest centre.
    points = found[[segments.scaled(f) for f in segments.RFM_FEATURES]].to_numpy()
    centres = model.centers
    nearest = ((points[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
    assert (nearest == found["segment"]).all()


def points_of(rows, features=segments.RFM_FEATURES, id_column="user_id"):
    return segments._points(rows, features, id_column).cache()


def test_more_starts_never_cost_more(blobs):
    points = points_of(segments.robust_scale(blobs, segments.scale_parameters(blobs)))
    costs = [segments.best_models(points, [4], 1, n)[4].cost for n in (1, 4)]
    assert costs[1] <= costs[0] * (1 + 1e-9)


def test_no_dearer_than_the_library(spark):
    """Costs of the best of ten starts, on the customers of the test files."""
    folder = "/root/testdata/sf0.01"
    base = materialize(rfm_base(spark, folder), "base")
    prepared = materialize(segments.robust_scale(base, segments.scale_parameters(base)), "prepared")
    points = points_of(prepared)
    models = segments.best_models(points, [2, 4, 6], 42, 10)
    vectors = VectorAssembler(inputCols=["_0", "_1", "_2"], outputCol="features").transform(points).cache()
    for k, model in models.items():
        fits = [KMeans(k=k, seed=seed, maxIter=100, tol=1e-6).fit(vectors).summary.trainingCost for seed in range(4)]
        assert model.cost <= min(fits) * (1 + 1e-9)
        assert model.k == k and model.cost == pytest.approx(
            sum(((np.array([r["_0"], r["_1"], r["_2"]]) - model.centers) ** 2).sum(axis=1).min() for r in points.collect())
        )


def test_an_iteration_is_one_job_whatever_the_starts(spark, blobs):
    points = points_of(segments.robust_scale(blobs, segments.scale_parameters(blobs)))
    points.count()
    random = np.random.default_rng(2)
    tracker = spark.sparkContext.statusTracker()

    def jobs(models):
        spark.sparkContext.setJobGroup(f"sums-{models}", "one pass")
        try:
            segments._sums(points, [random.normal(size=(4, 3)) for _ in range(models)], 3)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(f"sums-{models}"))

    assert jobs(1) == jobs(60)


def test_rows_are_dealt_evenly_to_all_cores(spark, monkeypatch):
    """Though they come from one task, as every iteration waits for its longest task."""
    monkeypatch.setattr(segments, "ROWS_A_TASK", 1000)
    rows = spark.range(30_000).select(
        F.lit(None).cast("long").alias("user_id"), *[F.rand(i).alias(segments.scaled(f)) for i, f in enumerate(segments.RFM_FEATURES)]
    )
    with segments._kept(segments._points(rows.coalesce(1), segments.RFM_FEATURES, "user_id"), segments.RFM_FEATURES) as kept:
        blocks = kept.select(F.spark_partition_id().alias("task"), F.length("_block").alias("bytes")).groupBy("task").agg(F.sum("bytes").alias("n")).collect()
        tasks = min(segments.TASKS_A_CORE * spark.sparkContext.defaultParallelism, 30)
        assert len(blocks) >= tasks
        assert sum(r["n"] for r in blocks) == 30_000 * 3 * 8
        assert max(r["n"] for r in blocks) <= 1.2 * 30_000 * 3 * 8 / tasks


def test_rows_are_placed_as_by_differences():
    """Also where they are equally near to several centres, or far from the origin."""
    random = np.random.default_rng(7)
    grid = random.integers(0, 4, (500, 3)).astype(float)
    far = random.normal(size=(500, 3)) + [1e9, -1e9, 1e7]
    for rows in (grid, far, np.concatenate([grid, far])):
        models = [rows[random.integers(0, len(rows), k)] for k in (1, 2, 5, 7, 40)]
        for model, (own, distance) in zip(models, segments._placed(rows, models)):
            distances = segments._distances(rows, model)
            assert (own == distances.argmin(axis=1)).all()
            assert (distance == distances.min(axis=1)).all()


def test_fewer_rows_than_centres(spark):
    few = spark.createDataFrame([(i, float(i % 2), 0.0, 1.0) for i in range(6)], "user_id long, recency_days_scaled double, frequency_scaled double, monetary_value_scaled double")
    fitted, model = segments.fit_segments(few, 4, restarts=2)
    assert model.cost == 0 and fitted.select("segment").distinct().count() == 2
    with pytest.raises(ValueError):
        segments.fit_segments(few.limit(0), 2, restarts=1)


def test_sweep(blobs):
    prepared = segments.robust_scale(blobs, segments.scale_parameters(blobs))
    rows = segments.k_sweep(prepared, ks=(2, 3), restarts=2).collect()
    assert [r["k"] for r in rows] == [2, 3]
    assert rows[1]["inertia"] < rows[0]["inertia"]
    assert rows[1]["silhouette_score"] > 0.9 and rows[1]["silhouette_squared"] > 0.9
    assert {r["silhouette_error"] for r in rows} == {0.0}


def brute_silhouettes(points, label):
    """Mean silhouettes by squared and by plain distances."""
    out = []
    for power in (2, 1):
        scores = []
        for i in range(len(points)):
            far = np.sqrt(((points - points[i]) ** 2).sum(axis=1)) ** power
            own = (label == label[i]) & (np.arange(len(points)) != i)
            if not own.any():
                scores.append(0.0)
                continue
            a, b = far[own].mean(), min(far[label == c].mean() for c in set(label) - {label[i]})
            scores.append((b - a) / max(a, b) if max(a, b) else 0.0)
        out.append(np.mean(scores))
    return out


def test_silhouettes_of_all_rows(spark):
    random = np.random.default_rng(5)
    centers = np.array([[0.0, 0.0], [3.0, 1.0], [9.0, 9.0]])
    points = np.concatenate([random.normal(size=(n, 2)) + c for n, c in zip((250, 150, 1), centers)])
    frame = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "user_id long, a_scaled double, b_scaled double").repartition(5)
    label = ((points[:, None] - centers) ** 2).sum(axis=2).argmin(axis=1)
    squared, plain = brute_silhouettes(points, label)
    models = {3: centers, 1: centers[:1]}
    held = points_of(frame, ["a", "b"])
    found = segments.silhouettes(held, models, partners=300)
    assert found[3] == (pytest.approx(squared), pytest.approx(plain), 0.0) and found[1] == (None, None, None)
    errors = []
    for seed in range(12):
        _, score, error = segments.silhouettes(held, {3: centers}, seed=seed, partners=40)[3]
        assert 0 < error < 0.05
        errors.append((score - plain) / error)
    # Standard errors tell how far off the estimates are.
    assert np.mean(np.abs(errors) <= 2) >= 0.7 and max(map(abs, errors)) < 5


def test_results_do_not_depend_on_partitions(blobs):
    prepared = segments.robust_scale(blobs, segments.scale_parameters(blobs))
    outcomes = []
    for rows in (prepared.coalesce(1), prepared.repartition(7)):
        fitted, model = segments.fit_segments(rows, 3, restarts=2)
        sizes = sorted(r["count"] for r in fitted.groupBy("segment").count().collect())
        outcomes.append((sizes, [tuple(r) for r in segments.k_sweep(rows, ks=(2, 3), restarts=2).collect()]))
        assert tuple(segments.check_fit(fitted, model).first())[0::2] == (90, 3)
        assert segments.check_fit(fitted, model).first()["misplaced"] == 0
    assert outcomes[0] == outcomes[1]


def test_missing_features_are_named(blobs):
    prepared = segments.robust_scale(blobs, segments.scale_parameters(blobs))
    hole = prepared.withColumn("frequency_scaled", F.when(F.col("user_id") > 0, F.col("frequency_scaled")))
    with pytest.raises(ValueError, match="frequency"):
        segments.fit_segments(hole, 3, restarts=1)


def test_squared_silhouette_by_hand(spark):
    """Points on a line: 0, 1, 2 | 10, 12 | 30."""
    x, label = [0.0, 1.0, 2.0, 10.0, 12.0, 30.0], [5, 5, 5, 2, 2, 9]
    expected = []
    for i in range(6):
        own = [j for j in range(6) if label[j] == label[i] and j != i]
        if not own:
            expected.append(0.0)
            continue
        a = np.mean([(x[i] - x[j]) ** 2 for j in own])
        b = min(np.mean([(x[i] - x[j]) ** 2 for j in range(6) if label[j] == c]) for c in set(label) - {label[i]})
        expected.append((b - a) / max(a, b))
    rows = spark.createDataFrame(list(zip(x, label)), "v_scaled double, segment int")
    assert segments.squared_silhouette(rows, ["v"]).first()[0] == pytest.approx(np.mean(expected), abs=6e-5)
    assert segments.squared_silhouette(rows.withColumn("segment", F.lit(1)), ["v"]).first()[0] is None


def profiles_of(spark, rows):
    return spark.createDataFrame(rows, "segment int, recency double, frequency double, monetary double, count long")


def test_labels(spark):
    four = profiles_of(
        spark, [(0, 10.0, 1.0, 500.0, 1), (1, 20.0, 1.0, 50.0, 1), (2, 300.0, 1.0, 400.0, 1), (3, 400.0, 1.0, 10.0, 1)]
    )
    labelled = segments.segment_actions(segments.label_segments(four))
    assert {r["segment"]: r["label"] for r in labelled.collect()} == {
        0: "Champions", 1: "Promising", 2: "At Risk", 3: "Lost",
    }
    assert all(r["action"] for r in labelled.collect())


def test_tied_recency_is_not_recent_and_labels_repeat(spark):
    tied = profiles_of(spark, [(0, 5.0, 1.0, 9.0, 1), (1, 5.0, 1.0, 9.0, 1)])
    assert {r["label"] for r in segments.label_segments(tied).collect()} == {"At Risk"}


@pytest.fixture(scope="module")
def labelled(spark, blobs):
    rows = blobs.withColumn("segment", F.floor(F.col("user_id") / 30).cast("int"))
    profiles = segments.label_segments(segments.segment_profiles(rows))
    return segments.attach_labels(rows, profiles)


def test_revenue_and_kpis(labelled):
    revenue = segments.revenue_at_stake(labelled).collect()
    assert sum(r["pct"] for r in revenue) == pytest.approx(100, abs=0.3)
    assert [r["total_revenue"] for r in revenue] == sorted((r["total_revenue"] for r in revenue), reverse=True)
    kpis = segments.segment_kpis(labelled).first()
    assert (kpis["customers"], kpis["segments"]) == (90, 3)


def test_sample_is_stable(labelled):
    picked = [{r["user_id"] for r in segments.segment_sample(df, 20).collect()}
              for df in (labelled, labelled.repartition(5))]
    assert picked[0] == picked[1] and len(picked[0]) == 20
    assert {r["user_id"] for r in segments.segment_sample(labelled, 20, seed=1).collect()} != picked[0]
    assert segments.segment_sample(labelled, 1000).count() == 90
