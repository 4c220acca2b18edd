"""Customer segments: robust scaling, K-Means, choice of k, profiles and labels."""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from footfall.fixed_values import (
    LABEL_AT_RISK,
    LABEL_CHAMPIONS,
    LABEL_LOST,
    LABEL_PROMISING,
    RFM_FEATURES,
    SEGMENT_ACTIONS,
    SEGMENT_COUNT,
    SEGMENT_RESTARTS,
    SEGMENT_SAMPLE,
    SEGMENT_SEED,
    SEGMENT_SWEEP,
)
from footfall.functions.maths import half_even, percent
from footfall.functions.money import exact_sum
from footfall.operators.ranking import exact_quantiles
from footfall.session import materialize

MAX_ITERATIONS = 300
# Squared movement of all centres together, relative to the mean variance of the features.
TOLERANCE = 1e-4
# Rounds of drawing a start's candidates; costs that are near the best; rows of which distances
# are held at a time.
ROUNDS = 3
CLOSE = 0.02
SLAB = 2048
NARROW_SLAB = 256
FEW_TASKS = 64
# Tasks of an iteration for each core, if they have so many rows: these are dealt evenly, as
# every iteration waits for the last task.
TASKS_A_CORE = 2
ROWS_A_TASK = 8 * SLAB
# How far a squared distance by a matrix product may be off, relative to the squares it is made
# of; this is many times what rounding can do.
ROUNDING = 1e-13
# The squared movement, relative to that at which a model is done, at which the best are.
FINE = 1e-6
# Rows that stand for a segment in the Euclidean silhouette, in so many groups.
SILHOUETTE_PARTNERS = 256
REPLICATES = 8
BROADCAST_SEGMENTS = 10_000


def scaled(feature: str) -> str:
    return f"{feature}_scaled"


def scale_parameters(
    rows: DataFrame, features: Sequence[str] = RFM_FEATURES, tie: str = "user_id"
) -> DataFrame:
    """``feature, center, scale``: median and interquartile range, exact; a zero range is 1."""
    quartiles = exact_quantiles(rows, features, {"q1": 0.25, "q2": 0.5, "q3": 0.75}, tie)
    spread = F.col("q3") - F.col("q1")
    return quartiles.select(
        F.col("column").alias("feature"),
        F.col("q2").alias("center"),
        F.when(spread == 0, F.lit(1.0)).otherwise(spread).alias("scale"),
    )


def robust_scale(
    rows: DataFrame, parameters: DataFrame, features: Sequence[str] = RFM_FEATURES
) -> DataFrame:
    """Adds ``<feature>_scaled`` = (value - center) / scale."""
    one_row = parameters.agg(
        F.struct(
            *[
                F.max(F.when(F.col("feature") == f, F.struct("center", "scale"))).alias(f)
                for f in features
            ]
        )
    )
    return (
        rows.withColumn("_by", one_row.scalar())
        .withColumns(
            {scaled(f): (F.col(f) - F.col("_by")[f]["center"]) / F.col("_by")[f]["scale"] for f in features}
        )
        .drop("_by")
    )


def _points(rows: DataFrame, features: Sequence[str], id_column: str) -> DataFrame:
    """``_h`` and the scaled features as ``_0, _1, ...``.  ``_h`` is a hash of the id: draws
    depend on it, not on where a row lies."""
    return rows.select(
        F.xxhash64(id_column).alias("_h"), *[F.col(scaled(f)).cast("double").alias(f"_{i}") for i, f in enumerate(features)]
    )


@dataclass(frozen=True)
class Segmentation:
    """Centres of one K-Means model, its cost over all rows, and how many iterations it took."""

    centers: np.ndarray
    cost: float
    iterations: int
    features: tuple[str, ...]

    @property
    def k(self) -> int:
        return len(self.centers)

    def nearest(self) -> Column:
        """INT: the number of the nearest centre, of equally near ones the first."""
        distances = F.array(*[_distance(self.features, c) for c in self.centers.tolist()])
        return (F.array_position(distances, F.array_min(distances)) - 1).cast("int")


def _distance(features: Sequence[str], centre: Sequence[float]) -> Column:
    parts = [(F.col(scaled(f)) - x) * (F.col(scaled(f)) - x) for f, x in zip(features, centre)]
    return reduce(lambda a, b: a + b, parts)


def _distances(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances, points by centres, summed in the order of the columns."""
    out = np.zeros((len(points), len(centers)))
    for x, c in zip(points.T, centers.T):
        out += (x[:, None] - c[None, :]) ** 2
    return out


def _batches(batches: Iterator[pa.RecordBatch], features: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes and points of Arrow batches, in pieces of at most SLAB rows."""
    for batch in batches:
        if "_block" in batch.schema.names:
            for hashes, block in zip(batch.column("_h"), batch.column("_block")):
                yield np.frombuffer(hashes.as_buffer(), np.uint64), np.frombuffer(block.as_buffer(), np.float64).reshape(-1, features)
            continue
        for first in range(0, batch.num_rows, SLAB):
            part = batch.slice(first, SLAB)
            columns = [part.column(f"_{i}").to_numpy(zero_copy_only=False) for i in range(features)]
            yield part.column("_h").to_numpy(zero_copy_only=False).view(np.uint64), np.stack(columns, axis=1)


def _packed(points: DataFrame, features: int) -> DataFrame:
    """``_h, _block, _missing``: SLAB points a row, as bytes, which go to the tasks' Python as
    they are, and whether a feature is missing in these."""

    def pack(batches):
        for hashes, rows in _batches(batches, features):
            columns = [pa.array([hashes.tobytes()]), pa.array([rows.tobytes()]), pa.array([bool(np.isnan(rows).any())])]
            yield pa.RecordBatch.from_arrays(columns, names=["_h", "_block", "_missing"])

    return points.mapInArrow(pack, "_h binary, _block binary, _missing boolean")


def _uniform(hashes: np.ndarray, start: int, turn: int) -> np.ndarray:
    """Numbers in (0, 1) drawn from the rows' hashes, anew for every start and turn."""
    mixed = hashes ^ np.uint64(((start * 1_000_003 + turn) * 0x9E3779B97F4A7C15) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    return ((mixed >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53


def _draw(points: DataFrame, chosen: list[np.ndarray], turn: int, most: int, features: int) -> list[np.ndarray]:
    """For every start up to ``most`` further rows, drawn by their squared distance to those
    ``chosen``: the ``most`` smallest of exponential keys, which needs no total first.

    Tasks send their own smallest keys only.
    """

    def smallest(batches):
        best: list[list[tuple]] = [[] for _ in chosen]
        for hashes, rows in _batches(batches, features):
            for start, centers in enumerate(chosen):
                far = _distances(rows, centers).min(axis=1) if len(centers) else np.ones(len(rows))
                with np.errstate(divide="ignore"):
                    keys = -np.log(_uniform(hashes, start, turn)) / far
                # Most rows are behind those found so far.
                near = np.flatnonzero(keys <= best[start][-1][0]) if len(best[start]) == most else np.arange(len(rows))
                for i in near[np.argsort(keys[near], kind="stable")[:most]]:
                    if np.isfinite(keys[i]):
                        best[start].append((float(keys[i]), *rows[i].tolist()))
                best[start] = sorted(best[start])[:most]
        rows = [(start, *row) for start, found in enumerate(best) for row in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)

    names = ["start", "key", *[f"_{i}" for i in range(features)]]
    schema = "start long, key double, " + ", ".join(f"_{i} double" for i in range(features))
    first = Window.partitionBy("start").orderBy("key", *names[2:])
    found = points.mapInArrow(smallest, schema).withColumn("n", F.row_number().over(first)).where(F.col("n") <= most).collect()
    picked = []
    for start, centers in enumerate(chosen):
        rows = sorted((r["n"], [r[c] for c in names[2:]]) for r in found if r["start"] == start)
        picked.append(np.concatenate([centers, np.array([x for _, x in rows]).reshape(-1, features)]))
    return picked


def _placed(rows: np.ndarray, models: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per model the number of the centre nearest to each row, and the squared distance to it.

    One matrix product gives the distances to the centres of all models, less a term that is
    the same for all.  Where it cannot tell which centre is nearest, ``_distances`` does, so both
    results are as by these.
    """
    across = np.concatenate([rows.T, np.ones((1, len(rows)))])
    squares = (rows**2).sum(axis=1)
    every = np.concatenate(models)
    lengths = (every**2).sum(axis=1)
    with np.errstate(invalid="ignore", over="ignore"):
        # |x - c|² less |x|²
        far = np.concatenate([-2 * every, lengths[:, None]], axis=1) @ across
        at = 0
        for model in models:
            here = slice(at, at := at + len(model))
            reach = ROUNDING * (squares + 2 * lengths[here].max())
            near = (far[here] <= far[here].min(axis=0) + reach).astype(np.float64)
            # How many may be it, and if it is one, which.
            number, which = np.stack([np.ones(len(model)), np.arange(len(model))]) @ near
            own = which.astype(np.intp)
            unsure = np.flatnonzero(number != 1)
            if len(unsure):
                own[unsure] = _distances(rows[unsure], model).argmin(axis=1)
            distance = np.zeros(len(rows))
            for x, c in zip(across, model.T):
                distance += (x - c[own]) ** 2
            yield own, distance


def _sums(points: DataFrame, models: list[np.ndarray], features: int) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Per model the rows nearest to each centre, their sums, and the cost: one job for all."""
    sizes = [len(m) for m in models]
    first = np.concatenate([[0], np.cumsum(sizes)])

    def add(batches):
        total = np.zeros((int(first[-1]), features + 2))
        for _, rows in _batches(batches, features):
            for model, at, (own, distances) in zip(models, first, _placed(rows, models)):
                here = slice(int(at), int(at) + len(model))
                for j, values in enumerate([*rows.T, None, distances]):
                    total[here, j] += np.bincount(own, weights=values, minlength=len(model))
        used = np.flatnonzero(total[:, features])
        yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(c) for c in total[used].T]], names=names)

    names = ["centre", *[f"s{i}" for i in range(features)], "n", "cost"]
    schema = "centre long, " + ", ".join(f"{n} double" for n in names[1:])
    found = points.mapInArrow(add, schema)
    # As many rows come back as there are centres, or, of few tasks, from each: that saves a shuffle.
    if points.rdd.getNumPartitions() > FEW_TASKS:
        found = found.groupBy("centre").agg(*[F.sum(n).alias(n) for n in names[1:]])
    total = np.zeros((int(first[-1]), features + 2))
    for r in found.collect():
        total[r["centre"]] += [r[n] for n in names[1:]]
    return [(t[:, features], t[:, :features], float(t[:, features + 1].sum())) for t in (total[a:b] for a, b in zip(first, first[1:]))]


def _seeded(candidates: np.ndarray, weights: np.ndarray, k: int, random: np.random.Generator) -> np.ndarray:
    """``k`` of a start's weighted candidates, spread out, and moved among the candidates."""
    keep = weights > 0
    candidates, weights = candidates[keep], weights[keep]
    centers = candidates[[int(random.choice(len(candidates), p=weights / weights.sum()))]]
    while len(centers) < k:
        mass = weights * _distances(candidates, centers).min(axis=1)
        if not mass.sum():
            break  # fewer distinct rows than centres
        tries = candidates[random.choice(len(candidates), size=4, p=mass / mass.sum())]
        left = [float((weights * _distances(candidates, np.concatenate([centers, t[None]])).min(axis=1)).sum()) for t in tries]
        centers = np.concatenate([centers, tries[int(np.argmin(left))][None]])
    for _ in range(20):
        own = _distances(candidates, centers).argmin(axis=1)
        moved = centers.copy()
        for c in range(len(centers)):
            if weights[own == c].sum():
                moved[c] = np.average(candidates[own == c], axis=0, weights=weights[own == c])
        if np.array_equal(moved, centers):
            break
        centers = moved
    return centers


def best_models(
    points: DataFrame,
    ks: Sequence[int],
    seed: int,
    restarts: int,
    features: Sequence[str] = RFM_FEATURES,
    max_iterations: int = MAX_ITERATIONS,
    tolerance: float = TOLERANCE,
) -> dict[int, Segmentation]:
    """For each k the model of lowest cost among ``restarts`` starts.

    All models of all k and starts advance together: an iteration is one pass over the rows
    whose tasks return a sum per centre, whatever the number of starts.  Every start draws its
    candidates by distance, ROUNDS times, then weighs them, and each k begins from these.  A
    model is done when its centres' squared movement is below ``tolerance`` of the mean
    variance; those of a k that cost at most CLOSE more than its best then go on until hardly
    anything moves.  One that stops at
    ``max_iterations`` is warned about.
    """
    size = len(features)
    chosen = _draw(points, [np.zeros((0, size)) for _ in range(restarts)], seed, 1, size)
    if not chosen or not len(chosen[0]):
        raise ValueError("there are no rows to cluster")
    for turn in range(1, ROUNDS + 1):
        chosen = _draw(points, chosen, seed + turn, 2 * max(ks), size)
    weighed = _sums(points, chosen, size)
    random = np.random.default_rng(seed)
    models = {
        (k, start): _seeded(chosen[start], weighed[start][0], k, random) for k in ks for start in range(restarts)
    }
    total, sums, _ = _sums(points, [np.zeros((1, size))], size)[0]
    spread = _sums(points, [sums / total[:, None]], size)[0][2]
    limit = tolerance * spread / max(float(total[0]) - 1, 1.0) / size

    costs, steps = _advance(points, models, limit, max_iterations, size)
    least = {k: min(costs[k, s] for s in range(restarts)) for k in ks}
    final = {(k, s): m for (k, s), m in models.items() if costs[k, s] <= (1 + CLOSE) * least[k]}
    last, more = _advance(points, final, limit * FINE, max_iterations, size)
    out = {}
    for k in ks:
        s = min((last[name], name[1]) for name in final if name[0] == k)[1]
        if more[k, s] >= max_iterations:
            warnings.warn(f"{k} segments: no convergence in {max_iterations} iterations", stacklevel=2)
        out[k] = Segmentation(final[k, s], last[k, s], steps[k, s] + more[k, s], tuple(features))
    return out


def _advance(points: DataFrame, models: dict, limit: float, most: int, features: int) -> tuple[dict, dict]:
    """Moves all ``models`` (changed in place) until each moves by ``limit`` at most; their
    costs and iterations."""
    live, costs, steps = set(models), {}, dict.fromkeys(models, 0)
    for number in range(1, most + 1):
        names = sorted(live)
        if not names:
            break
        for name, (n, sums, cost) in zip(names, _sums(points, [models[m] for m in names], features)):
            # A centre without rows stays where it is.
            moved = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], models[name])
            shift = float(((moved - models[name]) ** 2).sum())
            costs[name], steps[name] = cost, number
            if shift <= limit:
                live.discard(name)
            if shift > 0:
                models[name] = moved
    return costs, steps


def fit_segments(
    rows: DataFrame,
    k: int = SEGMENT_COUNT,
    features: Sequence[str] = RFM_FEATURES,
    seed: int = SEGMENT_SEED,
    restarts: int = SEGMENT_RESTARTS,
    id_column: str = "user_id",
) -> tuple[DataFrame, Segmentation]:
    """Rows with ``segment`` (0 to k-1) and the model, the best of ``restarts`` K-Means.

    The rows are written first, as they are read to fit and again to be placed.
    """
    rows = materialize(rows, "to-segment")
    with _kept(_points(rows, features, id_column), features) as points:
        model = best_models(points, [k], seed, restarts, features)[k]
    return rows.withColumn("segment", model.nearest()), model


@contextmanager
def _kept(rows: DataFrame, features: Sequence[str]) -> Iterator[DataFrame]:
    """Iterations read the points dozens of times: a narrow copy of them is written, and its
    blocks are kept while fitting.  If it has more than ROWS_A_TASK rows a task, they are dealt
    evenly to TASKS_A_CORE tasks of each core or more, of so many rows at least.  A lost executor
    costs a re-read.

    A missing feature is an error, as there is no distance to it.
    """
    narrow = materialize(rows, "points")
    tasks = TASKS_A_CORE * rows.sparkSession.sparkContext.defaultParallelism
    rows_now, tasks_now = narrow.count(), narrow.rdd.getNumPartitions()
    if rows_now > ROWS_A_TASK * tasks_now:
        narrow = narrow.repartition(min(max(tasks, tasks_now), math.ceil(rows_now / ROWS_A_TASK)))
    kept = _packed(narrow, len(features)).persist()
    try:
        # Over all rows, so that one job keeps every block, spread over the executors.
        if kept.agg(F.max("_missing")).first()[0]:
            raise ValueError(f"rows with a missing feature cannot be clustered: {', '.join(features)}")
        yield kept
    finally:
        kept.unpersist()


def k_sweep(
    rows: DataFrame,
    ks: Sequence[int] = SEGMENT_SWEEP,
    features: Sequence[str] = RFM_FEATURES,
    seed: int = SEGMENT_SEED,
    restarts: int = SEGMENT_RESTARTS,
    partners: int = SILHOUETTE_PARTNERS,
    id_column: str = "user_id",
) -> DataFrame:
    """``k, inertia, silhouette_squared, silhouette_score, silhouette_error`` for each k.

    All are over all rows.  The silhouette of squared distances is exact; the Euclidean one is
    exact for segments of up to ``partners`` rows and else an estimate with the standard error
    that is given, see ``silhouettes``.
    """
    with _kept(_points(rows, features, id_column), features) as points:
        models = best_models(points, ks, seed, restarts, features)
        scores = silhouettes(points, {k: m.centers for k, m in models.items()}, seed, partners)
    inertia = [(k, float(m.cost), *scores[k]) for k, m in models.items()]
    found = rows.sparkSession.createDataFrame(
        inertia, "k int, inertia double, silhouette_squared double, silhouette_score double, silhouette_error double"
    )
    return found.select(
        "k", half_even(F.col("inertia"), 2).alias("inertia"),
        *[half_even(F.col(c), 4).alias(c) for c in ("silhouette_squared", "silhouette_score", "silhouette_error")],
    ).orderBy("k")


def silhouettes(
    points: DataFrame, models: Mapping[int, np.ndarray], seed: int = SEGMENT_SEED, partners: int = SILHOUETTE_PARTNERS
) -> dict[int, tuple[float | None, float | None, float | None]]:
    """Per model the mean silhouette of all rows: by squared distances, by Euclidean ones, and
    the standard error of the latter.  ``points`` are as ``_points`` or ``_packed`` makes them;
    a row belongs to its nearest centre.

    Squared distances follow from a segment's size, sum and sum of squares.  For Euclidean ones
    every segment is represented by ``partners`` of its rows, those with the smallest draws, in
    REPLICATES groups; each row is compared with them and with no other row, so the cost is
    linear.  The error is that of the mean over the groups, without the part that is known: it
    is zero, and the silhouette exact, if all rows are partners.  Three passes serve all models;
    what comes to the driver is a sum per segment, and ``partners`` rows of each.
    """
    names = sorted(models)
    size = models[names[0]].shape[1]
    first = np.concatenate([[0], np.cumsum([len(models[k]) for k in names])])

    def sample(batches):
        best: dict[int, list] = {}
        sums = np.zeros((int(first[-1]), size + 2))
        for hashes, rows in _batches(batches, size):
            drawn = _uniform(hashes, 0, seed)
            wide = np.concatenate([rows, (rows**2).sum(axis=1)[:, None], np.ones((len(rows), 1))], axis=1)
            for k, at in zip(names, first):
                own = _distances(rows, models[k]).argmin(axis=1)
                for j, values in enumerate(wide.T):
                    sums[int(at) : int(at) + len(models[k]), j] += np.bincount(own, weights=values, minlength=len(models[k]))
                for c in np.unique(own):
                    mine = np.flatnonzero(own == c)
                    if len(best.get(at + c, [])) == partners:
                        mine = mine[drawn[mine] <= best[at + c][-1][0]]
                    mine = mine[np.argsort(drawn[mine], kind="stable")[:partners]]
                    found = best.get(at + c, []) + [(float(drawn[i]), int(hashes[i].view(np.int64)), rows[i].tolist()) for i in mine]
                    best[at + c] = sorted(found)[:partners]
        out = [(int(c), d, h, x, None) for c, found in best.items() for d, h, x in found]
        out += [(int(c), None, None, None, sums[c].tolist()) for c in np.flatnonzero(sums[:, size + 1])]
        if out:
            types = [pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), types)], names=["c", "draw", "h", "x", "sums"])

    drawn = materialize(points.mapInArrow(sample, "c long, draw double, h long, x array<double>, sums array<double>"), "partners")
    order = Window.partitionBy("c").orderBy("draw", "h", "x")
    chosen = drawn.where("draw is not null").withColumn("n", F.row_number().over(order)).where(F.col("n") <= partners).collect()
    totals = np.zeros((int(first[-1]), size + 2))
    added = drawn.where("sums is not null").groupBy("c").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(size + 2)])
    for r in added.collect():
        totals[r["c"]] = [r[f"s{i}"] for i in range(size + 2)]
    partner_rows: list[tuple[np.ndarray, np.ndarray]] = []
    for c in range(int(first[-1])):
        own = sorted((r["n"], r["h"], r["x"]) for r in chosen if r["c"] == c)
        partner_rows.append((np.array([h for _, h, _ in own], np.int64), np.array([x for _, _, x in own]).reshape(-1, size)))

    def score(batches):
        out = np.zeros((len(names), REPLICATES + 2))
        for hashes, rows in _batches(batches, size):
            for i, (k, at) in enumerate(zip(names, first)):
                own = _distances(rows, models[k]).argmin(axis=1)
                here = slice(int(at), int(first[i + 1]))
                out[i, 0] += _squared_silhouettes(rows, own, totals[here]).sum()
                out[i, 1:] += _sampled_silhouettes(rows, hashes.view(np.int64), own, partner_rows[here], totals[here][:, -1])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), *[pa.array(c) for c in out.T]], names=["k", *columns])

    columns = [f"s{i}" for i in range(REPLICATES + 2)]
    scored = points.mapInArrow(score, "k long, " + ", ".join(f"{c} double" for c in columns)).groupBy("k").agg(*[F.sum(c).alias(c) for c in columns])
    found: dict[int, tuple] = {}
    by_k = {r["k"]: [r[c] for c in columns] for r in scored.collect()}
    for i, k in enumerate(names):
        sizes = totals[int(first[i]) : int(first[i + 1]), -1]
        if (sizes > 0).sum() < 2:
            found[k] = (None, None, None)
            continue
        rows = float(sizes.sum())
        squared, whole, *groups = [float(x) / rows for x in by_k[k]]
        known = float(np.minimum(partners / np.maximum(sizes[sizes > 0], 1), 1).min())
        error = math.sqrt(float(np.var(groups, ddof=1)) / REPLICATES * (1 - known))
        found[k] = (squared, whole, error)
    return found


def _squared_silhouettes(rows: np.ndarray, own: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """``totals``: a segment's sums, sum of squares, and size."""
    size = rows.shape[1]
    n = np.maximum(totals[:, -1], 1)
    far = (rows**2).sum(axis=1)[:, None] + (totals[:, size] - 2 * rows @ totals[:, :size].T) / n
    far[:, totals[:, -1] == 0] = np.inf
    at = (np.arange(len(rows)), own)
    inside = far[at] * n[own] / np.maximum(n[own] - 1, 1)
    return _silhouette(inside, far, own, n)


def _silhouette(inside: np.ndarray, far: np.ndarray, own: np.ndarray, n: np.ndarray) -> np.ndarray:
    """From the mean distance to the row's own segment and to all; 0 for a row by itself."""
    others = far.copy()
    others[np.arange(len(own)), own] = np.inf
    outside = others.min(axis=1)
    widest = np.maximum(inside, outside)
    alone = (n[own] <= 1) | (widest <= 0)
    with np.errstate(invalid="ignore"):
        return np.where(alone, 0.0, (outside - inside) / np.where(widest <= 0, 1.0, widest))


def _far(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distances, rows by points."""
    out, part = np.zeros((len(rows), len(points))), np.empty((len(rows), len(points)))
    for x, c in zip(rows.T, points.T):
        np.subtract(x[:, None], c[None, :], out=part)
        np.multiply(part, part, out=part)
        np.add(out, part, out=out)
    return np.sqrt(out, out=out)


def _sampled_silhouettes(
    rows: np.ndarray, hashes: np.ndarray, own: np.ndarray, partners: list[tuple[np.ndarray, np.ndarray]], sizes: np.ndarray
) -> np.ndarray:
    """Sums of silhouettes: with all partners, then with each of their groups alone."""
    out = np.zeros(REPLICATES + 1)
    sums = np.zeros((REPLICATES, len(rows), len(partners)))
    counts = np.zeros((REPLICATES, len(rows), len(partners)))
    for c, (ids, points) in enumerate(partners):
        if not len(points):
            continue
        groups = np.equal.outer(np.arange(len(points)) % REPLICATES, np.arange(REPLICATES)).astype(np.float64)
        counts[:, :, c] = groups.sum(axis=0)[:, None]
        # Few rows at a time, so that their distances stay in the processor's cache.
        for first in range(0, len(rows), NARROW_SLAB):
            some = slice(first, first + NARROW_SLAB)
            sums[:, some, c] = (_far(rows[some], points) @ groups).T
        # A row is no partner of itself: it is at distance 0, and not counted.
        for i in np.flatnonzero(np.isin(hashes, ids)):
            itself = (ids == hashes[i]) & (points == rows[i]).all(axis=1)
            counts[:, i, c] -= groups[itself].sum(axis=0)
    at = np.arange(len(rows))

    def mean(total: np.ndarray, count: np.ndarray) -> float:
        far = np.where(count > 0, total / np.maximum(count, 1), np.inf)
        inside = np.where(np.isfinite(far[at, own]), far[at, own], 0.0)
        return float(_silhouette(inside, far, own, sizes).sum())

    out[0] = mean(sums.sum(axis=0), counts.sum(axis=0))
    for g in range(REPLICATES):
        out[g + 1] = mean(sums[g], counts[g])
    return out


def squared_silhouette(rows: DataFrame, features: Sequence[str] = RFM_FEATURES) -> DataFrame:
    """One row, ``silhouette_squared``: the mean silhouette by squared distance, over all rows.

    The mean squared distance of a point to a segment follows from the segment's size, sum and
    sum of squares, so a row is compared with as many sums as there are segments, and with
    no other row.  NULL with one segment; a row alone in its segment counts 0.
    """
    points = [F.col(scaled(f)) for f in features]
    squares = reduce(lambda a, b: a + b, [p * p for p in points])
    sums = rows.groupBy("segment").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(p) for p in points]).alias("s"),
        F.sum(squares).alias("q"),
    )
    # One entry per segment.
    entries = sums.agg(F.array_sort(F.collect_list(F.struct("segment", "n", "s", "q"))))

    def mean_distance(entry: Column) -> Column:
        dot = reduce(lambda a, b: a + b, [p * entry["s"][i] for i, p in enumerate(points)])
        return squares + (entry["q"] - dot * 2) / entry["n"]

    own = F.filter("_all", lambda e: e["segment"] == F.col("segment"))[0]
    with_own = (
        rows.select("segment", *[scaled(f) for f in features])
        .withColumn("_all", entries.scalar())
        .withColumn("_own", own)
        .withColumn("_a", F.try_divide(mean_distance(F.col("_own")) * F.col("_own.n"), F.col("_own.n") - 1))
        .withColumn(
            "_b",
            F.array_min(
                F.transform(F.filter("_all", lambda e: e["segment"] != F.col("segment")), mean_distance)
            ),
        )
    )
    widest = F.greatest("_a", "_b")
    value = F.when(F.col("_own.n") == 1, 0.0).otherwise(F.coalesce(F.try_divide(F.col("_b") - F.col("_a"), widest), F.lit(0.0)))
    return with_own.agg(half_even(F.avg(F.when(F.col("_b").isNotNull(), value)), 4).alias("silhouette_squared"))


def check_fit(
    fitted: DataFrame, model: Segmentation, features: Sequence[str] = RFM_FEATURES
) -> DataFrame:
    """One row: ``customers, revenue, segments, misplaced``.

    ``misplaced`` counts rows that are nearer to another centre than to their own.
    """
    distances = F.array(*[_distance(features, c) for c in model.centers.tolist()])
    # As far as doubles can tell.
    nearer = F.array_min(distances) < F.get(distances, F.col("segment")) * (1 - 1e-9)
    return fitted.agg(
        F.count(F.lit(1)).alias("customers"),
        exact_sum(fitted, "monetary_value").cast("double").alias("revenue"),
        F.count_distinct("segment").alias("segments"),
        F.count_if(nearer).alias("misplaced"),
    )


def exact_mean(rows: DataFrame, column: str) -> Column:
    return F.try_divide(exact_sum(rows, column).cast("double"), F.count(column))


def segment_profiles(rows: DataFrame, id_column: str = "user_id") -> DataFrame:
    """``segment, recency, frequency, monetary, count``: means to one decimal, and size."""
    def mean(column: str, name: str) -> Column:
        return half_even(F.avg(column), 1).alias(name)

    return rows.groupBy("segment").agg(
        mean("recency_days", "recency"),
        mean("frequency", "frequency"),
        half_even(exact_mean(rows, "monetary_value"), 1).alias("monetary"),
        F.count(id_column).alias("count"),
    )


def label_segments(profiles: DataFrame) -> DataFrame:
    """Adds ``label`` by comparing each profile with the median over the profiles.

    Recent means strictly below the median recency, high spend at or above the median
    spend.  Labels may repeat.
    """
    among_segments = Window.partitionBy()  # one row per segment
    recent = F.col("recency") < F.percentile("recency", F.lit(0.5)).over(among_segments)
    spends = F.col("monetary") >= F.percentile("monetary", F.lit(0.5)).over(among_segments)
    return (
        profiles.withColumns({"_recent": recent, "_spends": spends})
        .withColumn(
            "label",
            F.when(F.col("_recent") & F.col("_spends"), LABEL_CHAMPIONS)
            .when(F.col("_recent"), LABEL_PROMISING)
            .when(F.col("_spends"), LABEL_AT_RISK)
            .otherwise(LABEL_LOST),
        )
        .drop("_recent", "_spends")
    )


def attach_labels(rows: DataFrame, labelled: DataFrame) -> DataFrame:
    """Adds each row's segment label.  ``labelled`` has one row per segment.

    They are counted first, and broadcast unless there are more than BROADCAST_SEGMENTS.
    """
    labels = labelled.select("segment", "label")
    if labels.limit(BROADCAST_SEGMENTS + 1).count() <= BROADCAST_SEGMENTS:
        labels = F.broadcast(labels)
    return rows.join(labels, "segment", "left")


def revenue_at_stake(labelled_rows: DataFrame) -> DataFrame:
    """``segment, total_revenue, pct`` per label, largest first."""
    overall = Window.partitionBy()  # one row per label
    return (
        labelled_rows.groupBy(F.col("label").alias("segment"))
        .agg(
            exact_sum(labelled_rows, "monetary_value").cast("double").alias("total_revenue")
        )
        .withColumn(
            "pct", half_even(percent(F.col("total_revenue"), F.sum("total_revenue").over(overall)), 1)
        )
        .orderBy(F.desc("total_revenue"), "segment")
    )


def segment_kpis(labelled_rows: DataFrame) -> DataFrame:
    """One row: ``customers, segments, avg_spend, avg_recency``."""
    return labelled_rows.agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_distinct("segment").alias("segments"),
        exact_mean(labelled_rows, "monetary_value").alias("avg_spend"),
        F.avg("recency_days").alias("avg_recency"),
    )


def segment_sample(
    rows: DataFrame, n: int = SEGMENT_SAMPLE, seed: int = SEGMENT_SEED, id_column: str = "user_id"
) -> DataFrame:
    """A reproducible sample of ``n`` rows, or all if fewer.

    The order of a seeded digest is random yet independent of partitioning; each task keeps
    its own first ``n``.
    """
    return rows.orderBy(F.md5(F.concat_ws("-", F.col(id_column), F.lit(seed))), id_column).limit(n)


def segment_actions(labelled: DataFrame) -> DataFrame:
    """Adds the recommended ``action`` for each row's label."""
    action = reduce(
        lambda rest, item: F.when(F.col("label") == item[0], item[1]).otherwise(rest),
        SEGMENT_ACTIONS.items(),
        F.lit(None).cast("string"),
    )
    return labelled.withColumn("action", action)
