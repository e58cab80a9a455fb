from datetime import datetime, timedelta

import numpy as np
import pytest

from denspark import MAX_DIMS, MIN_DIMS, SparkDBSCAN, dbscan
from denspark.operators.points import from_array
from denspark.plans.cluster import cluster
from denspark.queries import EVENTS, QUERIES


def brute(x: np.ndarray, eps: float, least: int):
    """The definition, row by row."""
    n = len(x)
    d2 = np.zeros((n, n))
    for i in range(x.shape[1]):
        d2 += (x[:, None, i] - x[None, :, i]) ** 2
    near = d2 <= eps * eps
    core = near.sum(axis=1) >= least
    root = np.arange(n)
    for _ in range(n):
        new = np.array([min(root[j] for j in np.flatnonzero(near[i] & core)) if core[i] else root[i] for i in range(n)])
        if (new == root).all():
            break
        root = new
    cell = np.floor((x - x.min(axis=0)) / (eps / np.sqrt(x.shape[1]))).astype(int)
    greatest = {}
    for i in np.flatnonzero(core):
        greatest[root[i]] = max(greatest.get(root[i], (-1,)), tuple(cell[i]))
    number = {r: k for k, r in enumerate(sorted(greatest, key=greatest.__getitem__))}
    label = np.full(n, -1)
    for i in range(n):
        if core[i]:
            label[i] = number[root[i]]
        else:
            js = np.flatnonzero(near[i] & core)
            if len(js):
                label[i] = number[root[min(js, key=lambda j: (d2[i, j], j))]]
    return label, core


def run(spark, x, eps, least, **more):
    rows = sorted(cluster(from_array(spark, np.array(x, float)), eps, least, **more).collect())
    return [r.label for r in rows], [r.is_core for r in rows]


SMALL = [(0, 2), (1, 3), (1.5, 2.5), (2.5, 1.5), (4, 0)]


@pytest.mark.parametrize(
    ("eps", "label", "core"),
    [(1.42, [0, 0, 0, 0, -1], [False, True, True, False, False]), (5.7, [0] * 5, [True] * 5), (0.7, [-1] * 5, [False] * 5)],
)
def test_five_points(spark, eps, label, core):
    assert run(spark, SMALL, eps, 3) == (label, core)


def test_three_dimensions_exact_and_by_centre_radius(spark):
    x = [(0, 0, 0), (0.9, 0.9, 0.5), (2.1, 2.1, 0.5)]
    assert run(spark, x, 1.74, 3) == ([0, 0, 0], [False, True, False])
    assert run(spark, x, 1.74, 3, neighbor_rule="centre_radius") == ([-1] * 3, [False] * 3)


def test_tie_goes_to_the_lesser_core_id(spark):
    x = [(0, 0), (1, 0), (1.5, 0), (1.5, 0.5), (1.5, -0.5), (-1, 0), (-1.5, 0), (-1.5, 0.5), (-1.5, -0.5)]
    assert run(spark, x, 1, 4) == ([1, 1, 1, 1, 1, 0, 0, 0, 0], [False] + [True] * 8)


@pytest.mark.parametrize(("seed", "dim", "eps", "least"), [(1, 2, 0.4, 4), (2, 3, 0.7, 5), (3, 4, 0.9, 4)])
def test_random_against_brute_force(spark, seed, dim, eps, least):
    random = np.random.default_rng(seed)
    x = np.concatenate([random.normal(m, 0.35, (25, dim)) for m in (-1, 0.5, 1.5)] + [random.uniform(-3, 3, (20, dim))])
    x = np.concatenate([x, x[:6]])  # equal points count
    label, core = run(spark, x, eps, least)
    want_label, want_core = brute(x, eps, least)
    assert label == want_label.tolist()
    assert core == want_core.tolist()


def test_single_and_identical_points(spark):
    assert run(spark, [(1, 1)], 1, 1) == ([0], [True])
    assert run(spark, [(1, 1)], 1, 2) == ([-1], [False])
    assert run(spark, [(1, 1)] * 4, 1, 4) == ([0] * 4, [True] * 4)


def test_empty(spark):
    empty = spark.createDataFrame([], "id long, x double, y double")
    assert dbscan(empty, ["x", "y"]).count() == 0


@pytest.mark.parametrize(("eps", "least"), [(0, 5), (-1, 5), (float("nan"), 5), (1, 0)])
def test_bad_parameters(spark, eps, least):
    with pytest.raises(ValueError):
        dbscan(spark.createDataFrame([(1, 1.0, 1.0)], "id long, x double, y double"), ["x", "y"], eps, least)


@pytest.mark.parametrize("bad", [None, float("nan"), float("inf")])
def test_bad_coordinates(spark, bad):
    with pytest.raises(ValueError):
        dbscan(spark.createDataFrame([(1, 1.0, bad)], "id long, x double, y double"), ["x", "y"])


def test_fractional_ids_are_refused(spark):
    with pytest.raises(ValueError):
        dbscan(spark.createDataFrame([(1.5, 1.0, 2.0), (1.25, 1.0, 2.0)], "id double, x double, y double"), ["x", "y"])


def test_dimensions(spark):
    frame = spark.createDataFrame([(1, 1.0)], "id long, x double")
    with pytest.raises(ValueError):
        dbscan(frame, ["x"])
    assert (MIN_DIMS, MAX_DIMS) == (2, 20)


@pytest.mark.parametrize("bad", [{"metric": "cosine"}, {"algorithm": "brute"}, {"leaf_size": 10}, {"p": 1}, {"n_jobs": 2}])
def test_estimator_refuses(bad):
    with pytest.raises(NotImplementedError):
        SparkDBSCAN(**bad)


def test_estimator(spark):
    frame = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(SMALL)], "id long, x double, y double")
    model = SparkDBSCAN(eps=1.42, min_samples=3).fit(frame)
    assert sorted(r.label for r in model.labels_.collect()) == [-1, 0, 0, 0, 0]
    assert sorted(r.id for r in model.core_sample_indices_.collect()) == [1, 2]
    assert model.components_.columns == ["x", "y"] == model.feature_names_in_
    assert model.set_params(eps=2.0).get_params()["eps"] == 2.0
    with pytest.raises(NotImplementedError):
        model.fit_predict(frame, sample_weight=[1])


def test_events_are_read_whole(spark, tmp_path):
    r = np.random.default_rng(8)
    hours, value = np.round(np.append(r.uniform(0, 12, 300), r.normal(6, 0.4, 100)), 3), np.round(np.append(r.uniform(0, 120, 300), r.normal(60, 4, 100)), 2)
    rows = [(2800 + i, datetime(2024, 1, 1) + timedelta(milliseconds=round(float(h) * 3600000)), float(v)) for i, (h, v) in enumerate(zip(hours, value, strict=True))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, value double").write.parquet(f"{tmp_path}/events.parquet")
    x = np.stack([hours, value / 10], axis=1)
    label, core = brute(x, EVENTS.eps, EVENTS.least)
    found = sorted(QUERIES["dbscan_events"](spark, str(tmp_path)).collect())
    assert [(q.id, q.label, q.is_core) for q in found] == [(2800 + i, a, b) for i, (a, b) in enumerate(zip(label.tolist(), core.tolist(), strict=True))]
    assert 0 < core.sum() < len(x)
    cells, n = np.unique(np.floor((x - x.min(axis=0)) / (EVENTS.eps / np.sqrt(2))).astype(int), axis=0, return_counts=True)
    dense = QUERIES["dense_cells"](spark, str(tmp_path)).collect()
    assert sorted((q.k0, q.k1, q.n) for q in dense) == [(*c, m) for c, m in zip(cells.tolist(), n.tolist(), strict=True) if m >= EVENTS.least]
    assert dense


def test_estimator_with_an_array_column(spark):
    rows = [(i, [float(a), float(b), 0.0]) for i, (a, b) in enumerate(SMALL)]
    model = SparkDBSCAN(eps=1.42, min_samples=3).fit(spark.createDataFrame(rows, "id long, x array<double>"))
    assert sorted(r.label for r in model.labels_.collect()) == [-1, 0, 0, 0, 0] and model.n_features_in_ == 3
    assert sorted(r.x for r in model.components_.collect()) == [[1.0, 3.0, 0.0], [1.5, 2.5, 0.0]]
    wide = [(i, [float(i // 5)] * 24) for i in range(10)]
    found = SparkDBSCAN(eps=0.5, min_samples=5).fit_predict(spark.createDataFrame(wide, "id long, x array<double>"), features="x", dim=24, max_dims=24)
    assert sorted((r.id, r.label) for r in found.collect()) == [(i, i // 5) for i in range(10)]


def test_blobs_standardised(spark):
    """750 points around three centres, eps 0.3 and ten samples: three clusters and little noise."""
    random = np.random.default_rng(0)
    truth = np.arange(750) % 3
    x = np.array([(1, 1), (-1, -1), (1, -1)])[truth] + random.normal(scale=0.4, size=(750, 2))
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    label, core = run(spark, x, 0.3, 10)
    want_label, want_core = brute(x, 0.3, 10)
    assert label == want_label.tolist() and core == want_core.tolist()
    label = np.array(label)
    assert set(label) == {-1, 0, 1, 2} and (label < 0).sum() < 60


def test_stages_are_timed(spark):
    from denspark.plans.cluster import Stages

    stages = Stages(from_array(spark, np.array(SMALL, float)), 1.42, 3)
    assert stages.labels.count() == 5 and {"places", "core", "components"} <= set(stages.seconds) and min(stages.seconds.values()) >= 0


@pytest.mark.parametrize(("a", "b", "apart"), [((0, 0, 2, 0), (4.5, 0, 4.5, 0), True), ((0, 0, 2, 0), (4.4, 0, 4.4, 0), True), ((0, 0, 2, 0), (3.9, 0, 3.9, 0), False), ((0, 0, 2, 0), (3.5, 0, 5.5, 0), False), ((0, 0, 2, 0), (6, 0, 8, 0), True)])
def test_well_separated(spark, a, b, apart):
    from pyspark.sql import functions as F

    from denspark.operators.boxes import well_separated

    box = lambda x: F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("l0", "l1", "h0", "h1"), x)])
    assert spark.range(1).select(box(a).alias("a"), box(b).alias("b")).select(well_separated(2).alias("x")).first().x is apart
