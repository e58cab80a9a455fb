import numpy as np
import pytest

from denspark.operators import components, grid, neighbors, scans
from denspark.operators.points import extent, from_array


@pytest.mark.parametrize(("n", "side", "cells"), [(1, 1.0, 1), (2, 1.0, 1), (2, 0.5, 2), (3, 1, 2), (3, 0.5, 3), (4, 0.5, 4), (4, 1, 3), (4, 2.01, 1)])
def test_cells(spark, n, side, cells):
    points = from_array(spark, np.array([(0, 0), (0.5, 0), (0, 1.5), (2, 0)], float)[:n])
    assert grid.cells(grid.with_cells(points, (0.0, 0.0), side)).count() == cells


def test_neighbourhood(spark):
    points = from_array(spark, np.array([(0, 0), (2.5, 2.5), (2.5, 3.5), (2.5, 4.5), (3.5, 3.5), (3.5, 3.5)], float))
    celled = grid.with_cells(points, (0.0, 0.0), 1.0)
    assert grid.cells(celled).count() == 5
    near = grid.neighbour_cells(grid.cells(celled), 2).where("k0 = 2 and k1 = 2")
    assert near.count() == 4
    assert grid.neighbour_points(celled).where("k0 = 2 and k1 = 2").count() == 5


@pytest.mark.parametrize("one_task", [0, 1 << 18])
def test_components_both_ways(spark, monkeypatch, one_task):
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    links = [(i, i + 1) for i in range(30)] + [(40, 41), (42, 41), (50, 50), (None, 3), (2, 1)]
    found = {r.vertex: r.label for r in components.least_reachable(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(31)} | {40: 40, 41: 40, 42: 40}
    assert components.least_reachable(spark.createDataFrame([], "a long, b long")).count() == 0


def test_spanning_forest(spark):
    links = [(a, b) for a in range(6) for b in range(a)] + [(10, 11), (11, 12), (10, 12)]
    assert components.spanning_forest(spark.createDataFrame(links, "a long, b long")).count() == 5 + 2


def test_knn_finds_far_ones(spark):
    points = from_array(spark, np.array([(0, 0), (1, 0), (100, 0), (101, 0), (0, 500)], float))
    near = {(r.id, r["rank"]): r.near for r in neighbors.knn(points, points, 3).collect()}
    assert near[0, 2] == 1 and near[2, 2] == 3 and near[4, 1] == 4 and len(near) == 15


@pytest.mark.parametrize("all_pairs", [0, 1 << 24])
def test_knn_with_an_outlier_and_a_heap(spark, monkeypatch, all_pairs):
    monkeypatch.setattr(neighbors, "ALL_PAIRS", all_pairs)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.random((600, 2)), np.full((60, 2), 0.25), [[2e3, 2e3]]])
    points = from_array(spark, x)
    radius = neighbors.first_radius(points, extent(points), 4)
    assert radius < 0.5  # of a mass that is 1 wide
    assert neighbors.eps_pairs(points, extent(points), radius).count() < len(x) ** 2 / 4
    found = sorted((r.id, r["rank"], r.near) for r in neighbors.knn(points, points, 4).collect())
    d2 = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    want = [(i, k + 1, int(j)) for i in range(len(x)) for k, j in enumerate(np.lexsort((np.arange(len(x)), d2[i]))[:4])]
    assert found == want


def test_first_radius_of_one_place(spark):
    points = from_array(spark, np.ones((50, 3)))
    assert 0 < neighbors.first_radius(points, extent(points), 2) <= 1
    assert neighbors.knn(points, points, 2).count() == 100


def test_eps_pairs_any_dimension(spark):
    x = np.random.default_rng(5).uniform(-1, 1, (60, 6))
    points = from_array(spark, x)
    got = {(r.a, r.b) for r in neighbors.eps_pairs(points, extent(points), 0.8).collect()}
    d2 = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert got == set(zip(*map(list, np.nonzero(d2 <= 0.64)), strict=True))


def test_scans_cross_ranges(spark):
    rows = spark.createDataFrame([(i, i % 7) for i in range(200)], "id long, v long")
    want = np.cumsum([i % 7 for i in range(200)])
    got = sorted(scans.scan(rows, "v", "id", "x", inclusive=True).collect())
    assert [r.x for r in got] == want.tolist()


def test_extremes_of_named_rows(spark):
    frame = spark.createDataFrame([("d", 2), ("b", 5), ("c", 5), ("a", 1)], "name string, v long")
    assert scans.arg_max(frame, "v", "name").first()[0] == "b"
    assert scans.arg_max(frame, "v", "name", last=True).first()[0] == "c"
    assert scans.arg_min(frame, "v", "name").first()[0] == "a"
