"""Queries against DuckDB on points of which many are equal."""

from dataclasses import replace

import duckdb
import numpy as np
import pytest

from denspark import queries
from denspark.operators import neighbors
from denspark.operators.points import extent, from_array

STAGES = ["core_points", "core_cells", "core_closest_pairs", "core_labels", "border_labels", "nearest_core", "components", "noise_points", "core_components"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Tables of 60 and 40 different points, some of them two to nine times, with ids in no order."""
    rng = np.random.default_rng(11)
    out = str(tmp_path_factory.mktemp("copies"))
    at = np.concatenate([np.arange(60), rng.integers(0, 60, 60), np.full(7, 3)])
    rng.shuffle(at)
    ids = rng.permutation(len(at)) + 100
    money, nation = np.round(rng.uniform(-1000, 10000, 60), 2), rng.integers(0, 4, 60)
    vector = np.round(rng.normal(0, 0.1, (60, 5)), 3)
    money[5], nation[5], vector[5] = 0.0, 0, 0.0
    sign = np.where(np.arange(len(at)) % 2, 1.0, -1.0)  # of zeros, which are equal
    connection = duckdb.connect()
    for table, letter, n in (("customer", "c", len(at)), ("supplier", "s", 90)):
        key = "c_custkey" if letter == "c" else "s_suppkey"
        rows = [(int(ids[i]), float(money[j] * (sign[i] if j == 5 else 1)), int(nation[j])) for i, j in enumerate(at[:n])]
        connection.execute(f"create table {table} ({key} bigint, {letter}_acctbal double, {letter}_nationkey int)")
        connection.executemany(f"insert into {table} values (?, ?, ?)", rows)
    connection.execute("create table embeddings (vec_id bigint, embedding float[], label int)")
    connection.executemany("insert into embeddings values (?, ?, ?)", [(int(ids[i]), [float(x) for x in vector[j]], int(j) % 3) for i, j in enumerate(at)])
    for table in ("customer", "supplier", "embeddings"):
        connection.execute(f"copy {table} to '{out}/{table}.parquet'")
    return out, connection


def same_rows(spark, folder, name):
    out, connection = folder
    frame = queries.QUERIES[name](spark, out)
    columns = sorted(frame.columns)
    cursor = connection.execute(queries.ORACLE_SQL[name])
    order = [[d[0] for d in cursor.description].index(c) for c in columns]
    key = lambda row: tuple((x is None, x) for x in row)
    want = sorted((tuple(r[i] for i in order) for r in cursor.fetchall()), key=key)
    found = sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=key)
    assert want and found == want


@pytest.mark.parametrize("name", STAGES)
def test_stages_have_every_point(spark, folder, name):
    same_rows(spark, folder, name)


def test_counts_of_equal_points(spark, folder):
    same_rows(spark, folder, "eps_counts")


def test_counts_make_no_pairs_of_equal_points(spark, monkeypatch):
    made, join = [], neighbors.eps_join

    def watched(left, right, box, eps):
        made.append(join(left, right, box, eps))
        return made[-1]

    monkeypatch.setattr(neighbors, "eps_join", watched)
    points = from_array(spark, np.repeat(np.array([(0, 0), (0.5, 0), (5, 0)], float), 40, axis=0))
    assert sorted((r.id, r.n) for r in neighbors.eps_counts(points, extent(points), 1.0).collect()) == [(i, 80 if i < 80 else 40) for i in range(120)]
    assert sum(m.count() for m in made) == 5


def test_nearest_of_equal_points(spark, folder):
    same_rows(spark, folder, "knn")
    same_rows(spark, folder, "closest_pair")


def test_nearest_take_k_of_equal_points(spark, monkeypatch):
    made, join = [], neighbors.eps_join

    def watched(left, right, box, eps):
        made.append(join(left, right, box, eps))
        return made[-1]

    monkeypatch.setattr(neighbors, "eps_join", watched)
    points = from_array(spark, np.repeat(np.array([(0, 0), (0.5, 0), (5, 0)], float), 40, axis=0))
    found = sorted((r.id, r["rank"], r.near) for r in neighbors.knn(points, points, 3).collect())
    assert found == [(i, k + 1, i // 40 * 40 + k) for i in range(120) for k in range(3)]
    assert sum(m.count() for m in made) <= 27


@pytest.mark.parametrize("name", ["least_reachable", "spanning_forest_size"])
def test_components_of_equal_points(spark, folder, name):
    same_rows(spark, folder, name)


@pytest.mark.parametrize("name", ["least_reachable", "spanning_forest_size"])
def test_components_take_few_links(spark, folder, monkeypatch, name):
    """Forty copies of each place: a link for each point, not for each pair."""
    out, connection = folder
    more = f"{out}/{name}"
    connection.execute(f"copy (select s_suppkey + 1000 * k s_suppkey, s_acctbal, s_nationkey from supplier, range(40) r(k)) to '{more}.parquet'")
    monkeypatch.setattr(queries, "SUPPLIER", replace(queries.SUPPLIER, table=name))
    taken, made = [], getattr(queries, {"least_reachable": "least_reachable", "spanning_forest_size": "spanning_forest"}[name])
    monkeypatch.setattr(queries, made.__name__, lambda links: taken.append(links) or made(links))
    found = queries.QUERIES[name](spark, out).collect()
    copies = connection.execute(f"select count(*), count(distinct (s_acctbal, s_nationkey)) from '{more}.parquet'").fetchall()[0]
    assert found and taken[0].count() <= copies[0] + copies[1] ** 2


@pytest.mark.parametrize("name", ["eps_pairs", "eps_pairs_5d"])
def test_pairs_of_equal_points(spark, folder, name):
    same_rows(spark, folder, name)


def test_pairs_are_compared_once(spark, monkeypatch):
    made, join = [], neighbors.eps_join

    def watched(*args, **more):
        made.append(join(*args, **more))
        return made[-1]

    monkeypatch.setattr(neighbors, "eps_join", watched)
    points = from_array(spark, np.random.default_rng(3).uniform(-1, 1, (80, 5)))
    n = neighbors.eps_pairs(points, extent(points), 0.7).count()
    assert n > 80 and sum(m.count() for m in made) == (n + 80) // 2
