"""Clusters, hulls and cells against plain constructions."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.operators import crowds, joins


def test_clusters_split_and_noise():
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(c, 0.1, (12, 2)) for c in ((0, 0), (5, 5), (0, 8))] + [[[50.0, -40.0]]])
    labels = crowds.stable_clusters(x, 4, 3)
    assert labels[-1] == 0
    assert [len(set(labels[k : k + 12])) for k in (0, 12, 24)] == [1, 1, 1] and len({labels[0], labels[12], labels[24]}) == 3
    assert (crowds.stable_clusters(x[:3], 4, 3) == 0).all()
    parts = crowds.split_large(x, labels, 5)
    assert max(np.bincount(parts[parts > 0])) < 12 and set(labels[labels > 0]) <= set(parts)


def test_hull_and_cells():
    square = np.array([[0, 0], [0, 2], [2, 0], [2, 2], [1, 1], [1, 1]], float)
    assert crowds.polygon_area(crowds.convex_hull(square)) == 4
    rng = np.random.default_rng(5)
    p = rng.uniform(0, 10, (30, 2))
    box = (np.array([-1.0, -1.0]), np.array([11.0, 11.0]))
    areas = [crowds.cell_area(p, k, box) for k in range(len(p))]
    assert abs(sum(areas) - 144) < 1e-6
    at = rng.uniform(-1, 11, (40_000, 2))
    share = np.bincount(((at[:, None] - p[None]) ** 2).sum(2).argmin(1), minlength=30) / len(at) * 144
    np.testing.assert_allclose(areas, share, atol=0.6)


def _places(n, seed=0):
    """Places of twentieths of a metre in blocks with gaps, many of them equal."""
    rng = np.random.default_rng(seed)
    return np.stack([8 * rng.integers(0, 5, n) + rng.integers(0, 100, n) / 20, 8 * rng.integers(0, 5, n) + rng.integers(0, 97, n) / 20], 1)


def test_cells_side_by_side():
    """All cells at once are those that one by one gives, and thousands of them take seconds."""
    rng = np.random.default_rng(6)
    line = np.stack([np.arange(40.0), np.zeros(40)], 1)
    for p in (_places(400), _places(300)[rng.integers(0, 30, 300)], rng.uniform(0, 9, (200, 2)), np.zeros((4, 2)), line, np.vstack([rng.normal(0, 0.1, (60, 2)), [[1e3, 1e3], [0, 5e3]]])):
        box = (p.min(0) - 5, p.max(0) + 5)
        np.testing.assert_allclose(crowds.cell_areas(p, box), [crowds.cell_area(p, k, box) for k in range(len(p))], rtol=1e-6)
    far = rng.uniform(0, 9, (200, 2)) + 5e6
    np.testing.assert_allclose(crowds.cell_areas(far, (far.min(0), far.max(0))).sum(), np.prod(far.max(0) - far.min(0)))
    p, began = _places(20_000), time.process_time()
    areas = crowds.cell_areas(p, (p.min(0) - 5, p.max(0) + 5))
    assert len(areas) == 20_000 and time.process_time() - began < 15


def test_frames(spark):
    rows = [(1, 0, k, float(k % 3), float(k // 3)) for k in range(9)] + [(1, 1, 9, 1.0, 1.0), (1, 2, 10, 0.0, 0.0), (1, 2, 11, 3.0, 4.0), (1, 3, 12, None, 1.0)]
    d = spark.createDataFrame(rows, "video_id int, frame_id int, row_id long, pos_n double, pos_e double")
    got = {r["row_id"]: r["density"] for r in crowds.voronoi_density(d).collect()}
    assert got[4] == 1.0 and got[9] == 0.005 and got[10] == got[11] == 0.04 and 12 not in got
    found = {r["row_id"]: r["cluster"] for r in crowds.density_clusters(d).collect()}
    assert len(found) == 13 and found[9] is None and found[12] is None
    assert crowds.voronoi_density(d.limit(0)).count() == 0


def test_occupied_area():
    area = lambda *p: crowds.occupied_area(np.array(p, float).reshape(-1, 2))
    assert area() == area((3, 4)) == area((0, 0), (0.5, 0)) == area((1, 1), (1, 1), (1, 1)) == 1
    assert area((0, 0), (4, 0)) == np.pi * 4 and area((0, 0), (0, 3), (3, 0)) == 4.5
    np.testing.assert_allclose(area((0, 0), (1, 0), (8, 0)), np.pi * 25)


def test_velocities_and_streets(spark):
    """Two groups in one place that move apart are two by velocities; streets number their own."""
    rng = np.random.default_rng(1)
    rows = [(1, 0, k, float(rng.normal()), float(rng.normal()), 5.0 * (k % 2) + float(rng.normal(0, 0.1)), 1 + k % 2) for k in range(24)]
    d = spark.createDataFrame(rows, "video_id int, frame_id int, row_id long, pos_n double, pos_e double, vel_n double, street_index int")
    by = {r["row_id"]: r["cluster"] for r in crowds.density_clusters(d, 5, 3, features=(("pos_n", 0.1), ("pos_e", 0.1), ("vel_n", 10.0))).collect()}
    assert len({by[k] for k in range(0, 24, 2)}) == len({by[k] for k in range(1, 24, 2)}) == 1 and by[0] != by[1]
    got = crowds.by_street(d.withColumn("street_index", F.when(F.col("row_id") < 2, 0).otherwise(F.col("street_index"))), least=3).collect()
    assert {r["crowd"] // 10_000 for r in got if r["crowd"] is not None} <= {1, 2} and all(r["crowd"] is None for r in got if r["row_id"] < 2)
    assert crowds.search_parameters(d, [(3, 2), (30, 2)]).filter("least = 30").first()["cost"] == 50.0


def test_plane(spark):
    from trackweave.plans.depth import ransac_plane

    rng = np.random.default_rng(2)
    xy = rng.uniform(-5, 5, (200, 2))
    z = 0.5 * xy[:, 0] - 0.2 * xy[:, 1] + 3
    z[:40] += 20
    rows = [(7, k % 20, k // 20, *map(float, p), float(h)) for k, (p, h) in enumerate(zip(xy, z, strict=True))] + [(8, 0, 0, 1.0, 1.0, 1.0)]
    r = ransac_plane(spark.createDataFrame(rows, "frame_id int, u int, v int, x double, y double, z double"), 0.1).collect()
    assert len(r) == 1 and abs(r[0]["alpha"] - 0.5) + abs(r[0]["beta"] + 0.2) + abs(r[0]["gamma"] - 3) < 1e-6 and r[0]["inlier_ratio"] == 0.8


def test_groups_nearer_than_epsilon_are_one():
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(c, 0.05, (12, 2)) for c in ((0, 0), (1, 0), (30, 0), (31, 0))])
    sets = lambda labels: {tuple(np.flatnonzero(labels == k)) for k in set(labels) - {0}}
    pairs = {tuple(range(24)), tuple(range(24, 48))}
    assert len(sets(crowds.stable_clusters(x, 4, 3))) == 4
    assert sets(crowds.stable_clusters(x, 4, 3, 0.01)) == sets(crowds.stable_clusters(x, 4, 3))
    assert sets(crowds.stable_clusters(x, 4, 3, 5.0)) == sets(crowds.stable_clusters(x, 4, 3, 500.0)) == pairs


def _plain_tree(x, neighbours):
    """Edges of the least tree as the definition has them: all distances at every step, ties to the smaller number, and from the point reached first."""
    n = len(x)
    apart = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(apart, 1)[:, min(neighbours, n) - 1]
    near, source, left, at, edges = np.full(n, np.inf), np.zeros(n, int), np.ones(n, bool), 0, []
    for _ in range(n - 1):
        left[at] = False
        reach = np.maximum(np.maximum(core, core[at]), apart[at])
        closer = left & (reach < near)
        near[closer], source[closer] = reach[closer], at
        at = int(np.where(left, near, np.inf).argmin())
        edges.append((float(near[at]), int(source[at]), at))
    return sorted(edges)


def test_trees_of_equal_distances_and_many_points():
    rng = np.random.default_rng(8)
    for x in (_places(500), _places(400)[rng.integers(0, 50, 400)], rng.normal(size=(300, 4)), rng.integers(0, 3, (300, 4)).astype(float), np.zeros((20, 2)), np.array([[0, 0], [1, 1.0]])):
        for neighbours in (2, 3):
            assert crowds._spanning_tree(x, neighbours) == _plain_tree(x, neighbours)
    x, began = _places(9000), time.process_time()
    assert len(crowds._spanning_tree(x, 2)) == 8999 and time.process_time() - began < 2.5


def test_large_clusters_are_split_in_little_memory():
    import tracemalloc

    x = np.random.default_rng(9).normal(size=(12_000, 2))
    tracemalloc.start()
    parts = crowds.split_large(x, np.ones(len(x), int), 40, rounds=2)
    assert len(np.unique(parts)) == 300 and tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()


def test_trials_share_their_trees(spark, monkeypatch):
    d = spark.createDataFrame([(1, k % 2, k, float(n), float(e)) for k, (n, e) in enumerate(_places(80))], "video_id int, frame_id int, row_id long, pos_n double, pos_e double")
    got = crowds.search_parameters(d, [(3, 2), (4, 2), (90, 2)])
    for r in got.collect():
        c = crowds.density_clusters(d, r["least"], r["neighbours"]).join(d.select("row_id", "frame_id"), "row_id").groupBy("frame_id").agg(F.count_if(F.col("cluster").isNull()).alias("noise"), F.count("*").alias("n"), F.countDistinct("cluster").alias("clusters"))
        assert r["cost"] == c.agg(F.round(50.0 * F.sum("noise") / F.sum("n") + 2.0 * F.stddev_pop("clusters"), 6)).first()[0]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInPandas") == 1
    assert [(r["trial"], r["cost"]) for r in crowds.search_parameters(d.limit(0), [(3, 2)]).collect()] == [(0, None)]


def test_neighbours_are_counted_by_cells(spark):
    """As all pairs give, on the circle too, over tiles, and fast where each has thousands."""
    rng = np.random.default_rng(10)
    for x in (_places(700), rng.uniform(-30, 90, (500, 2)), np.zeros((5, 2)), np.array([[0.0, 0], [6, 8], [600, 800]]), rng.integers(-20, 20, (600, 2)).astype(float)):
        plain = (((x[:, None] - x[None]) ** 2).sum(2) <= 100 + 1e-9).sum(1)
        assert (joins.counts_within(x, x, 10.0, 1e-9) == plain).all()
        d = spark.createDataFrame([(0, k, float(n), float(e)) for k, (n, e) in enumerate(x)] + [(0, -1, None, 1.0), (0, -2, float("nan"), 1.0)], "frame_id int, row_id long, pos_n double, pos_e double")
        got = {r["row_id"]: r["density"] for r in joins.radius_neighbours(d, ["frame_id"], "pos_n", "pos_e", "row_id", tile=1.5).collect()}
        assert got == dict(enumerate((plain - 1).tolist()))
    x, began = _places(30_000), time.process_time()
    assert len(joins.counts_within(x, x, 10.0, 1e-9)) == 30_000 and time.process_time() - began < 15


@pytest.mark.parametrize("shape", ["normal", "copies", "two heaps", "far ones"])
def test_large_trees_are_those_of_all_pairs(monkeypatch, shape):
    """The same edges as by looking at all points in each step, and in less time where many places lie over one spot."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2500, 4))
    if shape == "copies":
        x = np.repeat(x[:500], 5, 0) + np.round(rng.normal(size=(2500, 1))) * [[0, 0.25, 0, 0]]
    elif shape == "two heaps":
        x = x * 0.01 + np.where(rng.random((2500, 1)) < 0.5, 0.0, 5.0)
    elif shape == "far ones":
        x[::50] *= 100
    for neighbours in (2, 3, 5):
        took = []
        for most in (10**9, 100):
            monkeypatch.setattr(crowds, "PLAIN", most)
            began = time.perf_counter()
            took.append((crowds._spanning_tree(x, neighbours), time.perf_counter() - began))
        assert took[0][0] == took[1][0] and len(took[0][0]) == 2499
        assert shape != "two heaps" or took[1][1] < took[0][1]
