"""Stateful operators against step-by-step versions and brute force."""

import itertools
import time

import numpy as np
from pyspark.sql import functions as F

from trackweave.functions import geo
from trackweave.operators import joins, states, windows


def test_kalman_axes_do_not_interact():
    rng = np.random.default_rng(0)
    frames = np.array([0, 1, 2, 5, 5, 9])
    z = rng.normal(size=(6, 2))
    f = np.kron([[1, 1], [0, 1]], np.eye(2))
    q = 4 * np.kron([[0.25, 0.5], [0.5, 1]], np.eye(2))
    h = np.eye(2, 4)
    x, p, out = np.array([*z[0], 0, 0]), np.diag([25.0, 25, 4, 4]), []
    out.append(x)
    for k in range(1, 6):
        for _ in range(frames[k] - frames[k - 1]):
            x, p = f @ x, f @ p @ f.T + q
        gain = p @ h.T @ np.linalg.inv(h @ p @ h.T + 9 * np.eye(2))
        x, p = x + gain @ (z[k] - h @ x), (np.eye(4) - gain @ h) @ p
        out.append(x)
    k = states.Kalman(1.0, 2.0, (3.0, 3.0, 9.0))
    held = k.begun(np.array(frames[:1]), np.array([[*z[0], 5.0]]))
    for i in range(6):
        held = k.advanced(held, np.array([frames[i]]), np.array([[*z[i], 5.0]])) if i else held
        np.testing.assert_allclose(held[0, 1:3, :2].ravel(), np.array(out)[i])


def test_tracks_pass_in_batches(spark):
    """Long and short tracks, over the ends of Arrow batches, as each alone."""
    rng = np.random.default_rng(2)
    rows = [(k, int(t), int(f), *map(float, rng.normal(size=3))) for k, (t, f) in enumerate((t, f) for t, n in enumerate((300, 1, 40, 7, 90)) for f in np.cumsum(rng.integers(0, 4, n)))]
    d = spark.createDataFrame(rows, "row_id long, track_id long, frame_id int, pos_n double, pos_e double, pos_d double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {r["row_id"]: tuple(r)[2:] for r in states.kalman_tracks(d.repartition(3)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    k, held = states.Kalman(), {}
    for row, track, frame, *z in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        at = np.array([frame]), np.array([z])
        held[track] = k.advanced(held[track], *at) if track in held else k.begun(*at)
        np.testing.assert_allclose(got[row], held[track][0, 1:3].ravel(), atol=1e-12)


def test_assignment_is_least():
    rng = np.random.default_rng(1)
    for n, m in itertools.product(range(1, 5), range(1, 6)):
        cost = rng.random((n, m))
        pairs = states.assignment(cost)
        small, large = min(n, m), max(n, m)
        c = cost if n <= m else cost.T
        best = min(sum(c[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))
        assert len(pairs) == small and abs(sum(cost[a, b] for a, b in pairs) - best) < 1e-9


def test_identity_lasts_over_gaps(spark):
    rows = [(0, f, lab, 10.0 * lab + f * 0.1, 0.0) for f in range(6) if f != 3 for lab in (1, 2)]
    d = spark.createDataFrame(rows, "video_id int, frame_id int, label int, centre_n double, centre_e double")
    got = {(r["label"], r["identity"]) for r in states.cluster_identity(d, "video_id").collect()}
    assert got == {(1, 1), (2, 2)}


def test_ned_round_trip(spark):
    d = spark.range(50).select((51 + F.col("id") / 1000).alias("lat"), (-3 + F.col("id") / 500).alias("lon"), F.col("id").cast("double").alias("alt"))
    o = (F.lit(51.0), F.lit(-3.0), F.lit(10.0))
    n, e, dd = geo.lla_to_ned(F.col("lat"), F.col("lon"), F.col("alt"), *o)
    back = geo.ned_to_lla(n, e, dd, *o)
    err = d.select(sum(F.abs(b - F.col(c)) for b, c in zip(back, ("lat", "lon", "alt"), strict=True)).alias("x")).agg(F.max("x")).first()[0]
    assert err < 1e-9


def test_mode_filter_keeps_own_value_on_ties(spark):
    d = spark.createDataFrame([(1, k, v) for k, v in enumerate([1, 2, 1, 2, None, 2])], "t int, k int, v int")
    got = [r["v_mode"] for r in windows.mode_filter(d, "v", "t", ["k"], 1).orderBy("k").collect()]
    assert got == [1, 1, 2, 2, 2, 2]
    d = spark.createDataFrame([(1, k, v, s) for k, (v, s) in enumerate([(1, 0), (1, 0), (2, 1), (None, 1), (None, 0)])], "t int, k int, v int, s int")
    assert [r["v_mode"] for r in windows.mode_filter(d, "v", "t", ["k"], 3, "s").orderBy("k").collect()] == [1, 1, 2, 2, None]


def test_distances_reach_far_nodes(spark):
    """A chain of more edges than any fixed number of rounds; node 99 has a long edge of its own, too."""
    rows = [(k + 1, k, 0.5) for k in range(99)] + [(99, 0, 60.0)]
    got = {r["node"]: r["dist"] for r in states.distances_to(spark.createDataFrame(rows, "src int, dst int, length double"), 0).collect()}
    assert got == {k: 0.5 * k for k in range(100)}


def test_stable_numbers(spark):
    """A crowd whose number changes keeps the first; a far one gets in under its own; one unseen for too long is forgotten."""
    rows = [(1, 0, 5, 0.0, 0.0), (1, 1, 8, 1.0, 0.0), (1, 1, 9, 90.0, 0.0), (1, 2, 5, 90.5, 0.0), (1, 2, 9, 1.0, 0.0), (2, 2, 7, 1.0, 0.0)]
    d = spark.createDataFrame(rows, "street_index int, frame_id int, crowd_id long, n double, e double")
    got = {(r["street_index"], r["frame_id"], r["crowd_id"]): r["stable_id"] for r in states.stabilised(d, limit=6.0).collect()}
    assert got == {(1, 0, 5): 5, (1, 1, 8): 5, (1, 1, 9): 9, (1, 2, 5): 9, (1, 2, 9): 5, (2, 2, 7): 7}
    gone = spark.createDataFrame([(1, 0, 5, 0.0, 0.0), *((1, f, 6, 500.0, 0.0) for f in range(1, 5)), (1, 5, 8, 0.0, 0.0)], d.schema)
    last = {r["crowd_id"]: r["stable_id"] for r in states.stabilised(gone, memory=3).collect() if r["frame_id"] == 5}
    assert last == {8: 8}


def test_farthest_order(spark):
    d = spark.createDataFrame([(1, k, float(x)) for k, x in enumerate((0, 1, 10, 4))], "g int, k int, x double")
    assert [r["k"] for r in states.farthest_order(d, "g", "k", ["x"]).orderBy("rank").collect()] == [0, 2, 1, 3]


def test_nearest_points(spark):
    import random

    r = random.Random(4)
    nodes = [(k, r.uniform(0, 50), r.uniform(0, 50)) for k in range(30)] + [(99, 4000.0, 4000.0)]
    points = [(k, r.uniform(-20, 70), r.uniform(-20, 70)) for k in range(200)] + [(500, 3000.0, 3000.0), (501, None, 1.0)]
    got = {x["k"]: x["node"] for x in joins.nearest_point(spark.createDataFrame(points, "k int, n double, e double"), "k", "n", "e", spark.createDataFrame(nodes, "node int, x double, y double"), "node", "x", "y", 2.0).collect()}
    want = {k: min(nodes, key=lambda m: ((n - m[1]) ** 2 + (e - m[2]) ** 2, m[0]))[0] for k, n, e in points if n is not None}
    assert got == {**want, 501: None}


def test_crossing_crowds_keep_their_identities(spark):
    """Two crowds that meet and pass: by places alone they would swap; a frame without clusters ages what is remembered."""
    from trackweave.operators import crowds

    rows, found = [], []
    for f in range(9):
        for k in range(10):
            way = 1 if k < 5 else -1
            rows.append((1, f, 10 * f + k, way * (f - 4.1) * 2.0, 0.1 * (k % 5), 2.0 * way, 0.01 * k))
            found.append((10 * f + k, None if f == 4 else 1 + (way > 0) if f % 2 else 2 - (way > 0)))
    d = spark.createDataFrame(rows, "video_id int, frame_id int, row_id long, n double, e double, vn double, ve double")
    c = spark.createDataFrame(found, "row_id long, cluster long")
    m = crowds.macro_states(d, c)
    assert m.filter("label is null").count() == 1 and m.count() == 17
    got = {(r["frame_id"], r["label"]): r["identity"] for r in states.moving_identity(m).collect()}
    assert len(got) == 16
    for way in (1, -1):
        assert len({got[f, 1 + (way > 0) if f % 2 else 2 - (way > 0)] for f in range(9) if f != 4}) == 1
    short = {r["identity"] for r in states.moving_identity(m, memory=1).collect()}
    assert short == {1, 2, 3, 4}
    assert states.moving_identity(m.limit(0)).count() == 0


def test_nearby_draws(spark):
    d = spark.createDataFrame([(0,), (5,), (5,), (99,), (None,)], "f int")
    rows = joins.nearby(d, "f", F.lit(100), 4, 3, seed=1).collect()
    assert len(rows) == 20 and all(r["picked"] is None for r in rows if r["f"] is None)
    assert all(max(0, r["f"] - 3) <= r["picked"] < min(100, r["f"] + 3) for r in rows if r["f"] is not None)
    assert [r["picked"] for r in rows if r["k"] == 0 and r["f"] is not None] == [0, 5, 5, 99]
    assert len({(r["f"], r["k"], r["picked"]) for r in rows}) == 16


def test_large_assignments(monkeypatch):
    """Rows that bid first leave the same pairs, in less time."""
    rng = np.random.default_rng(2)
    for n, m in ((1, 4), (30, 30), (25, 60), (60, 25)):
        cost, ties = rng.random((n, m)), np.round(rng.random((n, m)) * 4)
        monkeypatch.setattr(states, "FEW", 10**9)
        pairs, least = states.assignment(cost), sum(ties[a, b] for a, b in states.assignment(ties))
        monkeypatch.setattr(states, "FEW", 0)
        assert sorted(states.assignment(cost)) == sorted(pairs)
        found = states.assignment(ties)
        assert sum(ties[a, b] for a, b in found) == least and len({a for a, _ in found}) == len({b for _, b in found}) == min(n, m)
    a = rng.normal(size=(600, 2))
    cost = np.hypot(*(a[:, None] - (a + 0.1 * rng.normal(size=a.shape))[None]).transpose(2, 0, 1))
    took = []
    for few in (10**9, 256):
        monkeypatch.setattr(states, "FEW", few)
        began = time.perf_counter()
        took.append((sorted(states.assignment(cost)), time.perf_counter() - began))
    assert took[0][0] == took[1][0] and took[1][1] < took[0][1]
