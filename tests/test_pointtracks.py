"""Epipolar distances, true and false tracks, inliers and reconstructions against numpy and a scene that is known."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.operators import pointtracks as pt

W, H = 64, 48
CAMERA = "seq int, frame int, camera struct<r:array<double>,t:array<double>,fx:double,fy:double,cx:double,cy:double>"


def camera(k, seq=0):
    a = 0.02 * k
    r = np.array([[np.cos(a), 0, np.sin(a)], [0, 1, 0], [-np.sin(a), 0, np.cos(a)]])
    return r, np.array([-0.3 * k, 0.05 * k, 0.1]), 50.0, 52.0, 31.5, 23.5


def cameras(spark, n, seqs=(0,)):
    return spark.createDataFrame([(s, k, (c[0].ravel().tolist(), c[1].tolist(), *c[2:])) for s in seqs for k in range(n) for c in [camera(k)]], CAMERA)


def seen(c, x):
    p = c[0] @ x + c[1]
    return c[2] * p[0] / p[2] + c[4], c[3] * p[1] / p[2] + c[5], p[2]


def sampson(a, b, p, q):
    r = b[0] @ a[0].T
    t = b[1] - r @ a[1]
    e = np.array([[0, -t[2], t[1]], [t[2], 0, -t[0]], [-t[1], t[0], 0]]) @ r
    k = lambda c: np.array([[c[2], 0, c[4]], [0, c[3], c[5]], [0, 0, 1]])
    f = np.linalg.inv(k(b)).T @ e @ np.linalg.inv(k(a))
    p, q = np.array([*p, 1.0]), np.array([*q, 1.0])
    x, y = f @ p, f.T @ q
    return (q @ x) ** 2 / (x[0] ** 2 + x[1] ** 2 + y[0] ** 2 + y[1] ** 2)


def scene(spark, n, seqs=(0,)):
    """A plane 8 m ahead as depth of every frame, and points of the first frame's pixels on it, every seventh of them too near to be visible elsewhere."""
    points, depth = [], []
    a = camera(0)
    for k, (u, v) in enumerate((u, v) for u in range(0, W, 3) for v in range(0, H, 3)):
        z = 8.0
        x = a[0].T @ (np.array([(u - a[4]) / a[2] * z, (v - a[5]) / a[3] * z, z]) - a[1])
        points += [(s, k, *map(float, x)) for s in seqs]
    for f in range(n):
        c = camera(f)
        for u in range(W):
            for v in range(H):
                ray = c[0].T @ np.array([(u - c[4]) / c[2], (v - c[5]) / c[3], 1.0])
                at = -c[0].T @ c[1]
                depth += [(s, f, u, v, float((7.9 - at[2]) / ray[2])) for s in seqs]
    return spark.createDataFrame(points, "seq int, point int, x double, y double, z double"), spark.createDataFrame(depth, "seq int, frame int, u int, v int, depth double")


def test_sampson(spark):
    r = np.random.default_rng(1)
    rows = [(i, j, *map(float, r.uniform(0, 60, 4))) for i in range(4) for j in range(4) if i != j]
    c = cameras(spark, 4)
    d = spark.createDataFrame(rows, "i int, j int, u1 double, v1 double, u2 double, v2 double").join(c.select(F.col("frame").alias("i"), F.col("camera").alias("a")), "i").join(c.select(F.col("frame").alias("j"), F.col("camera").alias("b")), "j")
    got = {(x["i"], x["j"]): x["s"] for x in d.select("i", "j", pt.sampson(F.col("a"), F.col("b"), *(F.col(k) for k in ("u1", "v1", "u2", "v2"))).alias("s")).collect()}
    for i, j, u1, v1, u2, v2 in rows:
        np.testing.assert_allclose(got[i, j], sampson(camera(i), camera(j), (u1, v1), (u2, v2)), rtol=1e-9)
    x = np.array([0.3, -0.2, 6.0])
    assert sampson(camera(0), camera(3), seen(camera(0), x)[:2], seen(camera(3), x)[:2]) < 1e-18


def test_truth(spark):
    points, depth = scene(spark, 4, seqs=(0, 1))
    c = cameras(spark, 4, seqs=(0, 1))
    p = pt.TrackParams(W, H, target=60, false_share=0.25, seed=5)
    out = pt.track_truth(points, c, depth, p).collect()
    again = pt.track_truth(points.repartition(7), c, depth.repartition(5), p).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))
    for s in (0, 1):
        tracks = {}
        for r in out:
            if r["seq"] == s:
                tracks.setdefault((r["positive"], r["track"]), {})[r["frame"]] = r
        assert sum(p for p, _ in tracks) == 45 and len(tracks) == 60 and all(len(t) == 4 for t in tracks.values())
        where = {f"p{r['point']}": np.array([r["x"], r["y"], r["z"]]) for r in points.filter(f"seq = {s}").collect()}
        for (positive, name), t in tracks.items():
            if positive:
                assert t[0]["visible"] and sum(r["visible"] for r in t.values()) > 1
                for f, r in t.items():
                    u, v, _ = seen(camera(f), where[name])
                    np.testing.assert_allclose((r["u"], r["v"]), (u, v), atol=1e-9)
                    if r["visible"]:
                        assert 4 <= u < W - 4 and 4 <= v < H - 4
            else:
                assert not any(r["visible"] for r in t.values())
                assert all(sampson(camera(0), camera(f), (t[0]["u"], t[0]["v"]), (r["u"], r["v"])) > 16 for f, r in t.items() if f)
    assert {r["track"] for r in out} != {r["track"] for r in pt.track_truth(points, c, depth, pt.TrackParams(W, H, target=60, false_share=0.25, seed=6)).collect()}


def test_reconstruction_round_trip(spark, tmp_path):
    r = np.random.default_rng(2)
    cams = cameras(spark, 3).select("frame", "camera")
    xyz = {k: r.uniform([-1, -1, 5], [1, 1, 9]) for k in range(0, 60, 2)}
    xyz[60] = np.array([0.0, 0.0, 4000.0])
    points = spark.createDataFrame([(k, *map(float, x), k, 2, 3) for k, x in xyz.items()], "point int, x double, y double, z double, r int, g int, b int")
    rows = [(f, k, *map(float, seen(camera(f), x)[:2])) for k, x in xyz.items() for f in range(3) if k != 4 or f == 0]
    rows = [(f, k, u + (9 if (k, f) == (6, 1) else 0), v) for f, k, u, v in rows]
    obs = pt.inliers(spark.createDataFrame(rows, "frame int, point int, u double, v double"), points, cams, 4.0)
    assert {(x["point"], x["frame"]) for x in obs.filter("not inlier").collect()} == {(6, 1)}
    rec = pt.reconstruction(points, obs, cams, W, H, least=20)
    pt.write_text(rec, f"file://{tmp_path}/r")
    back = {x["id"]: x for x in pt.read_points(spark, f"file://{tmp_path}/r").collect()}
    names = sorted(set(xyz) - {4})
    assert sorted(back) == list(range(1, len(names) + 1)) and [back[i]["rgb"][0] for i in sorted(back)] == names
    images = {x["image_id"]: x for x in rec.images.collect()}
    assert back[len(names)]["track"] == [] and len(spark.read.text(f"file://{tmp_path}/r/images").collect()) == 6
    for i, x in back.items():
        point = names[i - 1]
        np.testing.assert_allclose((x["x"], x["y"], x["z"]), xyz[point])
        if point != 60:
            assert [s["image_id"] for s in x["track"]] == ([1, 3] if point == 6 else [1, 2, 3])
        for s in x["track"]:
            held = images[s["image_id"]]["points2d"][s["idx"]]
            assert held["id"] == i
            np.testing.assert_allclose((held["x"], held["y"]), seen(camera(s["image_id"] - 1), xyz[point])[:2])
    with pytest.raises(ValueError, match="inliers"):
        pt.reconstruction(points, obs, cams, W, H, least=64)
