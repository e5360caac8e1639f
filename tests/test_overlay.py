"""Unions of rings and buffers of lines against areas that are known."""

import math
import random

import pytest

from trackweave.operators import overlay

SCHEMA = "name string, ring_id long, seq int, n double, e double"


def ring(name, k, points):
    return [(name, k, i, float(n), float(e)) for i, (n, e) in enumerate(points)]


def square(name, k, n, e, size, back=False):
    points = [(n, e), (n + size, e), (n + size, e + size), (n, e + size)]
    return ring(name, k, points[::-1] if back else points)


def areas(spark, rows, cell=8.0):
    return {r["name"]: round(r["area"], 6) for r in overlay.union_areas(spark.createDataFrame(rows, SCHEMA), cell).collect()}


def covered(rows):
    """Area of a union of axis-parallel boxes, cell by cell."""
    boxes = {}
    for _, k, _, n, e in rows:
        boxes.setdefault(k, []).append((n, e))
    boxes = [(min(n for n, _ in b), max(n for n, _ in b), min(e for _, e in b), max(e for _, e in b)) for b in boxes.values()]
    ns, es = (sorted({v for b in boxes for v in b[k : k + 2]}) for k in (0, 2))
    return sum((n1 - n0) * (e1 - e0) for n0, n1 in zip(ns, ns[1:]) for e0, e1 in zip(es, es[1:]) if any(b[0] <= n0 and n1 <= b[1] and b[2] <= e0 and e1 <= b[3] for b in boxes))


def test_areas(spark):
    r = random.Random(1)
    boxes = [row for k in range(40) for row in square("many", k, r.randrange(40), r.randrange(40), r.randrange(2, 12), k % 2)]
    rows = [
        *boxes, *square("apart", 0, 0, 0, 2), *square("apart", 1, 5, 5, 2), *square("same", 0, 0, 0, 4), *square("same", 1, 0, 0, 4, True), *square("inside", 0, 0, 0, 9), *square("inside", 1, 2, 2, 3),
        *square("side", 0, 0, 0, 4), *square("side", 1, 4, 1, 2), *square("corner", 0, 0, 0, 2), *square("corner", 1, 2, 2, 2),
        *ring("star", 0, [(0, 0), (6, 0), (3, 6)]), *ring("star", 1, [(0, 4), (3, -2), (6, 4)]), *ring("nothing", 0, [(1, 1), (2, 2), (3, 3)]),
    ]
    want = {"many": covered(boxes), "apart": 8.0, "same": 16.0, "inside": 81.0, "side": 20.0, "corner": 8.0, "star": 24.0}
    for cell in (2.5, 8.0, 100.0):
        assert areas(spark, rows, cell) == pytest.approx(want, abs=1e-5)


def test_rings(spark):
    frame = [("hole", k, n, e, w, h) for k, (n, e, w, h) in enumerate([(0, 0, 9, 2), (0, 7, 9, 2), (0, 0, 2, 9), (7, 0, 2, 9)])]
    rows = [row for name, k, n, e, w, h in frame for row in ring(name, k, [(n, e), (n + w, e), (n + w, e + h), (n, e + h)])] + square("two", 0, 0, 0, 4) + square("two", 1, 2, 2, 4) + square("corner", 0, 0, 0, 2) + square("corner", 1, 2, 2, 2)
    got = {}
    for r in overlay.union_rings(spark.createDataFrame(rows, SCHEMA)).orderBy("name", "ring_id", "seq").collect():
        got.setdefault((r["name"], r["ring_id"]), []).append((r["n"], r["e"]))
    assert got == {
        ("hole", 0): [(0, 0), (9, 0), (9, 9), (0, 9)], ("hole", 1): [(2, 2), (2, 7), (7, 7), (7, 2)], ("two", 0): [(0, 0), (4, 0), (4, 2), (6, 2), (6, 6), (2, 6), (2, 4), (0, 4)],
        ("corner", 0): [(0, 0), (2, 0), (2, 2), (0, 2)], ("corner", 1): [(2, 2), (4, 2), (4, 4), (2, 4)],
    }


def test_buffers(spark):
    lines = spark.createDataFrame([("straight", 0.0, 0.0, 10.0, 0.0, 2.0), ("bent", 0.0, 0.0, 10.0, 0.0, 2.0), ("bent", 10.0, 0.0, 10.0, 10.0, 2.0), ("point", 3.0, 3.0, 3.0, 3.0, 1.0)], "name string, n double, e double, n2 double, e2 double, metres double")
    rings = overlay.buffers(lines, quarter=16)
    got = {r["name"]: r["area"] for r in overlay.union_areas(rings).collect()}
    disc = 32 * math.sin(2 * math.pi / 64)  # of radius 1, with 64 corners
    assert got == pytest.approx({"straight": 40 + 4 * disc, "bent": 80 + 5 * disc - 4, "point": disc}, abs=1e-3)
    found = overlay.union_rings(rings.filter("name = 'straight'")).collect()
    assert {r["ring_id"] for r in found} == {0} and all(abs(math.hypot(max(0 - r["n"], 0, r["n"] - 10), r["e"]) - 2) < 1e-6 for r in found)
    assert overlay.union_areas(rings.filter("false")).collect() == [] and overlay.union_rings(rings.filter("false")).collect() == []
