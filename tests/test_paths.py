"""Shortest trees and routes against Dijkstra's algorithm, a long chain, 64-bit ids."""

import heapq
import json
import random

import pytest

from trackweave.operators import paths, states

SCHEMA = "src long, dst long, length double, x1 double, y1 double, x2 double, y2 double"


def plain(edges, target):
    """node: (dist, hops, next)"""
    into = {}
    for s, d, w, *_ in edges:
        if None not in (s, d, w):
            into.setdefault(d, []).append((s, w))
    best, queue = {target: (0.0, 0, None)}, [(0.0, 0, target)]
    while queue:
        dist, hops, node = heapq.heappop(queue)
        if best[node][:2] != (dist, hops):
            continue
        for s, w in into.get(node, ()):
            label = (w + dist, hops + 1, node)
            if s not in best or label[:2] < best[s][:2] or label[:2] == best[s][:2] and s != target and label[2] < best[s][2]:
                new = s not in best or label[:2] < best[s][:2]
                best[s] = label
                if new:
                    heapq.heappush(queue, (*label[:2], s))
    return best


def tree(rows):
    return {(r["target"], r["node"]): (r["dist"], r["hops"], r["next"]) for r in rows.collect()}


BASE = 5_000_000_000


def random_graph(seed, n=120, m=420):
    r = random.Random(seed)
    at = [(float(r.randrange(40)), float(r.randrange(40))) for _ in range(n)]
    rows = []
    for _ in range(m):
        a, b = r.randrange(n), r.randrange(n)
        rows.append((BASE + a, BASE + b, r.choice([0.0, 1.0, 1.0, 2.0, 5.5, None]), *at[a], *at[b]))
    return rows + [(None, BASE, 1.0, 0.0, 0.0, 0.0, 0.0)]


@pytest.mark.parametrize("cell", [None, 7.0, 100.0])
def test_trees(spark, cell):
    rows = random_graph(3)
    df = spark.createDataFrame(rows, SCHEMA)
    got = tree(paths.shortest_tree(df, [BASE, BASE + 7, 42], cell))
    want = {(t, n): label for t in (BASE, BASE + 7, 42) for n, label in plain(rows, t).items()}
    assert got == want


def test_long_chain(spark):
    """2,000 hops one after the other, over 20 blocks; the path comes back whole."""
    n = 2000
    rows = [(BASE + k + 1, BASE + k, 1.5, float(k + 1), 0.0, float(k), 0.0) for k in range(n)]
    t = paths.shortest_tree(spark.createDataFrame(rows, SCHEMA), [BASE], cell=100.0)
    t = t.persist()
    assert t.count() == n + 1 and t.filter(f"dist <> 1.5 * (node - {BASE}) or hops <> node - {BASE}").count() == 0
    starts = spark.createDataFrame([(BASE, BASE + n), (BASE, BASE + 5), (BASE, BASE), (BASE, 7)], "target long, start long")
    got = {}
    for r in paths.unrolled(t, starts).collect():
        got.setdefault(r["start"], []).append((r["hop"], r["node"]))
    assert {k: sorted(v) for k, v in got.items()} == {BASE + k: [(i, BASE + k - i) for i in range(k + 1)] for k in (n, 5, 0)}
    t.unpersist()


def test_routes(spark):
    rows = random_graph(5)
    df = spark.createDataFrame(rows, SCHEMA)
    t = paths.shortest_tree(df, [BASE, BASE + 3], 9.0)
    r = random.Random(1)
    people = [(k, BASE + r.randrange(120), r.choice([None, float("nan"), 0.0, 90.0, 200.0, 359.0]), r.choice([0.0, 1.0, 2.5])) for k in range(80)]
    walkers = spark.createDataFrame(people, "row_id long, node long, heading_deg double, speed double")
    steps = paths.first_steps(walkers, df, t, cone=60.0)
    lengths = {}
    for s, d, w, *_ in rows:
        if None not in (s, d, w):
            lengths[s, d] = min(w, lengths.get((s, d), w))
    got = paths.routes(steps, t).collect()
    best = {x: plain(rows, x) for x in (BASE, BASE + 3)}
    assert {(g["row_id"], g["target"]) for g in got} == {(k, x) for k, node, _, _ in people for x in best if any(s == node and d in best[x] for s, d in lengths)}
    for g in got:
        path = g["path"]
        assert path[0] == g["node"] and path[1] == g["first"] and path[-1] == g["target"]
        assert round(sum(lengths[e] for e in zip(path, path[1:], strict=False)), 2) <= g["distance_m"]
        assert round(best[g["target"]][g["first"]][0] + lengths[path[0], path[1]], 2) <= g["distance_m"]
    places = spark.createDataFrame([(BASE + k, k / 2, -k / 4) for k in range(120)], "node long, lon double, lat double")
    lines = {(x["row_id"], x["target"]): json.loads(x["geojson"]) for x in paths.route_lines(steps, t, places).collect()}
    for g in got:
        assert lines[g["row_id"], g["target"]] == {"type": "LineString", "coordinates": [[(n - BASE) / 2, -(n - BASE) / 4] for n in g["path"]]}


def test_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert tree(paths.shortest_tree(none, [9])) == {(9, 9): (0.0, 0, None)}
    assert paths.unrolled(paths.shortest_tree(none, [9]), spark.createDataFrame([], "target long, start long")).collect() == []
    with pytest.raises(Exception, match="negative"):
        paths.shortest_tree(spark.createDataFrame([(1, 2, -1.0, 0.0, 0.0, 0.0, 0.0)], SCHEMA), [2]).collect()
    assert {r["node"]: r["dist"] for r in states.distances_to(spark.createDataFrame([(BASE, 5, 2.0), (7, 5, None)], "src long, dst long, length double"), 5).collect()} == {5: 0.0, BASE: 2.0}
