"""Crowds within a frame: density clusters, hull areas, room per person.

Frames are independent and a frame holds what one camera sees, so Spark groups by frame (and by `key`, such as a street) and numpy works on one group.
"""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


class Near:
    """Points in cells of a grid over their first two coordinates, a few in each, for those nearest to some of them."""

    def __init__(self, x: np.ndarray) -> None:
        self.x, self.low = x, x[:, :2].min(0)
        span = np.maximum(x[:, :2].max(0) - self.low, 1e-9)
        self.size = max(float(np.sqrt(span[0] * span[1] / max(len(x) / 2, 1))), float(span.max()) / 4096)
        self.shape = (span // self.size).astype(int) + 1
        cell = self.cell(x)
        flat = cell[:, 0] * self.shape[1] + cell[:, 1]
        self.order = np.argsort(flat, kind="stable")
        self.starts = np.searchsorted(flat[self.order], np.arange(self.shape[0] * self.shape[1] + 1))

    def cell(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x[:, :2] - self.low) / self.size).astype(int), 0, self.shape - 1)

    def within(self, at: np.ndarray, rings: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of places `at`, ascending, and of points: all pairs of a place and a point up to so many cells away."""
        cell = self.cell(at)
        rows = cell[:, :1] + np.arange(-rings, rings + 1)
        left = np.maximum(cell[:, 1:2] - rings, 0)
        right = np.minimum(cell[:, 1:2] + rings, self.shape[1] - 1)
        inside = (rows >= 0) & (rows < self.shape[0])
        row = np.where(inside, rows, 0) * self.shape[1]
        a = self.starts[row + left]
        n = np.where(inside, self.starts[row + right + 1] - a, 0).ravel()
        ends = np.cumsum(n)
        points = np.arange(ends[-1]) + np.repeat(a.ravel() - (ends - n), n)
        return np.repeat(np.repeat(np.arange(len(at)), 2 * rings + 1), n), self.order[points]

    def nearest(self, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Points and squared distances of the k nearest to each place (all, if fewer), by distance and number."""
        k = min(k, len(self.x))
        who, far = np.full((len(at), k), -1), np.full((len(at), k), np.inf)
        todo, rings = np.arange(len(at)), max(1, int(np.sqrt(k) / 2))
        while len(todo):
            again = []
            for a in range(0, len(todo), step := max(1, 400_000 // (rings * rings * 8 + k))):
                own = todo[a : a + step]
                j, b = self.within(at[own], rings)
                d = (at[own[j], 0] - self.x[b, 0]) ** 2
                for c in range(1, self.x.shape[1]):
                    d = d + (at[own[j], c] - self.x[b, c]) ** 2
                if not len(j):
                    again.append(own)
                    continue
                if k == 1:  # the first of the least of each
                    head = np.flatnonzero(np.append(True, j[1:] != j[:-1]))
                    order = np.flatnonzero(d == np.repeat(np.minimum.reduceat(d, head), np.diff(np.append(head, len(j)))))
                else:
                    order = np.lexsort((b, d, j))
                j, b, d = j[order], b[order], d[order]
                place = np.arange(len(j)) - np.searchsorted(j, j)
                first = place < k
                who[own[j[first]], place[first]], far[own[j[first]], place[first]] = b[first], d[first]
                # beyond the cells seen nothing is nearer than they reach
                sure = far[own, k - 1] < (rings * self.size * (1 - 1e-9)) ** 2
                again.append(own[~sure] if rings < self.shape.max() else own[:0])
            todo, rings = np.concatenate(again), rings * 2
        return who, far


def _spanning_tree(x: np.ndarray, neighbours: int) -> list[tuple[float, int, int]]:
    """Edges (length, a, b) of the least tree over mutual reachability, ascending; memory stays linear in the points.

    Equal points that have `neighbours` of them are one for the rest. A step looks at those that are left, and takes roots only of those that may come nearer.
    """
    n, many = len(x), len(x) > PLAIN and x.shape[1] > 2
    if many:
        t = Leaves(x)
        near = t.nearest(min(n, max(HELD, neighbours) + 1))
        core = np.empty(n)
        core[t.number] = np.sqrt(near[1][:, min(neighbours, n) - 1])
    else:
        core = np.sqrt(Near(x).nearest(x, min(neighbours, n))[1][:, -1])
    _, first, place = np.unique(x, axis=0, return_index=True, return_inverse=True)
    same = np.where(core == 0, first[place.ravel()], np.arange(n))
    edges = [(0.0, int(same[k]), int(k)) for k in np.flatnonzero(same != np.arange(n))]
    who = np.flatnonzero(same == np.arange(n))
    if not many:
        return sorted(edges + _grown(x, core, who))
    if len(who) < n:
        t = Leaves(x[who])
        near = t.nearest(min(len(who), HELD + 1))
    return sorted(edges + _grown_by_leaves(t, *near, core[who], who))


#: Points up to which a tree looks at all that are left in each step, as it does in two dimensions, where equal lengths are frequent and a grid finds what is near.
PLAIN = 4000
#: Nearest points of each that a larger tree starts from.
HELD = 12


def _grown(x: np.ndarray, core: np.ndarray, who: np.ndarray) -> list[tuple[float, int, int]]:
    """Edges of the least tree over the points `who`, in the order in which it grows from the first: always the nearest point (of equals that of the smallest number), from the earliest point that it is nearest to."""
    edges = []
    left, axes, near, source = np.ones(len(who), bool), np.ascontiguousarray(x[who].T), np.full(len(who), np.inf), np.zeros(len(who), int)
    limit, square, part = near.copy(), near.copy(), near.copy()
    at = 0
    for step in range(len(who) - 1):
        number, own, place = who[at], core[who[at]], axes[:, at].copy()
        left[at], near[at], limit[at] = False, np.inf, -1.0
        if step % 256 == 255:
            who, near, source, limit, axes = who[left], near[left], source[left], limit[left], np.ascontiguousarray(axes[:, left])
            square, part, left = square[: len(who)], part[: len(who)], np.ones(len(who), bool)
        np.subtract(axes[0], place[0], out=square)
        np.multiply(square, square, out=square)
        for axis, value in zip(axes[1:], place[1:], strict=True):
            np.subtract(axis, value, out=part)
            np.multiply(part, part, out=part)
            np.add(square, part, out=square)
        may = np.flatnonzero(square <= limit)
        reach = np.maximum(np.maximum(core[who[may]], own), np.sqrt(square[may]))
        closer = reach < near[may]
        may, reach = may[closer], reach[closer]
        near[may], source[may], limit[may] = reach, number, reach * reach * (1 + 1e-12)
        at = int(near.argmin())
        edges.append((float(near[at]), int(source[at]), int(who[at])))
    return edges


def _leaves(x: np.ndarray, size: int) -> list[np.ndarray]:
    """Numbers of points, ascending, by boxes of up to `size`, halved along their longest side."""
    todo, out = [np.arange(len(x))], []
    while todo:
        own = todo.pop()
        if len(own) <= size:
            out.append(np.sort(own))
            continue
        p = x[own]
        order = own[np.argpartition(p[:, (p.max(0) - p.min(0)).argmax()], len(own) // 2)]
        todo += [order[: len(own) // 2], order[len(own) // 2 :]]
    return out


class Leaves:
    """Points by boxes of a few, in any number of dimensions, for those nearest to all of a box."""

    def __init__(self, x: np.ndarray, size: int = 48) -> None:
        self.own = _leaves(x, size)
        self.starts = np.cumsum([0, *map(len, self.own)])
        self.number = np.concatenate(self.own)
        self.axes = np.ascontiguousarray(x[self.number].T)
        self.low, self.high = (np.array([f(self.axes[:, a:b], 1) for a, b in zip(self.starts[:-1], self.starts[1:], strict=True)]).T for f in (np.min, np.max))

    def away(self, leaf: int) -> np.ndarray:
        """Lower bounds of squared distances to each box."""
        gap = np.maximum(np.maximum(self.low - self.high[:, leaf, None], self.low[:, leaf, None] - self.high), 0.0)
        return (gap * gap).sum(0) * (1 - 1e-9)

    def places(self, leaves: np.ndarray) -> np.ndarray:
        return np.concatenate([np.arange(self.starts[b], self.starts[b + 1]) for b in leaves])

    def squares(self, at: np.ndarray, to: np.ndarray) -> np.ndarray:
        out = (self.axes[0, to] - self.axes[0, at, None]) ** 2
        for axis in self.axes[1:]:
            out += (axis[to] - axis[at, None]) ** 2
        return out

    def nearest(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and squared distances of the k nearest to each place, itself among them, ascending."""
        who, far = np.empty((len(self.number), k), int), np.empty((len(self.number), k))
        for leaf in range(len(self.own)):
            at = np.arange(self.starts[leaf], self.starts[leaf + 1])
            away = self.away(leaf)
            order = np.argsort(away, kind="stable")
            some = 1 + int(np.searchsorted(np.cumsum(np.diff(self.starts)[order]), 3 * k))
            while some < len(order):  # from the nearest boxes to all that can matter
                d = self.squares(at, self.places(order[:some]))
                enough = int(np.searchsorted(away[order], np.partition(d, k - 1, 1)[:, k - 1].max(), "right"))
                if enough <= some:
                    break
                some = min(enough, 4 * some)
            else:
                d = self.squares(at, self.places(order))
            to = self.places(order[:some])
            pick = np.argpartition(d, k - 1, 1)[:, :k]
            d = np.take_along_axis(d, pick, 1)
            rank = np.argsort(d, 1, kind="stable")
            who[at], far[at] = to[np.take_along_axis(pick, rank, 1)], np.take_along_axis(d, rank, 1)
        return who, far


def _grown_by_leaves(t: Leaves, who: np.ndarray, far: np.ndarray, core: np.ndarray, own: np.ndarray) -> list[tuple[float, int, int]]:
    """The edges of _grown for many points: each one's nearest (who, far: as t.nearest has them), and between groups of points that are apart the shortest ways, found in boxes, hold a least tree, which then grows
    along them. core: of each point; own: what the points are called, ascending.

    Ways of exactly the same length are all there among each one's nearest points and as the shortest of a group.
    """
    n, k, core = len(own), who.shape[1], core[t.number]
    reach = np.maximum(np.maximum(core[:, None], core[who]), np.sqrt(far))
    beyond = np.maximum(core, np.sqrt(far[:, -1])) if k < n else np.full(n, np.inf)
    group, extra = np.arange(n), []
    leaf_of = np.repeat(np.arange(len(t.own)), np.diff(t.starts))
    while group.any():
        out = np.where(group[who] != group[:, None], reach, np.inf)
        least = out.min(1)
        best = np.full(n, np.inf)
        np.minimum.at(best, group, least)
        largest = np.bincount(group).argmax()
        ask = (beyond <= best[group]) & (group != largest)
        one = np.minimum.reduceat(group, t.starts[:-1])
        one = np.where(one == np.maximum.reduceat(group, t.starts[:-1]), one, -1)  # the group that has all of a box
        found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        for leaf in np.unique(leaf_of[ask]):
            asking = np.flatnonzero(ask[t.starts[leaf] : t.starts[leaf + 1]]) + t.starts[leaf]
            box = np.sqrt(t.away(leaf))
            for g in np.unique(group[asking]):
                at = asking[group[asking] == g]
                at = at[beyond[at] <= best[g]]
                order = np.flatnonzero((one != g) & (box <= best[g]))
                order = order[np.argsort(box[order], kind="stable")]
                for a in range(0, len(order) if len(at) else 0, 8):
                    if box[order[a]] > best[g]:
                        break
                    to = t.places(order[a : a + 8])
                    to = to[group[to] != g]
                    d = np.maximum(np.maximum(core[to], core[at, None]), np.sqrt(t.squares(at, to)))
                    best[g] = min(best[g], d.min())
                    i, j = np.nonzero(d <= best[g])
                    found.append((at[i], to[j], d[i, j]))
        i, j, d = (np.concatenate(f) for f in zip(*found, strict=True))
        keep = d == best[group[i]]
        extra.append((i[keep], j[keep], d[keep]))
        a, c = np.nonzero((out == best[group][:, None]) & (out < np.inf) & (group != largest)[:, None])
        group = _joined(group, np.concatenate([a, i[keep]]), np.concatenate([who[a, c], j[keep]]))
    i, j, d = (np.concatenate(f) for f in zip((np.repeat(np.arange(n), k), who.ravel(), reach.ravel()), *extra, strict=True))
    i, j = t.number[np.concatenate([i, j])], t.number[np.concatenate([j, i])]  # in the order of the points' numbers, too
    d = np.concatenate([d, d])
    i, j, d = i[i != j], j[i != j], d[i != j]
    order = np.lexsort((j, d, i))
    i, j, d = i[order], j[order], d[order]
    at, end = (np.searchsorted(i, np.arange(n), side).tolist() for side in ("left", "right"))
    j, d = j.tolist(), d.tolist()
    edges, inside, rank, heap, new = [], [False] * n, [0] * n, [], 0
    for joined in range(n):
        inside[new], rank[new], source = True, joined, new
        while joined < n - 1:  # a point in the heap has its next way out there
            a, b = at[source], end[source]
            while a < b and inside[j[a]]:
                a += 1
            at[source] = a
            if a < b:
                heappush(heap, (d[a], j[a], rank[source], source))
            length, new, _, source = heappop(heap)
            if not inside[new]:
                edges.append((length, int(own[source]), int(own[new])))
                heappush(heap, (length, new, rank[source], source))  # comes back once new is inside
                break
    return edges


def _joined(group: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Groups, named by their least member's name, after those of a and b have become one."""
    name = np.arange(group.max() + 1)
    a, b = group[a], group[b]
    while True:
        low = np.minimum(name[a], name[b])
        before = name.copy()
        np.minimum.at(name, name[a], low)
        np.minimum.at(name, name[b], low)
        while (name[name] != name).any():
            name = name[name]
        if (name == before).all():
            return name[group]


def stable_clusters(x: np.ndarray, least: int, neighbours: int, epsilon: float = 0.0, tree: list[tuple[float, int, int]] | None = None) -> np.ndarray:
    """Labels from 1, 0 for noise, of the clusters that persist longest over falling density (the root is none).

    Groups merge along the tree; a merge of two groups of `least` or more closes both, and their stability is compared
    with that of the group they form; ties go to the larger group. Groups that merge nearer than epsilon are not told apart.
    """
    n = len(x)
    labels = np.zeros(n, int)
    if n < max(least, 2):
        return labels
    parent = list(range(n))
    members = {i: [i] for i in range(n)}
    # of each group of `least` points or more: stability so far, density at birth of its present set, best disjoint choice
    state: dict[int, dict] = {}

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def closed(root: int, density: float) -> tuple[float, tuple]:
        """Stability and choice of a group that ends at this density: its members, which are the first so many of a list that only grows, or a pair of choices."""
        s = state[root]
        own = s["sum"] - len(members[root]) * density
        return max(own, s["below"]), (members[root], len(members[root])) if s["near"] or own >= s["below"] else s["choice"]

    edges = _spanning_tree(x, neighbours) if tree is None else tree
    for k, (length, a, b) in enumerate(edges):
        density = 1 / max(length, 1e-12)
        a, b = find(a), find(b)
        if len(members[a]) < len(members[b]):
            a, b = b, a
        below, choice, total, near = 0.0, None, None, False
        if a in state and b in state:
            (sa, ca), (sb, cb) = closed(a, density), closed(b, density)
            below, choice, near = sa + sb, (ca, cb), length < epsilon
        elif a in state:
            total, below, choice, near = state[a]["sum"] + len(members[b]) * density, state[a]["below"], state[a]["choice"], state[a]["near"]
        parent[b] = a
        members[a] += members.pop(b)
        state.pop(b, None)
        if len(members[a]) >= least:
            state[a] = {"sum": len(members[a]) * density if total is None else total, "below": below, "choice": choice, "near": near}
        if k == len(edges) - 1:
            chosen, todo = [], [state[a]["choice"]]
            while todo:
                who, more = todo.pop() or ([], 0)
                if isinstance(more, int):
                    chosen.append(sorted(who[:more]))
                else:
                    todo += who, more
            for c, who in enumerate(sorted(filter(None, chosen), key=lambda w: w[0]), 1):
                labels[who] = c
    return labels


def split_large(x: np.ndarray, labels: np.ndarray, most: int, rounds: int = 50) -> np.ndarray:
    """Clusters over `most` points in ceil(n / most) parts by k-means from farthest points; the first part keeps the label."""
    out, new = labels.copy(), int(labels.max(initial=0)) + 1
    for lab in np.unique(labels[labels > 0]):
        who = np.flatnonzero(labels == lab)
        k = -(-len(who) // most)
        if k < 2:
            continue
        p = x[who]
        centres, away = p[[0]], np.full(len(p), np.inf)
        while len(centres) < k:
            away = np.minimum(away, ((p - centres[-1]) ** 2).sum(1))
            centres = np.vstack([centres, p[away.argmax()]])
        part, step = np.full(len(p), -1), max(1, 2_000_000 // k)
        for _ in range(rounds):
            now = np.concatenate([((p[a : a + step, None] - centres[None]) ** 2).sum(2).argmin(1) for a in range(0, len(p), step)])
            if (now == part).all():
                break
            part = now
            own = np.split(np.argsort(part, kind="stable"), np.cumsum(np.bincount(part, minlength=k))[:-1])
            centres = np.array([p[own[c]].mean(0) if len(own[c]) else centres[c] for c in range(k)])
        for c in range(1, k):
            out[who[part == c]] = new
            new += 1
    return out


def _scaled(g: pd.DataFrame, features: tuple[tuple[str, float], ...]) -> tuple[np.ndarray, np.ndarray]:
    """z-scores times weights of the rows whose features are finite, and which rows these are."""
    x = g[[f for f, _ in features]].to_numpy(float)
    ok = np.isfinite(x).all(1)
    z = x[ok]
    return (z - z.mean(0)) / np.maximum(z.std(0), 1e-6) * np.array([w for _, w in features]) if len(z) else z, ok


def density_clusters(d: DataFrame, least: int = 3, neighbours: int = 2, most: int = 40, keys: tuple[str, ...] = ("video_id", "frame_id"), features: tuple[tuple[str, float], ...] = (("pos_n", 1.0), ("pos_e", 1.0)), epsilon: float = 0.0) -> DataFrame:
    """row_id, cluster (null for noise) by frame over z-scored features times their weights, such as places and velocities; a frame of fewer than `least` rows, or rows without finite features, are noise."""
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("row_id")
        z, ok = _scaled(g, features)
        labels = np.zeros(len(g), int)
        if len(z):
            labels[ok] = split_large(z, stable_clusters(z, least, min(neighbours, least), epsilon), most)
        return pd.DataFrame({"row_id": g["row_id"], "cluster": pd.array(np.where(labels > 0, labels, -1), dtype="Int64").astype("Int64")}).replace({"cluster": {-1: pd.NA}})
    return d.select(*keys, "row_id", *(f for f, _ in features)).groupBy(*keys).applyInPandas(run, "row_id long, cluster long")


def by_street(d: DataFrame, street: str = "street_index", stride: int = 10_000, **clustering) -> DataFrame:
    """row_id, crowd: clusters within each street and frame, their numbers in the street's own range; people outside of streets (0 or null) have none."""
    inside = d.filter(F.col(street) > 0)
    found = density_clusters(inside, keys=("video_id", "frame_id", street), **clustering)
    return d.select("row_id", street).join(found, "row_id", "left").select("row_id", (F.col(street).cast("bigint") * stride + F.col("cluster")).alias("crowd"))


def macro_states(d: DataFrame, clusters: DataFrame) -> DataFrame:
    """video_id, frame_id, label, n, e, vn, ve (medians of a cluster) and sd_n, sd_e, sd_vn, sd_ve (deviations over the frame) of rows (video_id, frame_id, row_id, n, e, vn, ve); a frame without clusters has one row with a null label."""
    columns, keys = ("n", "e", "vn", "ve"), ["video_id", "frame_id"]
    spread = d.groupBy(*keys).agg(*(F.greatest(F.stddev_pop(c), F.lit(1e-6)).alias(f"sd_{c}") for c in columns))
    own = d.join(clusters.filter("cluster is not null"), "row_id").groupBy(*keys, F.col("cluster").alias("label")).agg(*(F.median(c).alias(c) for c in columns))
    return spread.join(own, keys, "left")


def search_parameters(d: DataFrame, trials: list[tuple[int, int]], weights: tuple[float, float] = (50.0, 2.0)) -> DataFrame:
    """trial, least, neighbours, cost of each pair of parameters, all trials at once: share of people without a cluster and spread of clusters per frame, weighted."""
    spark = d.sparkSession

    def run(g: pd.DataFrame) -> pd.DataFrame:
        z, ok = _scaled(g.sort_values("row_id"), (("pos_n", 1.0), ("pos_e", 1.0)))
        trees = {k: _spanning_tree(z, k) for k in {min(neighbours, least) for least, neighbours in trials if len(z) >= max(least, 2)}}
        found = [np.bincount(split_large(z, stable_clusters(z, least, min(neighbours, least), tree=trees.get(min(neighbours, least))), 40), minlength=1) for least, neighbours in trials]
        return pd.DataFrame({"trial": range(len(trials)), "noise": [int(f[0]) + int((~ok).sum()) for f in found], "n": len(g), "clusters": [int((f[1:] > 0).sum()) for f in found]})

    per = d.select("video_id", "frame_id", "row_id", "pos_n", "pos_e").groupBy("video_id", "frame_id").applyInPandas(run, "trial int, noise long, n long, clusters long")
    cost = weights[0] * F.sum("noise") / F.sum("n") + weights[1] * F.stddev_pop("clusters")
    names = spark.createDataFrame([(k, *t) for k, t in enumerate(trials)], "trial int, least int, neighbours int")
    return names.join(per.groupBy("trial").agg(F.round(cost, 6).alias("cost")), "trial", "left")


def convex_hull(p: np.ndarray) -> np.ndarray:
    """Corners in order, by monotone chains."""
    p = np.unique(p, axis=0)
    if len(p) < 3:
        return p

    def chain(points):
        out: list[np.ndarray] = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]
    return np.array(chain(p) + chain(p[::-1]))


def polygon_area(p: np.ndarray) -> float:
    n, e = p[:, 0], p[:, 1]
    return float(abs(n @ np.roll(e, -1) - e @ np.roll(n, -1)) / 2)


def occupied_area(p: np.ndarray, least: float = 1.0) -> float:
    """Area that people at p take, `least` at least: of their convex hull; the circle over two of them; of three or more in a line the circle around their mean that holds all."""
    if len(p) < 2:
        return least
    if len(p) == 2:
        return max(least, float(np.pi * ((p[0] - p[1]) ** 2).sum() / 4))
    hull = convex_hull(p)
    area = polygon_area(hull) if len(hull) > 2 else 0.0
    return max(least, area if area > 1e-9 else float(np.pi * ((p - p.mean(0)) ** 2).sum(1).max()))


def hull_areas(d: DataFrame) -> DataFrame:
    """video_id, frame_id, crowd_id, n, area of each crowd; rows without a place don't count for the area."""
    def run(g: pd.DataFrame) -> pd.DataFrame:
        area = occupied_area(g[["pos_n", "pos_e"]].dropna().to_numpy(float))
        return pd.DataFrame({**{k: [g[k].iloc[0]] for k in ("video_id", "frame_id", "crowd_id")}, "n": [len(g)], "area": [round(float(area), 6)]})
    keys = ("video_id", "frame_id", "crowd_id")
    return d.select(*keys, "pos_n", "pos_e").groupBy(*keys).applyInPandas(run, "video_id int, frame_id int, crowd_id int, n long, area double")


def cell_area(p: np.ndarray, k: int, box: tuple[np.ndarray, np.ndarray]) -> float:
    """Area of the part of the box that is nearer to point k than to any other, by cutting the box with half planes, nearest points first."""
    (n0, e0), (n1, e1) = box
    cell = np.array([(n0, e0), (n0, e1), (n1, e1), (n1, e0)])
    away = ((p - p[k]) ** 2).sum(1)
    for j in np.argsort(away, kind="stable"):
        if not away[j] > 0:
            continue
        if away[j] > 4 * ((cell - p[k]) ** 2).sum(1).max():
            break
        side = (cell - (p[k] + p[j]) / 2) @ (p[j] - p[k])
        out = []
        for a in range(len(cell)):
            b = (a + 1) % len(cell)
            if side[a] <= 0:
                out.append(cell[a])
            if (side[a] < 0 < side[b]) or (side[b] < 0 < side[a]):
                out.append(cell[a] + (cell[b] - cell[a]) * side[a] / (side[a] - side[b]))
        cell = np.array(out)
        if len(cell) < 3:
            return 0.0
    return polygon_area(cell)


def cell_areas(p: np.ndarray, box: tuple[np.ndarray, np.ndarray], first: int = 16) -> np.ndarray:
    """cell_area of each point. Equal points have one cell. All cells are cut side by side, by a few of their nearest; if farther points can reach a cell, by those that are nearer to one of its corners than its own,
    until there are none."""
    middle = (box[0] + box[1]) / 2
    q, place = np.unique(p - middle, axis=0, return_inverse=True)
    (n0, e0), (n1, e1) = box - middle
    extent = float(np.hypot(n1 - n0, e1 - e0))
    near, areas, upto = Near(q), np.zeros(len(q)), min(len(q), first)
    for a in range(0, len(q), 10_000):
        live = np.arange(a, min(len(q), a + 10_000))
        who, away = near.nearest(q[live], upto)
        c, n = np.broadcast_to(np.array([(n0, e0), (n0, e1), (n1, e1), (n1, e0)], float), (len(live), 4, 2)), np.full(len(live), 4)
        for j in range(1, upto):
            used = np.arange(c.shape[1]) < n[:, None]
            over = away[live - a, j] > 4 * np.where(used, ((c - q[live, None]) ** 2).sum(2), -1).max(1)
            areas[live[over]] = _areas(c[over], n[over])
            live, c, n = live[~over], c[~over], n[~over]
            c, n = _cut(c, n, q[live], q[who[live - a, j]])
        while len(live):
            row, corner = np.nonzero(np.arange(c.shape[1]) < n[:, None])
            at = c[row, corner]
            who_at, least = near.nearest(at, 1)
            gain = np.full(c.shape[:2], -1.0)
            own = ((at - q[live[row]]) ** 2).sum(1)
            gain[row, corner] = np.where(own - least[:, 0] > 1e-10 * own + 1e-12 * extent * np.sqrt(own), own - least[:, 0], -1.0)
            other = np.zeros(c.shape[:2], int)
            other[row, corner] = who_at[:, 0]
            worst = gain.argmax(1)
            over = (gain.max(1) <= 0) | (n < 3)
            areas[live[over]] = _areas(c[over], n[over])
            by = other[np.arange(len(live)), worst][~over]
            live, c, n = live[~over], c[~over], n[~over]
            c, n = _cut(c, n, q[live], q[by])
    return areas[place.ravel()]


def _cut(cell: np.ndarray, size: np.ndarray, own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners (a cell a row, the first `size` count) of what is nearer to own than to other."""
    mid, to = (own + other) / 2, other - own
    used = np.arange(cell.shape[1]) < size[:, None]
    side = np.where(used, (cell[:, :, 0] - mid[:, None, 0]) * to[:, None, 0] + (cell[:, :, 1] - mid[:, None, 1]) * to[:, None, 1], -1.0)
    cut = np.flatnonzero((side > 0).any(1))
    if not len(cut):
        return np.array(cell), size
    c, n, s, used = cell[cut], size[cut], side[cut], used[cut]
    after = np.where(np.arange(c.shape[1]) + 1 < n[:, None], np.arange(c.shape[1]) + 1, 0)
    s2, c2 = np.take_along_axis(s, after, 1), np.take_along_axis(c, after[:, :, None], 1)
    crossing = used & (((s < 0) & (0 < s2)) | ((s2 < 0) & (0 < s)))
    share = np.where(crossing, s / np.where(crossing, s - s2, 1.0), 0.0)
    both = np.stack([c, c + (c2 - c) * share[:, :, None]], 2).reshape(len(cut), -1, 2)
    held = np.stack([used & (s <= 0), crossing], 2).reshape(len(cut), -1)
    count = held.sum(1)
    width = max(cell.shape[1], int(count.max()))
    new, out = np.zeros((len(cut), width, 2)), np.zeros((len(cell), width, 2))
    row, col = np.nonzero(held)
    new[row, (np.cumsum(held, 1) - 1)[row, col]] = both[row, col]
    out[:, : cell.shape[1]] = cell
    out[cut] = new
    size = size.copy()
    size[cut] = count
    return out, size


def _areas(cell: np.ndarray, size: np.ndarray) -> np.ndarray:
    used = np.arange(cell.shape[1]) < size[:, None]
    after = np.where(np.arange(cell.shape[1]) + 1 < size[:, None], np.arange(cell.shape[1]) + 1, 0)
    c = np.where(used[:, :, None], cell - cell[:, :1], 0.0)
    c2 = np.take_along_axis(c, after[:, :, None], 1)
    return np.where(size < 3, 0.0, np.abs((c[:, :, 0] * c2[:, :, 1] - c[:, :, 1] * c2[:, :, 0]).sum(1)) / 2)


def voronoi_density(d: DataFrame, least: float = 0.01, most: float = 200.0, margin: float = 5.0) -> DataFrame:
    """row_id, density (1 / area of its cell within the frame's bounds and a margin, the area held within least and most); one place alone has `most`, of two each max(5 x distance, 1)."""
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("row_id").replace([np.inf, -np.inf], np.nan).dropna(subset=["pos_n", "pos_e"])
        p = g[["pos_n", "pos_e"]].to_numpy(float)
        if len(p) == 1:
            area = np.array([most])
        elif len(p) == 2:
            area = np.full(2, max(5 * float(np.hypot(*(p[0] - p[1]))), 1.0))
        else:
            box = (p.min(0) - margin, p.max(0) + margin) if len(p) else None
            area = np.clip(cell_areas(p, box), least, most) if len(p) else p[:, 0]
        return pd.DataFrame({"row_id": g["row_id"], "density": np.round(1 / np.asarray(area, float), 4)})
    return d.select("video_id", "frame_id", "row_id", "pos_n", "pos_e").groupBy("video_id", "frame_id").applyInPandas(run, "row_id long, density double")
