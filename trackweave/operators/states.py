"""Stateful operators: Kalman tracks, cluster identities, shortest arrival times."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from trackweave.sources.shared import settled


@dataclass(frozen=True)
class Kalman:
    """A constant-velocity filter on three axes that don't interact: variances of measurements by axis, and of acceleration.

    A track's state is a row of 16 numbers: its frame, and for each axis place, velocity, and the three numbers of their covariance. Functions take many tracks at once, a row each.
    """

    fps: float = 24.0
    accel: float = 0.5
    sigma: tuple[float, float, float] = (5.0, 5.0, 2.0)

    def begun(self, frame: np.ndarray, z: np.ndarray) -> np.ndarray:
        """States of tracks at their first rows."""
        out = np.zeros((len(z), 6, 3))
        out[:, 0, 0], out[:, 1], out[:, 3], out[:, 5] = frame, z, 25.0, 4.0
        return out

    def advanced(self, state: np.ndarray, frame: np.ndarray, z: np.ndarray) -> np.ndarray:
        """States after the next row of each. A gap of g frames is g predictions, in closed form; a repeated frame none. Axes of equal noise have equal gains, as these don't depend on what is measured."""
        g = (frame - state[:, 0, 0]).astype(float)[:, None]
        dt, q, r = 1 / self.fps, self.accel**2, np.array(self.sigma) ** 2
        _, x, v, p00, p01, p11 = (state[:, k] for k in range(6))
        t = g * dt
        x = x + t * v
        p00 = p00 + 2 * t * p01 + t * t * p11 + q * dt**4 * (g / 4 + g * (g - 1) / 2 + g * (g - 1) * (2 * g - 1) / 6)
        p01 = p01 + t * p11 + q * dt**3 * (g / 2 + g * (g - 1) / 2)
        p11 = p11 + q * dt**2 * g
        gain, lift, off = p00 / (p00 + r), p01 / (p00 + r), z - x
        out = np.stack([np.zeros_like(x), x + gain * off, v + lift * off, p00 - gain * p00, p01 - gain * p01, p11 - lift * p01], 1)
        out[:, 0, 0] = frame
        return out


FILTERED = tuple(f"kf_{x}" for x in ("n", "e", "d", "vn", "ve", "vd"))


def _filtered(batches: Iterator[pd.DataFrame], k: Kalman) -> Iterator[pd.DataFrame]:
    """Rows sorted by track, frame and row: all tracks of a batch go on side by side, a row of each at a time; the last one's state is carried to the next batch."""
    last, held = None, None
    for b in batches:
        if not len(b):
            continue
        track, frame, z = b["track_id"].to_numpy(), b["frame_id"].to_numpy(), b[["pos_n", "pos_e", "pos_d"]].to_numpy(float)
        starts = np.flatnonzero(np.concatenate([[True], track[1:] != track[:-1]]))
        lengths = np.diff(np.append(starts, len(b)))
        out, order = np.empty((len(b), 6)), np.argsort(-lengths, kind="stable")
        begin, lengths = starts[order], lengths[order]
        state = k.begun(frame[begin], z[begin])
        if held is not None and track[0] == last:
            at = int(np.flatnonzero(begin == 0)[0])
            state[at] = k.advanced(held[None], frame[:1], z[:1])[0]
        final = state.copy()
        for j in range(int(lengths[0])):
            live = int(np.searchsorted(-lengths, -j, side="left"))
            rows = begin[:live] + j
            if j:
                state = k.advanced(state[:live], frame[rows], z[rows])
                final[:live] = state
            out[rows] = state[:live, 1:3].reshape(live, 6)
        last, held = track[-1], final[int(np.argmax(begin))]
        yield pd.DataFrame({"row_id": b["row_id"], "track_id": track, **{c: out[:, i] for i, c in enumerate(FILTERED)}})


def kalman_tracks(d: DataFrame, fps: float = 24.0, accel: float = 0.5, sigma: float = 5.0, sigma_down: float = 2.0) -> DataFrame:
    """row_id, track_id, smoothed place (kf_n, kf_e, kf_d) and velocity by track, in order of frame and row. A track passes as a stream of batches, so a long one isn't held."""
    k = Kalman(fps, accel, (sigma, sigma, sigma_down))
    x = d.select("row_id", "track_id", "frame_id", "pos_n", "pos_e", "pos_d").repartition("track_id").sortWithinPartitions("track_id", "frame_id", "row_id")
    return x.mapInPandas(lambda batches: _filtered(batches, k), "row_id long, track_id long, " + ", ".join(f"{c} double" for c in FILTERED))


#: Rows up to which each looks for its way at once.
FEW = 256


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of least total cost (Hungarian method with potentials); all of the smaller side are assigned."""
    if cost.shape[0] > cost.shape[1]:
        return [(b, a) for a, b in assignment(cost.T)]
    n, m = cost.shape
    if n > FEW:
        return _assignment_of_many(np.ascontiguousarray(cost, float))
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        slack, seen, way = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while match[j0]:
            seen[j0] = True
            reduced = cost[match[j0] - 1] - u[match[j0]] - v[1:]
            better = ~seen[1:] & (reduced < slack[1:])
            slack[1:][better], way[1:][better] = reduced[better], j0
            free = np.where(seen[1:], np.inf, slack[1:])
            j1 = int(free.argmin()) + 1
            delta = free[j1 - 1]
            u[match[seen]] += delta
            v[seen] -= delta
            slack[~seen] -= delta
            j0 = j1
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]


def _assignment_of_many(cost: np.ndarray) -> list[tuple[int, int]]:
    """As assignment, for no more rows than columns: first each row bids for its cheapest column at the price by which that beats its second, and a row that is outbid bids again; only rows that are left without a column
    then look for the shortest way to one. Columns without a row keep the price 0."""
    n, m = cost.shape
    price, row_of, column_of = np.zeros(m), np.full(m, -1), np.full(n, -1)
    todo = list(range(n))
    for _ in range(2):
        waiting, todo = todo[::-1], []
        bids = 0
        while waiting:
            i = waiting.pop()
            net = cost[i] - price
            j = int(net.argmin())
            first, net[j] = net[j], np.inf
            other = int(net.argmin())
            second = net[other]
            tie = not first < second
            if tie and row_of[j] >= 0:
                j = other
            out, bids = int(row_of[j]), bids + 1
            if not tie and np.isfinite(second):
                price[j] -= second - first
            row_of[j], column_of[i] = i, j
            if out >= 0:
                column_of[out] = -1
                (todo if tie or bids > 4 * n else waiting).append(out)
    near = np.empty(m)
    for i in np.flatnonzero(column_of < 0).tolist():
        far, open_ = np.full(m, np.inf), price.copy()
        rows, bases, seen, seen_at = [i], [0.0], [], []
        while True:
            np.subtract(cost[rows[-1]], open_, out=near)  # infinite where a column is seen
            near += bases[-1]
            np.minimum(far, near, out=far)
            j = int(far.argmin())
            length = far[j]
            if row_of[j] < 0:
                break
            seen.append(j)
            seen_at.append(length)
            rows.append(int(row_of[j]))
            bases.append(length - (cost[rows[-1], j] - price[j]))
            far[j], open_[j] = np.inf, -np.inf
        rows, bases, upto = np.array(rows), np.array(bases), len(seen)
        while True:  # back along the rows that each column was nearest to
            k = int((cost[rows[: upto + 1], j] - price[j] + bases[: upto + 1]).argmin())
            row_of[j], column_of[rows[k]] = rows[k], j
            if not k:
                break
            j, upto = seen[k - 1], k - 1
        price[seen] -= length - np.array(seen_at)
    return [(int(row_of[j]), j) for j in range(m) if row_of[j] >= 0]


def cluster_identity(states: DataFrame, key: str, limit: float = 6.0, memory: int = 5, keep: float = 0.6) -> DataFrame:
    """Identities of clusters (key, frame_id, label, centre_n, centre_e) that last over frames: centres are matched to remembered ones at least cost
    within the limit, remembered centres follow with weight 1 - keep, and are forgotten after `memory` frames unseen. Sequential over frames, so a row per cluster, not per detection, goes in."""
    def run(g: pd.DataFrame) -> pd.DataFrame:
        held: dict[int, list] = {}
        new, out = 1, []
        g = g.sort_values(["frame_id", "label"])
        frames = {f: x for f, x in g.groupby("frame_id")}
        for f in range(int(g["frame_id"].min()), int(g["frame_id"].max()) + 1):
            now = frames.get(f)
            found: dict[int, int] = {}
            if now is not None:
                c, ids = now[["centre_n", "centre_e"]].to_numpy(), sorted(held)
                if ids:
                    cost = np.hypot(*(np.array([held[i][0] for i in ids])[:, None, :] - c[None]).transpose(2, 0, 1))
                    found = {b: ids[a] for a, b in assignment(cost) if cost[a, b] <= limit}
                for k in range(len(c)):
                    if k in found:
                        held[found[k]] = [keep * held[found[k]][0] + (1 - keep) * c[k], -1]
                    else:
                        found[k] = new
                        held[new] = [c[k], -1]
                        new += 1
                out += [(f, lab, found[k]) for k, lab in enumerate(now["label"])]
            for i in list(held):
                held[i][1] += 1
                if held[i][1] >= memory:
                    del held[i]
        r = pd.DataFrame(out, columns=["frame_id", "label", "identity"])
        r[key] = g[key].iloc[0]
        return r[[key, "frame_id", "label", "identity"]]
    return states.groupBy(key).applyInPandas(run, f"{key} int, frame_id int, label int, identity int")


def moving_identity(clusters: DataFrame, key: str = "video_id", weight: float = 1.5, limit: float = 5.0, memory: int = 30, alpha: float = 0.7) -> DataFrame:
    """key, frame_id, label, identity of clusters (as crowds.macro_states gives them) that last over frames.

    The cost of taking a cluster for a remembered one is the distance of their places plus weight times that of their velocities, each axis over the frame's deviation;
    pairs are of least total cost, and none beyond the limit counts. Those remembered follow with alpha and are forgotten after `memory` frames unseen, frames without clusters included.
    Sequential over the frames of a key, with a row per cluster; frames that aren't there don't count. No rows give none.
    """
    places, spread = ["n", "e", "vn", "ve"], ["sd_n", "sd_e", "sd_vn", "sd_ve"]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        held: dict[int, tuple[np.ndarray, int]] = {}
        new, out = 1, []
        for frame, rows in g.sort_values(["frame_id", "label"]).groupby("frame_id", sort=True):
            rows = rows[rows["label"].notna()]
            now, found = rows[places].to_numpy(float), {}
            if len(now) and held:
                ids = list(held)
                known, sd = np.array([held[i][0] for i in ids]), rows[spread].iloc[0].to_numpy(float)
                n, e, vn, ve = ((known[:, None, k] - now[None, :, k]) / sd[k] for k in range(4))  # one after the other
                cost = np.hypot(n, e) + weight * np.hypot(vn, ve)
                found = {b: ids[a] for a, b in assignment(cost) if cost[a, b] <= limit}
            for k, state in enumerate(now):
                if k in found:
                    state = alpha * state + (1 - alpha) * held[found[k]][0]
                else:
                    found[k], new = new, new + 1
                held[found[k]] = (state, -1)
            held = {i: (state, age + 1) for i, (state, age) in held.items() if age + 1 < memory}
            out += [(frame, int(label), found[k]) for k, label in enumerate(rows["label"])]
        r = pd.DataFrame(out, columns=["frame_id", "label", "identity"])
        r.insert(0, key, g[key].iloc[0])
        return r
    return clusters.select(key, "frame_id", "label", *places, *spread).groupBy(key).applyInPandas(run, f"{key} int, frame_id int, label long, identity long")


def stabilised(d: DataFrame, street: str = "street_index", limit: float = 40.0, memory: int = 30, weight: float = 0.4) -> DataFrame:
    """street, frame_id, crowd_id, stable_id of crowds (street, frame_id, crowd_id, n, e: their centres in metres) that keep a number over a street's frames.

    Centres are matched at least cost within the limit; those remembered follow with `weight` and are forgotten after `memory` frames unseen, counting frames that have crowds. A new crowd keeps its own number, also if another
    is remembered under it, which it then replaces; it is a frame old at once. Sequential over the frames of a street, with a row per crowd.
    """
    def run(g: pd.DataFrame) -> pd.DataFrame:
        held: dict[int, tuple[np.ndarray, int]] = {}
        out = []
        for frame, now in g.sort_values(["frame_id", "crowd_id"]).groupby("frame_id", sort=True):
            ids, centres = now["crowd_id"].tolist(), now[["n", "e"]].to_numpy(float)
            known, seen, stable = list(held), set(), list(ids)
            if known:
                cost = np.sqrt(((np.array([held[k][0] for k in known])[:, None] - centres[None]) ** 2).sum(2))
                for a, b in assignment(cost):
                    if cost[a, b] <= limit:
                        stable[b] = known[a]
                        seen.add(b)
                        held[known[a]] = (weight * centres[b] + (1 - weight) * held[known[a]][0], -1)
            hit = {stable[b] for b in seen}
            for b, own in enumerate(ids):
                if b not in seen:
                    held[own] = (centres[b], 0)
            held = {k: (c, 0 if k in hit else age + 1) for k, (c, age) in held.items() if k in hit or age + 1 < memory}
            out += [(frame, own, new) for own, new in zip(ids, stable, strict=True)]
        r = pd.DataFrame(out, columns=["frame_id", "crowd_id", "stable_id"])
        r.insert(0, street, g[street].iloc[0])
        return r
    return d.select(street, "frame_id", "crowd_id", "n", "e").groupBy(street).applyInPandas(run, f"{street} int, frame_id int, crowd_id long, stable_id long")


def farthest_order(d: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """key, order, rank: rows of a group from the first on, each the farthest from the one before among those left (the first of equals). A group goes to one task, as each pick needs the last."""
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order).reset_index(drop=True)
        x, left, at, picked = g[columns].to_numpy(float), np.ones(len(g), bool), 0, []
        for _ in range(len(g)):
            picked.append(at)
            left[at] = False
            if left.any():
                at = int(np.where(left, ((x - x[at]) ** 2).sum(1), -1).argmax())
        return pd.DataFrame({key: g[key], order: g[order]}).iloc[picked].assign(rank=range(len(picked)))
    kinds = dict(d.dtypes)
    return d.select(key, order, *columns).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, rank int")


def distances_to(edges: DataFrame, target: int) -> DataFrame:
    """node, dist: least length from each node to the target, of edges src, dst, length; see paths.shortest_tree."""
    from trackweave.operators.paths import shortest_tree

    return shortest_tree(edges, [target]).select("node", "dist")


def arrival_times(starts: DataFrame, edges: DataFrame, dist: DataFrame, least_speed: float = 0.5, cone: float = 90.0) -> DataFrame:
    """row_id, distance and seconds of walkers (row_id, node, heading_deg, speed) over their first edges within the cone of their heading (all, if none is or the heading is unknown)."""
    bearing = F.pmod(F.degrees(F.atan2(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))), F.lit(360.0))
    first = edges.select(F.col("src").alias("node"), "dst", "length", bearing.alias("bearing")).join(dist.select(F.col("node").alias("dst"), "dist"), "dst")
    turn = F.pmod(F.col("bearing") - F.col("heading_deg"), F.lit(360.0))
    x = starts.join(first, "node").withColumn("_ahead", F.coalesce(F.least(turn, 360 - turn) <= cone, F.lit(True)))
    best = x.groupBy("row_id", "speed").agg(F.min(F.when(F.col("_ahead"), F.col("length") + F.col("dist"))).alias("_cone"), F.min(F.col("length") + F.col("dist")).alias("_any"))
    d = F.coalesce("_cone", "_any")
    return best.select("row_id", F.round(d, 2).alias("distance_m"), F.round(d / F.greatest("speed", F.lit(least_speed)), 1).alias("eta_s"))
