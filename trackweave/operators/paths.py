"""Shortest paths over a distributed graph: trees to several targets, routes of walkers, and paths as rows.

A tree is relaxed by blocks of nearby nodes. Within a block a small helper goes on to the end (a block has a bounded number of nodes: those of a grid cell, or of a range of ids); between
blocks, changed nodes alone are joined to the edges that leave their block. So rounds follow the blocks that a path crosses, not its hops, and a round touches only blocks that something
new has reached. Paths are unrolled by doubling: tables of 1, 2, 4, ... steps, and from the largest down each row of a path adds the one that many steps on.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from trackweave.sources.shared import kept

#: Nodes' ids in a block, where no places are known.
RANGE = 4096
LABEL = ("dist", "hops", "next")
TREE = "target bigint, node bigint, block string, dist double, hops bigint, next bigint"


def _blocks(edges: DataFrame, cell: float | None) -> DataFrame:
    """node, block of all ends of edges: the grid cell of its place (x1, y1 of src, x2, y2 of dst), or a range of ids."""
    def end(node: str, x: str, y: str) -> DataFrame:
        block = F.concat_ws(":", F.floor(F.col(x) / cell), F.floor(F.col(y) / cell)) if cell else F.floor(F.col(node) / RANGE).cast("string")
        return edges.select(F.col(node).cast("bigint").alias("node"), block.alias("block"))
    return end("src", "x1", "y1").unionAll(end("dst", "x2", "y2")).filter("node is not null").groupBy("node").agg(F.min("block").alias("block"))


def _relaxed(edges: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """Rows that get better within one block. rows: the block's labels, and with `fresh` those that came in."""
    into: dict[int, list[tuple[int, float]]] = {}
    for src, dst, length in zip(edges["src"].tolist(), edges["dst"].tolist(), edges["length"].tolist(), strict=True):
        into.setdefault(dst, []).append((src, length))
    out = []
    for target, own in rows.groupby("target"):
        labels = zip(own["node"].tolist(), own["dist"].tolist(), own["hops"].tolist(), own["next"].fillna(-1).astype("int64").tolist(), own["fresh"].tolist(), strict=True)
        best, queue, better = {}, [], set()
        for node, dist, hops, nxt, fresh in sorted(labels, key=lambda r: r[4]):
            best[node] = (dist, hops, nxt)
            if fresh:
                queue.append((dist, hops, node))
                better.add(node)
        heapq.heapify(queue)
        while queue:
            dist, hops, node = heapq.heappop(queue)
            if best[node][:2] != (dist, hops):
                continue
            for src, length in into.get(node, ()):
                label = (length + dist, hops + 1, node)
                held = best.get(src)
                if held is None or label < held:
                    best[src] = label
                    better.add(src)
                    if held is None or label[:2] < held[:2]:
                        heapq.heappush(queue, (*label[:2], src))
        out += [(target, node, *best[node]) for node in better]
    found = pd.DataFrame(out, columns=["target", "node", *LABEL])
    found["block"] = rows["block"].iloc[0] if len(rows) else None
    found["next"] = found["next"].astype("Int64").where(found["hops"] > 0)
    return found[["target", "node", "block", *LABEL]]


def shortest_tree(edges: DataFrame, targets: DataFrame | Iterable[int], cell: float | None = None) -> DataFrame:
    """target, node, dist, hops, next of all nodes from which a target can be reached: the length, the number of edges and the next node of the best path, the shortest, of equal ones that with the fewest
    edges, of these that with the smallest next node.

    edges: src, dst, length, and with `cell` the ends' places x1, y1, x2, y2: blocks are then cells of that width, which should hold some thousands of nodes. targets: a column target, or ids; each is its own row
    with length 0, also if no edge leads to it. Edges that lack a length or an end are left out, parallel ones count by the shortest, a negative length is an error. An id is a 64-bit integer.
    """
    spark = edges.sparkSession
    if not isinstance(targets, DataFrame):
        targets = spark.range(1).select(F.explode(F.array(*(F.lit(int(t)).cast("bigint") for t in targets))).alias("target"))
    length = F.when(F.col("length") < 0, F.raise_error(F.lit("an edge has a negative length"))).otherwise(F.col("length").cast("double"))
    blocks = kept(_blocks(edges, cell))
    plain = edges.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"), length.alias("length")).dropna().groupBy("src", "dst").agg(F.min("length").alias("length"))
    placed = kept(plain.join(blocks.toDF("src", "block"), "src").join(blocks.toDF("dst", "into"), "dst"))
    inner, crossing = placed.filter("block = into").select("block", "src", "dst", "length"), placed.filter("block <> into")
    at = targets.select(F.col("target").cast("bigint").alias("node")).dropna().distinct().join(blocks, "node", "left")
    fresh = kept(at.select(F.col("node").alias("target"), "node", F.coalesce("block", F.lit("none")).alias("block"), F.lit(0.0).alias("dist"), F.lit(0).cast("bigint").alias("hops"), F.lit(None).cast("bigint").alias("next")))
    state = fresh.filter("false")
    while not fresh.isEmpty():
        active = F.broadcast(fresh.select("block").distinct()) if fresh.count() <= 100_000 else fresh.select("block").distinct()
        rows = state.join(active, "block", "left_semi").join(fresh.select("target", "node"), ["target", "node"], "left_anti").withColumn("fresh", F.lit(False)).unionByName(fresh.withColumn("fresh", F.lit(True)))
        better = kept(inner.join(active, "block", "left_semi").groupBy("block").cogroup(rows.groupBy("block")).applyInPandas(_relaxed, TREE))
        state = kept(state.join(better.select("target", "node"), ["target", "node"], "left_anti").unionByName(better))
        offered = crossing.join(better.select("target", F.col("node").alias("dst"), "dist", "hops"), "dst")
        label = F.struct((F.col("length") + F.col("dist")).alias("dist"), (F.col("hops") + 1).alias("hops"), F.col("dst").alias("next"))
        offered = offered.groupBy("target", F.col("src").alias("node"), "block").agg(F.min(label).alias("offer"))
        held = state.select("target", "node", F.struct(*LABEL).alias("held"))
        fresh = kept(offered.join(held, ["target", "node"], "left").filter("held is null or offer < held").select("target", "node", "block", "offer.*"))
    return state.select("target", "node", *LABEL)


def unrolled(tree: DataFrame, starts: DataFrame) -> DataFrame:
    """target, start, hop, node: the nodes of the best path from each start (target, start) to its target, hop 0 the start itself; starts from which the target can't be reached have no rows."""
    held = kept(starts.select(F.col("target").cast("bigint").alias("target"), F.col("start").cast("bigint").alias("start")).distinct().join(tree.select("target", F.col("node").alias("start"), "hops"), ["target", "start"]))
    longest = held.agg(F.max("hops")).first()[0] or 0
    jumps = [tree.filter("next is not null").select("target", "node", F.col("next").alias("to"), "hops")]
    for k in range(1, int(longest).bit_length()):
        ahead = jumps[-1].select("target", F.col("node").alias("to"), F.col("to").alias("_to"))
        jumps.append(kept(jumps[-1].filter(F.col("hops") >= 1 << k).join(ahead, ["target", "to"]).select("target", "node", F.col("_to").alias("to"), "hops")))
    rows = held.select("target", "start", "hops", F.lit(0).cast("bigint").alias("hop"), F.col("start").alias("node"))
    for k, jump in reversed(list(enumerate(jumps[: int(longest).bit_length()]))):
        there = F.when(F.col("hop") + (1 << k) <= F.col("hops"), F.struct((F.col("hop") + (1 << k)).alias("hop"), F.col("to").alias("node")))
        both = F.explode(F.array_compact(F.array(F.struct("hop", "node"), there))).alias("_r")
        rows = rows.join(jump.select("target", "node", "to"), ["target", "node"], "left").select("target", "start", "hops", both).select("target", "start", "hops", "_r.*")
    return rows.select("target", "start", "hop", "node")


def first_steps(walkers: DataFrame, edges: DataFrame, tree: DataFrame, cone: float = 90.0, least_speed: float = 0.5) -> DataFrame:
    """row_id, target, node, first, distance_m, eta_s of walkers (row_id, node, heading_deg, speed) to each target: the best path whose first edge (src, dst, length, x1, y1, x2, y2) is within the cone of
    the heading, or of all, if none is or the heading is null or not finite. `first` is that edge's end. Walkers from whose node no edge leads to a target have no row."""
    bearing = F.pmod(F.degrees(F.atan2(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))), F.lit(360.0))
    on = edges.filter("length is not null").select(F.col("src").cast("bigint").alias("node"), F.col("dst").cast("bigint").alias("first"), "length", bearing.alias("bearing")).join(tree.select("target", F.col("node").alias("first"), "dist", "hops"), "first")
    turn = F.pmod(F.col("bearing") - F.col("heading_deg"), F.lit(360.0))
    ahead = F.when(F.isnan(turn), True).otherwise(F.coalesce(F.least(turn, 360 - turn) <= cone, F.lit(True)))
    label = F.struct((F.col("length") + F.col("dist")).alias("d"), "hops", "first")
    best = walkers.select("row_id", F.col("node").cast("bigint").alias("node"), "heading_deg", "speed").join(on, "node").groupBy("row_id", "target", "node", "speed").agg(F.coalesce(F.min(F.when(ahead, label)), F.min(label)).alias("b"))
    return best.select("row_id", "target", "node", "b.first", F.round("b.d", 2).alias("distance_m"), F.round(F.col("b.d") / F.greatest("speed", F.lit(least_speed)), 1).alias("eta_s"))


def _routed(steps: DataFrame, tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    steps = kept(steps)
    return steps, unrolled(tree, steps.select("target", F.col("first").alias("start")).distinct())


def routes(steps: DataFrame, tree: DataFrame) -> DataFrame:
    """first_steps' rows with `path`, the nodes from the walker's own to the target. Paths are made once for all walkers of the same first step."""
    steps, rows = _routed(steps, tree)
    lists = rows.groupBy("target", F.col("start").alias("first")).agg(F.transform(F.sort_array(F.collect_list(F.struct("hop", "node"))), lambda r: r.node).alias("_path"))
    return steps.join(lists, ["target", "first"]).withColumn("path", F.concat(F.array("node"), F.col("_path"))).drop("_path")


def route_lines(steps: DataFrame, tree: DataFrame, places: DataFrame) -> DataFrame:
    """row_id, target, geojson: each walker's path as a line through its nodes' places (node, lon, lat)."""
    from trackweave.sources.writers import line

    steps, rows = _routed(steps, tree)
    at = places.select(F.col("node").cast("bigint").alias("node"), F.struct("lon", "lat").alias("p"))
    lists = rows.join(at, "node").groupBy("target", F.col("start").alias("first")).agg(F.sort_array(F.collect_list(F.struct("hop", "p"))).alias("_h"))
    own: Column = F.array(F.struct(F.lit(-1).cast("bigint").alias("hop"), F.col("p")))
    return steps.join(lists, ["target", "first"]).join(at, "node").select("row_id", "target", line(F.transform(F.concat(own, F.col("_h")), lambda h: h.p)).alias("geojson"))
