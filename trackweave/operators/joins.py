"""Joins in time and space, without a cross join: as-of by ranges of time, radius and polygons by grid cells."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from trackweave.operators.crowds import Near
from trackweave.sources.shared import settled


def nearest_in_time(left: DataFrame, right: DataFrame, left_time: str, right_time: str, right_id: str) -> DataFrame:
    """left plus right's row of the least distance in time (whole microseconds), the earlier one (by time, then right_id) on a tie; see asof.nearest."""
    from trackweave.operators.asof import nearest

    return nearest(left, right, left_time, right_time, right_id)


def counts_within(x: np.ndarray, own: np.ndarray, radius: float, slack: float) -> np.ndarray:
    """How many of the places x are within the radius of each of those in own, itself included. Of each row of small cells those that lie wholly within count by the row's running number, and only the places in
    the cells that the circle crosses are compared."""
    near, out = Near(x), np.zeros(len(own), np.int64)
    s, (low_n, low_e), (rows, columns), give = near.size, near.low, near.shape, near.size * 1e-6
    reach = int(np.ceil(radius / s)) + 1
    shift = np.arange(-min(reach, rows), min(reach, rows) + 1)
    for a in range(0, len(own), step := max(1, 100_000 // len(shift))):
        n, e = own[a : a + step, :1], own[a : a + step, 1:]
        row = near.cell(own[a : a + step])[:, :1] + shift
        edge = low_n + row * s
        least = np.maximum(np.maximum(edge - n, n - edge - s) - give, 0)
        most = np.maximum(np.abs(n - edge), np.abs(n - edge - s)) + give
        wide = np.sqrt(np.maximum(radius * radius + slack - least * least, 0)) + give
        sure = np.sqrt(np.maximum(radius * radius - most * most, 0)) - give
        seen = (row >= 0) & (row < rows) & (least * least <= radius * radius + slack)
        first = np.clip(np.floor((e - wide - low_e) / s), 0, columns).astype(int)
        end = np.maximum(np.clip(np.floor((e + wide - low_e) / s) + 1, 0, columns).astype(int), first)
        left = np.clip(np.ceil((e - sure - low_e) / s), first, end).astype(int)
        right = np.clip(np.floor((e + sure - low_e) / s), first, end).astype(int)
        right = np.where((sure > 0) & (right > left), right, left)
        base = np.where(seen, row, 0) * columns
        at = lambda column, base=base: near.starts[base + column]
        found = np.where(seen, at(right) - at(left), 0).sum(1)
        begin = np.stack([at(first), at(right)], 2)
        size = np.where(seen[:, :, None], np.stack([at(left), at(end)], 2) - begin, 0)
        ends = np.cumsum(size)
        place = near.order[np.arange(ends[-1]) + np.repeat(begin.ravel() - (ends - size.ravel()), size.ravel())]
        who = np.repeat(np.arange(len(n)), size.sum((1, 2)))
        hit = (n[who, 0] - x[place, 0]) ** 2 + (e[who, 0] - x[place, 1]) ** 2 <= radius * radius + slack
        out[a : a + step] = found + np.bincount(who[hit], minlength=len(n))
    return out


def radius_neighbours(d: DataFrame, frame: list[str], n: str, e: str, key: str, radius: float = 10.0, slack: float = 1e-9, tile: float = 8.0) -> DataFrame:
    """key and the number of other rows of the frame within the radius; rows without a finite place are left out. A frame is cut into tiles of so many radii, which hold copies of what is near their borders."""
    side, margin = radius * tile, radius * (1 + 1e-6) + slack
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    base = d.select(F.col(key).alias("_k"), F.col(n).cast("double").alias("_n"), F.col(e).cast("double").alias("_e"), F.struct(*frame).alias("_f")).filter(finite("_n") & finite("_e"))
    tiles = lambda c: F.explode(F.sequence(F.floor((F.col(c) - margin) / side), F.floor((F.col(c) + margin) / side)))
    x = base.withColumn("_tn", tiles("_n")).withColumn("_te", tiles("_e")).withColumn("_own", (F.floor(F.col("_n") / side) == F.col("_tn")) & (F.floor(F.col("_e") / side) == F.col("_te")))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        p, own = g[["_n", "_e"]].to_numpy(float), g["_own"].to_numpy(bool)
        return pd.DataFrame({key: g["_k"][own], "density": counts_within(p, p[own], radius, slack) - 1})

    return x.groupBy("_f", "_tn", "_te").applyInPandas(run, f"`{key}` {dict(base.dtypes)['_k']}, density long")


def nearest_point(points: DataFrame, key: str, n: str, e: str, nodes: DataFrame, node: str, node_n: str, node_e: str, cell: float) -> DataFrame:
    """points with the nearest node (squared distances rounded to 9 places; the smaller node on a tie), by grid cells: what has no node within a cell's width
    among the nine cells around it is looked up again in cells four times as wide, until nothing is left. The nodes are copied to nine cells each, the points to none. Without nodes, or with a null place, there is none."""
    left = points.select(F.col(key).alias("_k"), F.col(n).cast("double").alias("_n"), F.col(e).cast("double").alias("_e")).filter("_n is not null and _e is not null")
    at = nodes.select(F.col(node).alias("_node"), F.col(node_n).alias("_x"), F.col(node_e).alias("_y"))
    span = at.agg(F.min("_x").alias("x0"), F.max("_x").alias("x1"), F.min("_y").alias("y0"), F.max("_y").alias("y1")).crossJoin(left.agg(F.min("_n").alias("n0"), F.max("_n").alias("n1"), F.min("_e").alias("e0"), F.max("_e").alias("e1"))).first()
    done = []
    if None not in span:
        widest = max(max(span["x1"], span["n1"]) - min(span["x0"], span["n0"]), max(span["y1"], span["e1"]) - min(span["y0"], span["e0"]))
        shifts = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
        while True:
            around = at.withColumn("_s", F.explode(shifts)).withColumns({"_cn": F.floor(F.col("_x") / cell) + F.col("_s.a"), "_ce": F.floor(F.col("_y") / cell) + F.col("_s.b")}).drop("_s")
            near = left.withColumns({"_cn": F.floor(F.col("_n") / cell), "_ce": F.floor(F.col("_e") / cell)}).join(around, ["_cn", "_ce"])
            best = near.groupBy("_k").agg(F.min(F.struct(F.round((F.col("_n") - F.col("_x")) ** 2 + (F.col("_e") - F.col("_y")) ** 2, 9).alias("d"), F.col("_node").alias("node"))).alias("_b"))
            last = cell > widest
            best = settled(best if last else best.filter(F.col("_b.d") <= cell * cell))
            done.append(best)
            if last:
                break
            left = settled(left.join(best, "_k", "left_anti"))
            if left.isEmpty():
                break
            cell *= 4
    found = reduce(DataFrame.unionAll, done) if done else left.limit(0).crossJoin(at.limit(0)).select("_k", F.struct(F.lit(0.0).alias("d"), F.col("_node").alias("node")).alias("_b"))
    return points.join(found.select(F.col("_k").alias(key), F.col("_b.node").alias(node)), key, "left")


def polygon_edges(vertices: DataFrame) -> DataFrame:
    """Edges of each ring and the polygon's area (shoelace)."""
    by = W.partitionBy("name", "ring_id").orderBy("seq")
    first = W.partitionBy("name", "ring_id").orderBy("seq").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    e = vertices.select("name", "n", "e", F.coalesce(F.lead("n").over(by), F.first("n").over(first)).alias("n2"), F.coalesce(F.lead("e").over(by), F.first("e").over(first)).alias("e2"))
    return e.withColumn("area", F.round(F.abs(F.sum(F.col("n") * F.col("e2") - F.col("n2") * F.col("e")).over(W.partitionBy("name"))) / 2, 9))


def smallest_polygon(points: DataFrame, key: str, n: str, e: str, vertices: DataFrame, cell: float = 8.0) -> DataFrame:
    """key and the name of the polygon of the least area that holds the point (null if none does), ties to the smaller name; by grid cells that each polygon's box covers."""
    edges = polygon_edges(vertices)
    boxes = edges.groupBy("name").agg(F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("e").alias("e0"), F.max("e").alias("e1"))
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    cells = boxes.withColumn("_cn", span("n0", "n1")).withColumn("_ce", span("e0", "e1")).select("name", "_cn", "_ce")
    p = points.select(F.col(key).alias("_k"), F.col(n).alias("_n"), F.col(e).alias("_e")).withColumns({"_cn": F.floor(F.col("_n") / cell), "_ce": F.floor(F.col("_e") / cell)})
    crossing = ((F.col("e") > F.col("_e")) != (F.col("e2") > F.col("_e"))) & (F.col("_n") < (F.col("n2") - F.col("n")) * (F.col("_e") - F.col("e")) / (F.col("e2") - F.col("e")) + F.col("n"))
    inside = p.join(cells, ["_cn", "_ce"]).join(edges, "name").groupBy("_k", "name", "area").agg(F.sum(F.when(F.col("e") == F.col("e2"), 0).otherwise(crossing.cast("int"))).alias("_c")).filter("_c % 2 = 1")
    best = inside.groupBy("_k").agg(F.min(F.struct("area", "name")).alias("_best")).select("_k", F.col("_best.name").alias("place"))
    return p.select("_k").join(best, "_k", "left").withColumnRenamed("_k", key)


def resample_index(d: DataFrame, index: str, count: int, total: int) -> DataFrame:
    """Rows floor(i * (total - 1) / (count - 1)), i = 0 to count - 1, of a table indexed 0 to total - 1."""
    spark = d.sparkSession
    i = spark.range(count).select(F.col("id").alias("sample"), F.floor(F.col("id") * (total - 1) / max(1, count - 1)).cast("bigint").alias(index))
    return i.join(d, index)


def near_lines(points: DataFrame, key: str, n: str, e: str, lines: DataFrame, ends: tuple[str, str, str, str], metres: float, cell: float = 8.0, slack: float = 1e-9) -> DataFrame:
    """key and near: whether the point is within so many metres of any line segment; by grid cells that each segment's widened box covers."""
    x1, y1, x2, y2 = (F.col(c).cast("double") for c in ends)
    span = lambda a, b: F.explode(F.sequence(F.floor((F.least(a, b) - metres) / cell), F.floor((F.greatest(a, b) + metres) / cell)))
    s = lines.select(x1.alias("_x1"), y1.alias("_y1"), x2.alias("_x2"), y2.alias("_y2"))
    s = s.withColumn("_cn", span(F.col("_x1"), F.col("_x2"))).withColumn("_ce", span(F.col("_y1"), F.col("_y2")))
    p = points.select(F.col(key).alias("_k"), F.col(n).alias("_n"), F.col(e).alias("_e")).withColumns({"_cn": F.floor(F.col("_n") / cell), "_ce": F.floor(F.col("_e") / cell)})
    dn, de = F.col("_x2") - F.col("_x1"), F.col("_y2") - F.col("_y1")
    along = F.when(dn * dn + de * de > 0, ((F.col("_n") - F.col("_x1")) * dn + (F.col("_e") - F.col("_y1")) * de) / (dn * dn + de * de)).otherwise(0.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    off = (F.col("_n") - F.col("_x1") - t * dn) ** 2 + (F.col("_e") - F.col("_y1") - t * de) ** 2
    hit = p.join(s, ["_cn", "_ce"]).filter(off <= metres * metres + slack).select("_k").distinct().withColumn("near", F.lit(True))
    return p.select("_k").join(hit, "_k", "left").select(F.col("_k").alias(key), F.coalesce("near", F.lit(False)).alias("near"))


def nearby(d: DataFrame, frame: str, total: Column, count: int, reach: int | None = None, seed: int = 0) -> DataFrame:
    """frame, k, picked: the frame itself (k = 0) and count - 1 frames drawn with repetition from [frame - reach, frame + reach) within 0 and total; reach is twice the count by default.

    Draws follow from seed, frame and k alone, so they are the same over any partitions. A null frame has null picks; repeated rows draw alike.
    """
    reach = 2 * count if reach is None else reach
    low, high = F.greatest(F.lit(0), F.col(frame) - reach), F.least(total, F.col(frame) + reach)
    drawn = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), frame, "k")), 1, 8), 16, 10).cast("bigint")
    x = d.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    return x.select(frame, "k", F.when((F.col("k") == 0) | F.col(frame).isNull(), F.col(frame)).otherwise(low + F.pmod(drawn, high - low)).cast("int").alias("picked"))
