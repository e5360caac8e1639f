"""Unions of rings as areas, and buffers of lines, by a planar overlay: edges are split where they meet, those with something on both sides are dropped, and the rest is chained to rings.

Edges meet within grid cells only, so no pairs are made beyond neighbours. Vertices are rounded to PLACES decimals, so that edges that meet share them. All rings of a name are one shape;
a ring is simple, in either direction, and may be repeated. Areas come out positive around shapes and negative around holes, and sum to the shape's.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from trackweave.sources.shared import kept

PLACES = 7
#: How far beside an edge's middle it is asked what lies there.
BESIDE = 1e-5


def _edges(vertices: DataFrame) -> DataFrame:
    """name, ring_id, x, y, x2, y2 of each ring's edges, the inside to their left; edges without a length are left out."""
    by = W.partitionBy("name", "ring_id")
    order = by.orderBy("seq")
    v = vertices.select("name", "ring_id", "seq", F.round("n", PLACES).alias("x"), F.round("e", PLACES).alias("y"))
    first = lambda c: F.first(c).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    v = v.withColumns({"x2": F.coalesce(F.lead("x").over(order), first("x")), "y2": F.coalesce(F.lead("y").over(order), first("y"))})
    v = v.withColumn("_area", F.sum(F.col("x") * F.col("y2") - F.col("x2") * F.col("y")).over(by)).filter("_area <> 0 and (x <> x2 or y <> y2)")
    turned = lambda a, b: F.when(F.col("_area") > 0, F.col(a)).otherwise(F.col(b))
    return v.select("name", "ring_id", turned("x", "x2").alias("x"), turned("y", "y2").alias("y"), turned("x2", "x").alias("x2"), turned("y2", "y").alias("y2"))


def _cells(a: str, b: str, cell: float) -> Column:
    return F.explode(F.sequence(F.floor(F.least(a, b) / cell), F.floor(F.greatest(a, b) / cell)))


def _points(p: str, q: str) -> Column:
    """Where edges p and q, structs of x, y, x2, y2, meet: their crossing, or the ends of one that lie on the other."""
    c = lambda e, f: F.col(f"{e}.{f}")
    dx, dy, ex, ey = c(p, "x2") - c(p, "x"), c(p, "y2") - c(p, "y"), c(q, "x2") - c(q, "x"), c(q, "y2") - c(q, "y")
    ox, oy = c(q, "x") - c(p, "x"), c(q, "y") - c(p, "y")
    den = dx * ey - dy * ex
    t, u = (ox * ey - oy * ex) / den, (ox * dy - oy * dx) / den
    slack, point = 1e-9, lambda x, y: F.struct(F.round(x, PLACES).alias("x"), F.round(y, PLACES).alias("y"))
    crossing = F.when(t.between(-slack, 1 + slack) & u.between(-slack, 1 + slack), F.array(point(c(p, "x") + t * dx, c(p, "y") + t * dy)))

    def on(e: str, x: Column, y: Column) -> Column:
        ax, ay, bx, by = (c(e, k) for k in ("x", "y", "x2", "y2"))
        length = F.hypot(bx - ax, by - ay)
        off = F.abs((bx - ax) * (y - ay) - (by - ay) * (x - ax)) / length
        along = ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / length
        return F.when((off < 10.0**-PLACES) & along.between(-slack, length + slack), point(x, y))

    ends = F.array_compact(F.array(*(on(e, c(f, x), c(f, y)) for e, f in ((p, q), (q, p)) for x, y in (("x", "y"), ("x2", "y2")))))
    return F.when(F.abs(den) > 1e-12 * (F.hypot(dx, dy) * F.hypot(ex, ey)), F.concat(F.coalesce(crossing, F.array()), ends)).otherwise(ends)


def _split(edges: DataFrame, cell: float) -> DataFrame:
    """name, x, y, x2, y2: the edges' parts between the points where edges of the name meet, each once."""
    e = kept(edges.select("name", F.struct("x", "y", "x2", "y2").alias("e")).distinct())
    at = e.withColumn("_cx", _cells("e.x", "e.x2", cell)).withColumn("_cy", _cells("e.y", "e.y2", cell))
    pairs = at.withColumnRenamed("e", "p").join(at.withColumnRenamed("e", "q"), ["name", "_cx", "_cy"]).filter("p < q")
    low = lambda a, b: F.floor(F.greatest(F.least(f"p.{a}", f"p.{b}"), F.least(f"q.{a}", f"q.{b}")) / cell)
    pairs = pairs.filter((F.col("_cx") == low("x", "x2")) & (F.col("_cy") == low("y", "y2")))  # each pair in one of its cells
    met = pairs.select("name", F.explode(F.array("p", "q")).alias("e"), _points("p", "q").alias("m")).filter(F.size("m") > 0)
    cuts = met.groupBy("name", "e").agg(F.flatten(F.collect_set("m")).alias("m"))
    along = lambda m: (m.x - F.col("e.x")) * (F.col("e.x2") - F.col("e.x")) + (m.y - F.col("e.y")) * (F.col("e.y2") - F.col("e.y"))
    start, end = (F.struct(F.col(f"e.{a}").alias("x"), F.col(f"e.{b}").alias("y")) for a, b in (("x", "y"), ("x2", "y2")))
    square = (F.col("e.x2") - F.col("e.x")) ** 2 + (F.col("e.y2") - F.col("e.y")) ** 2
    inner = F.filter(F.coalesce("m", F.array()), lambda m: (along(m) > 0) & (along(m) < square) & (m != start) & (m != end))
    line = F.array_sort(F.array_distinct(F.transform(inner, lambda m: F.struct(along(m).alias("d"), m.alias("m")))))
    whole = F.concat(F.array(start), F.transform(line, lambda k: k.m), F.array(end))
    parts = e.join(cuts, ["name", "e"], "left").withColumn("_w", whole)
    parts = parts.select("name", F.explode(F.transform(F.sequence(F.lit(0), F.size("_w") - 2), lambda i: F.struct(F.get("_w", i).alias("a"), F.get("_w", i + 1).alias("b")))).alias("s"))
    return parts.select("name", F.col("s.a.x").alias("x"), F.col("s.a.y").alias("y"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2")).filter("x <> x2 or y <> y2").distinct()


def _outside(parts: DataFrame, edges: DataFrame, cell: float) -> DataFrame:
    """The parts that no ring of the name covers on the right."""
    length = F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y"))
    beside = parts.withColumns({"px": (F.col("x") + F.col("x2")) / 2 + BESIDE * (F.col("y2") - F.col("y")) / length, "py": (F.col("y") + F.col("y2")) / 2 - BESIDE * (F.col("x2") - F.col("x")) / length})
    beside = beside.withColumn("s", F.struct("x", "y", "x2", "y2")).select("name", "s", "px", "py", F.floor(F.col("py") / cell).alias("_c"))
    strips = edges.withColumn("_c", _cells("y", "y2", cell)).select("name", "ring_id", "_c", *(F.col(c).alias(f"r{c}") for c in ("x", "y", "x2", "y2")))
    right = ((F.col("ry") > F.col("py")) != (F.col("ry2") > F.col("py"))) & (F.col("px") < (F.col("rx2") - F.col("rx")) * (F.col("py") - F.col("ry")) / (F.col("ry2") - F.col("ry")) + F.col("rx"))
    covered = beside.join(strips, ["name", "_c"]).filter((F.col("ry") != F.col("ry2")) & right).groupBy("name", "s", "ring_id").agg((F.count("*") % 2).alias("_odd")).filter("_odd = 1").select("name", "s").distinct()
    return parts.withColumn("s", F.struct("x", "y", "x2", "y2")).join(covered, ["name", "s"], "left_anti").drop("s")


def boundary(vertices: DataFrame, cell: float = 8.0) -> DataFrame:
    """name, x, y, x2, y2: the edges around the union of each name's rings (name, ring_id, seq, n, e), the shape to their left."""
    edges = kept(_edges(vertices))
    return _outside(kept(_split(edges, cell)), edges, cell)


def union_areas(vertices: DataFrame, cell: float = 8.0) -> DataFrame:
    """name and the area of the union of its rings: a sum over its edges."""
    return boundary(vertices, cell).groupBy("name").agg((F.sum(F.col("x") * F.col("y2") - F.col("x2") * F.col("y")) / 2).alias("area"))


def union_rings(vertices: DataFrame, cell: float = 8.0) -> DataFrame:
    """name, ring_id, seq, n, e: the rings of the union, holes in the other direction, from the least vertex on, without vertices on a straight line. ring_id: 0, 1, ... by that vertex.

    Edges are followed by doubling, so a ring of any length takes as many steps as its length has binary digits. Where rings touch in a vertex the sharpest turn to the left is taken.
    """
    edge = F.struct("x", "y", "x2", "y2")
    b = kept(boundary(vertices, cell).select("name", edge.alias("e")))
    turn = F.atan2((F.col("e.x2") - F.col("e.x")) * (F.col("f.y2") - F.col("f.y")) - (F.col("e.y2") - F.col("e.y")) * (F.col("f.x2") - F.col("f.x")), (F.col("e.x2") - F.col("e.x")) * (F.col("f.x2") - F.col("f.x")) + (F.col("e.y2") - F.col("e.y")) * (F.col("f.y2") - F.col("f.y")))
    j = b.withColumns({"jx": F.col("e.x2"), "jy": F.col("e.y2")}).join(b.select("name", F.col("e").alias("f"), F.col("e.x").alias("jx"), F.col("e.y").alias("jy")), ["name", "jx", "jy"])
    state = kept(j.groupBy("name", "e").agg(F.max_by("f", turn).alias("to")).withColumn("head", F.col("e")))
    most = b.groupBy("name").count().agg(F.max("count")).first()[0] or 1
    steps = range(int(most).bit_length())
    following = state.select("name", "e", F.col("to").alias("next"))
    for _ in steps:  # the least edge of each cycle
        ahead = state.select("name", F.col("e").alias("to"), F.col("to").alias("_to"), F.col("head").alias("_head"))
        state = kept(state.join(ahead, ["name", "to"]).select("name", "e", F.col("_to").alias("to"), F.least("head", "_head").alias("head")))
    ranked = state.select("name", "e", "head").join(following, ["name", "e"]).select("name", "e", "head", F.when(F.col("next") != F.col("head"), F.col("next")).alias("to"), F.lit(1).alias("left"))
    for _ in steps:  # how many edges are left to the cycle's end
        ahead = ranked.select("name", F.col("e").alias("to"), F.col("to").alias("_to"), F.col("left").alias("_left"))
        ranked = kept(ranked.join(ahead, ["name", "to"], "left").select("name", "e", "head", F.col("_to").alias("to"), (F.col("left") + F.coalesce("_left", F.lit(0))).alias("left")))
    ring = W.partitionBy("name", "head")
    order = ring.orderBy(F.desc("left"))
    last = F.last("e").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    x = ranked.withColumn("before", F.coalesce(F.lag("e").over(order), last))
    bend = (F.col("before.x2") - F.col("before.x")) * (F.col("e.y2") - F.col("e.y")) - (F.col("before.y2") - F.col("before.y")) * (F.col("e.x2") - F.col("e.x"))
    corners = x.filter(F.abs(bend) > 1e-6).withColumn("seq", F.row_number().over(order) - 1)
    heads = corners.select("name", "head").distinct().withColumn("ring_id", F.row_number().over(W.partitionBy("name").orderBy("head")) - 1)
    return corners.join(heads, ["name", "head"]).select("name", "ring_id", "seq", F.col("e.x").alias("n"), F.col("e.y").alias("e"))


def buffers(lines: DataFrame, quarter: int = 16) -> DataFrame:
    """name, ring_id, seq, n, e of rings whose union lies within `metres` of lines' segments (name, n, e, n2, e2, metres): a rectangle a segment and a polygon of 4 * quarter corners about each end."""
    s = lines.select("name", "metres", *(F.col(c).cast("double").alias(c) for c in ("n", "e", "n2", "e2"))).filter("metres > 0").distinct()
    length = F.hypot(F.col("n2") - F.col("n"), F.col("e2") - F.col("e"))
    rn, re = -(F.col("e2") - F.col("e")) / length * F.col("metres"), (F.col("n2") - F.col("n")) / length * F.col("metres")
    corner = lambda n, e, k: F.struct((F.col(n) + k * rn).alias("n"), (F.col(e) + k * re).alias("e"))
    boxes = s.filter("n <> n2 or e <> e2").select("name", F.xxhash64("n", "e", "n2", "e2").alias("ring_id"), F.posexplode(F.array(corner("n", "e", -1), corner("n2", "e2", -1), corner("n2", "e2", 1), corner("n", "e", 1))).alias("seq", "c"))
    ends = s.select("name", "metres", F.explode(F.array(F.struct("n", "e"), F.struct(F.col("n2").alias("n"), F.col("e2").alias("e")))).alias("p")).distinct()
    angle = lambda k: k * (math.pi / 2 / quarter)
    around = F.transform(F.sequence(F.lit(0), F.lit(4 * quarter - 1)), lambda k: F.struct((F.col("p.n") + F.col("metres") * F.cos(angle(k))).alias("n"), (F.col("p.e") + F.col("metres") * F.sin(angle(k))).alias("e")))
    rounds = ends.select("name", F.xxhash64("p.n", "p.e").alias("ring_id"), F.posexplode(around).alias("seq", "c"))
    return boxes.unionByName(rounds).select("name", "ring_id", "seq", "c.n", "c.e")
