"""Queries of point tracks over the poses: epipolar distances, and inliers by point."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trackweave.functions import geo
from trackweave.operators import pointtracks
from trackweave.plans.catalog import _n2, query

C = F.col
_cells = {
    (0, 0): "1-2*(qy*qy+qz*qz)/{n}", (0, 1): "2*(qx*qy-qz*qw)/{n}", (0, 2): "2*(qx*qz+qy*qw)/{n}", (1, 0): "2*(qx*qy+qz*qw)/{n}", (1, 1): "1-2*(qx*qx+qz*qz)/{n}", (1, 2): "2*(qy*qz-qx*qw)/{n}",
    (2, 0): "2*(qx*qz-qy*qw)/{n}", (2, 1): "2*(qy*qz+qx*qw)/{n}", (2, 2): "1-2*(qx*qx+qy*qy)/{n}",
}
_m = ", m as (select frame_id f, " + ", ".join(f"{x.format(n=_n2)} r{i}{j}" for (i, j), x in _cells.items()) + ", tx t0, ty t1, tz t2 from poses)"
_turn = ", ".join(f"{' + '.join(f'b.r{i}{k}*a.r{j}{k}' for k in range(3))} s{i}{j}" for i in range(3) for j in range(3))
#: The coupling matrix from the first camera's side, and the pixels' matrix written out.
_pairs = f"""{_m}, p as (select a.f, {_turn}, a.t0 a0, a.t1 a1, a.t2 a2, b.t0 b0, b.t1 b1, b.t2 b2 from m a join m b on b.f = a.f + 1),
 q as (select *, {', '.join(f'b{i} - ({" + ".join(f"s{i}{k}*a{k}" for k in range(3))}) d{i}' for i in range(3))} from p),
 h as (select *, {', '.join(f'-({" + ".join(f"s{k}{i}*d{k}" for k in range(3))}) h{i}' for i in range(3))} from q),
 e as (select *, {', '.join(f"s{i}1*h2 - s{i}2*h1 e{i}0, s{i}2*h0 - s{i}0*h2 e{i}1, s{i}0*h1 - s{i}1*h0 e{i}2" for i in range(3))}, (f % 8 - 3.5)/10 x1, (f % 7 - 3.5)/10 y1, (f % 5 - 3.5)/10 x2, (f % 6 - 3.5)/10 y2 from h)"""


def _cameras(p: DataFrame) -> DataFrame:
    r = geo.quaternion_matrix(*(C(f"q{a}") for a in "xyzw"))
    camera = F.struct(F.array(*(c for row in r for c in row)).alias("r"), F.array("tx", "ty", "tz").alias("t"), F.lit(10.0).alias("fx"), F.lit(10.0).alias("fy"), F.lit(3.5).alias("cx"), F.lit(3.5).alias("cy"))
    return p.select(C("frame_id").alias("frame"), camera.alias("camera"))


@query("poses", sql=f"""{_pairs} select f as frame_id, round(log10(greatest(pow(x2*(e00*x1+e01*y1+e02) + y2*(e10*x1+e11*y1+e12) + e20*x1+e21*y1+e22, 2)
 / (pow((e00*x1+e01*y1+e02)/10, 2) + pow((e10*x1+e11*y1+e12)/10, 2) + pow((e00*x2+e10*y2+e20)/10, 2) + pow((e01*x2+e11*y2+e21)/10, 2)), 1e-9)), 4) + 0 log_distance from e""")
def sampson_distances(p):
    """Of a pixel of each frame and one of the next, as a logarithm."""
    c = _cameras(p)
    j = c.select("frame", C("camera").alias("a")).join(c.select((C("frame") - 1).alias("frame"), C("camera").alias("b")), "frame")
    d = pointtracks.sampson(C("a"), C("b"), *((C("frame") % k).cast("double") for k in (8, 7, 5, 6)))
    return j.select(C("frame").alias("frame_id"), (F.round(F.log10(F.greatest(d, F.lit(1e-9))), 4) + F.lit(0.0)).alias("log_distance"))


_xyz = ("(k.f % 7 - 3)::double", "(k.f % 5 - 2)::double", "(6 + k.f % 3)::double")
_seen = [" + ".join(f"m.r{i}{j}*{_xyz[j]}" for j in range(3)) + f" + m.t{i}" for i in range(3)]


@query("poses", sql=f"""{_m}, j as (select k.f point, m.f frame, {_seen[0]} x, {_seen[1]} y, {_seen[2]} z from m k join m on m.f between k.f and k.f + 3),
 o as (select point, z > 0 and abs((point + frame) % 4) < 2.5 and z <> 0 inlier from j) select point, count(*) filter (where inlier) n from o group by point having count(*) filter (where inlier) >= 2""")
def track_inliers(p):
    """Points seen in four frames by pixels that are 0 to 3 aside of their projections; inliers are less than 2.5 aside and in front of the camera, and two make a track."""
    c = _cameras(p)
    points = c.select(C("frame").alias("point"), (C("frame") % 7 - 3).cast("double").alias("x"), (C("frame") % 5 - 2).cast("double").alias("y"), (6 + C("frame") % 3).cast("double").alias("z"))
    seen = points.withColumn("frame", F.explode(F.sequence(C("point"), C("point") + 3))).join(c, "frame")
    u, v, _ = pointtracks.projected(C("camera"), C("x"), C("y"), C("z"))
    o = seen.select("frame", "point", (u + (C("point") + C("frame")) % 4).alias("u"), v.alias("v"))
    return pointtracks.inliers(o, points, c, 2.5).filter("inlier").groupBy("point").agg(F.count("*").alias("n")).filter("n >= 2")
