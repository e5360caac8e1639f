"""Point tracks over the frames of a sequence: what a point's projections are, where they are visible, epipolar distances, seeded samples of true and false tracks, and reconstructions as text tables.

A camera is a struct of r (nine numbers by rows) and t, world to camera, and fx, fy, cx, cy. Tables of cameras: seq, frame, camera.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W


def _rows(m: Column) -> list[list[Column]]:
    return [[m[3 * i + j] for j in range(3)] for i in range(3)]


def _sum(terms) -> Column:
    terms = list(terms)
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def projected(camera: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """(u, v, depth) of a world point."""
    a, b, c = (_sum(r * p for r, p in zip(row, (x, y, z), strict=True)) + camera["t"][i] for i, row in enumerate(_rows(camera["r"])))
    return camera["fx"] * a / c + camera["cx"], camera["fy"] * b / c + camera["cy"], c


def essential(a: Column, b: Column) -> list[list[Column]]:
    """The matrix that couples directions seen by camera a with those seen by b: the cross product of b's place and the turn from a to b."""
    ra, rb = _rows(a["r"]), _rows(b["r"])
    turn = [[_sum(rb[i][k] * ra[j][k] for k in range(3)) for j in range(3)] for i in range(3)]
    x, y, z = (b["t"][i] - _sum(turn[i][k] * a["t"][k] for k in range(3)) for i in range(3))
    cross = [[None, -z, y], [z, None, -x], [-y, x, None]]
    return [[_sum(cross[i][k] * turn[k][j] for k in range(3) if k != i) for j in range(3)] for i in range(3)]


def sampson(a: Column, b: Column, u1: Column, v1: Column, u2: Column, v2: Column) -> Column:
    """Squared distance in pixels, to first order, of two cameras' pixels from being a view of one point."""
    e = essential(a, b)
    p, q = ((u1 - a["cx"]) / a["fx"], (v1 - a["cy"]) / a["fy"], F.lit(1.0)), ((u2 - b["cx"]) / b["fx"], (v2 - b["cy"]) / b["fy"], F.lit(1.0))
    ahead = [_sum(e[i][j] * p[j] for j in range(3)) for i in range(3)]
    back = [_sum(e[i][j] * q[i] for i in range(3)) for j in range(2)]
    off = _sum(q[i] * ahead[i] for i in range(3))
    return off * off / ((ahead[0] / b["fx"]) ** 2 + (ahead[1] / b["fy"]) ** 2 + (back[0] / a["fx"]) ** 2 + (back[1] / a["fy"]) ** 2)


@dataclass(frozen=True)
class TrackParams:
    """relative: depths agree within this share of either; border: pixels at an image's edges that don't count; target: tracks of a sequence; false_share: of these that are false ones; apart: Sampson
    distance that a false track has at least between its first frame and each other; reach: share of width and height by which its pixels are moved at most."""

    width: int
    height: int
    relative: float = 0.05
    border: int = 4
    target: int = 512
    false_share: float = 0.0
    apart: float = 16.0
    reach: float = 0.5
    seed: int = 0


def _drawn(*parts) -> Column:
    """A number of [0, 1) from what is named."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12), 16, 10).cast("double") / float(1 << 48)


def projections(points: DataFrame, cameras: DataFrame, depth: DataFrame, p: TrackParams) -> DataFrame:
    """seq, point, frame, u, v, visible of points (seq, point, x, y, z) in each frame of their sequence: visible where in front, within the border, and where one of the four pixels of depth (seq, frame, u,
    v, depth) around has about the projection's depth."""
    j = points.join(cameras, "seq")
    u, v, z = projected(F.col("camera"), F.col("x"), F.col("y"), F.col("z"))
    j = j.select("seq", "point", "frame", u.alias("u"), v.alias("v"), z.alias("z"))
    iu, iv = F.floor("u"), F.floor("v")
    inside = (F.col("z") > 0) & iu.between(p.border, p.width - p.border - 1) & iv.between(p.border, p.height - p.border - 1)
    corners = F.explode(F.array(*(F.struct((iu + a).cast("bigint").alias("u"), (iv + b).cast("bigint").alias("v")) for a in (0, 1) for b in (0, 1))))
    at = j.filter(inside).select("seq", "point", "frame", "z", corners.alias("_c")).select("seq", "point", "frame", "z", "_c.u", "_c.v")
    near = at.join(depth.select("seq", "frame", F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v"), "depth"), ["seq", "frame", "u", "v"])
    off = F.abs(F.col("depth") - F.col("z"))
    seen = near.filter((off < F.col("z") * p.relative) & (off < F.col("depth") * p.relative)).select("seq", "point", "frame").distinct().withColumn("visible", F.lit(True))
    return j.join(seen, ["seq", "point", "frame"], "left").select("seq", "point", "frame", "u", "v", F.coalesce("visible", F.lit(False)).alias("visible"))


def true_tracks(points: DataFrame, cameras: DataFrame, depth: DataFrame, p: TrackParams) -> DataFrame:
    """projections() of at most target - false ones of each sequence's points, those visible in its first frame and another: drawn by hash from the half visible in the most frames, if that is more than enough.

    Points are those of a first frame's pixels, so a sequence has no more than an image has.
    """
    x = projections(points, cameras, depth, p)
    first = cameras.groupBy("seq").agg(F.min("frame").alias("_first"))
    n = x.filter("visible").join(first, "seq").groupBy("seq", "point").agg(F.count("*").alias("n"), F.max(F.col("frame") == F.col("_first")).alias("ok")).filter("ok and n > 1")
    wanted = p.target - int(p.target * p.false_share)
    by = W.partitionBy("seq")
    draw = _drawn(F.lit(p.seed), "seq", "point")
    n = n.withColumns({"all": F.count("*").over(by), "k": F.row_number().over(by.orderBy(F.desc("n"), draw))})
    half = F.floor(F.col("all") / 2)
    n = n.filter((half <= wanted) | (F.col("k") <= half)).withColumn("k", F.row_number().over(by.orderBy(draw))).filter(F.col("k") <= wanted)
    return x.join(n.select("seq", "point"), ["seq", "point"])


def false_tracks(cameras: DataFrame, wanted: DataFrame, p: TrackParams) -> DataFrame:
    """seq, draw, frame, u, v of `left` tracks of each sequence (seq, left), fewer if not enough are far enough from every epipolar line: of four times target draws, a pixel of the first frame and moved ones of the others."""
    first = cameras.groupBy("seq").agg(F.min_by(F.col("camera"), "frame").alias("_a"), F.min("frame").alias("_first"))
    draws = wanted.filter("left > 0").select("seq", F.explode(F.sequence(F.lit(0), F.lit(4 * p.target - 1))).alias("draw")).join(first, "seq").join(cameras, "seq")
    at = lambda name, *more: _drawn(F.lit(p.seed), F.lit(name), "seq", "draw", *more)
    u0, v0 = F.floor(at("u") * p.width).cast("double"), F.floor(at("v") * p.height).cast("double")
    moved = lambda c, name, size: F.when(F.col("frame") == F.col("_first"), c).otherwise(c + at(name, F.col("frame").cast("string")) * int(size * p.reach))
    x = draws.withColumns({"u0": u0, "v0": v0}).withColumns({"u": moved(F.col("u0"), "du", p.width), "v": moved(F.col("v0"), "dv", p.height)})
    far = F.when(F.col("frame") == F.col("_first"), True).otherwise(F.coalesce(sampson(F.col("_a"), F.col("camera"), F.col("u0"), F.col("v0"), F.col("u"), F.col("v")) > p.apart, F.lit(False)))
    good = x.groupBy("seq", "draw").agg(F.min(far).alias("ok")).filter("ok").withColumn("k", F.row_number().over(W.partitionBy("seq").orderBy(_drawn(F.lit(p.seed), F.lit("pick"), "seq", "draw"))))
    chosen = good.join(wanted, "seq").filter("k <= left").select("seq", "draw")
    return x.join(chosen, ["seq", "draw"]).select("seq", "draw", "frame", "u", "v")


def track_truth(points: DataFrame, cameras: DataFrame, depth: DataFrame, p: TrackParams) -> DataFrame:
    """seq, track, frame, u, v, visible, positive: true tracks, and false ones up to the target; track is p and the point, or n and the draw. The same seed gives the same tracks over any partitions."""
    true = true_tracks(points, cameras, depth, p)
    had = true.groupBy("seq").agg(F.countDistinct("point").alias("n"))
    wanted = cameras.select("seq").distinct().join(had, "seq", "left").select("seq", (F.lit(p.target) - F.coalesce("n", F.lit(0))).alias("left"))
    false = false_tracks(cameras, wanted, p)
    a = true.select("seq", F.concat(F.lit("p"), "point").alias("track"), "frame", "u", "v", "visible", F.lit(True).alias("positive"))
    return a.unionByName(false.select("seq", F.concat(F.lit("n"), "draw").alias("track"), "frame", "u", "v", F.lit(False).alias("visible"), F.lit(False).alias("positive")))


def inliers(observations: DataFrame, points: DataFrame, cameras: DataFrame, most: float) -> DataFrame:
    """observations (frame, point, u, v) with `inlier`: whether the point (point, x, y, z) is in front of the camera (frame, camera) and its projection less than `most` pixels away."""
    j = observations.join(points.select("point", "x", "y", "z"), "point").join(cameras.select("frame", "camera"), "frame")
    u, v, z = projected(F.col("camera"), F.col("x"), F.col("y"), F.col("z"))
    near = (z > 0) & (F.hypot(u - F.col("u"), v - F.col("v")) < most)
    return j.select(*observations.columns, F.coalesce(near, F.lit(False)).alias("inlier"))


@dataclass(frozen=True)
class Reconstruction:
    """cameras: camera_id, model, width, height, params; images: image_id, q (w, x, y, z), t, camera_id, name, points2d of (x, y, id); points: id, point, x, y, z, rgb, track of (image_id, idx)."""

    cameras: DataFrame
    images: DataFrame
    points: DataFrame


def reconstruction(points: DataFrame, observations: DataFrame, cameras: DataFrame, width: int, height: int, least: int = 64, widest: float = 3000.0) -> Reconstruction:
    """Points (point, x, y, z, r, g, b) of at least two inliers among observations (frame, point, u, v, inlier), numbered from 1 in order; an image's observations are numbered from 0 by point. Points as far
    as `widest` on an axis keep their row, but have no observations. An error if a frame has fewer than `least` inliers. Cameras (frame, camera) are pinholes, one an image; ids start at 1.
    """
    from trackweave.functions.geo import matrix_quaternion
    from trackweave.sources.readers import indexed
    from trackweave.sources.shared import settled

    seen = observations.filter("inlier")
    few = cameras.select("frame").join(seen.groupBy("frame").count(), "frame", "left").filter(F.coalesce("count", F.lit(0)) < least).select("frame").limit(5).collect()
    if few:
        raise ValueError(f"frames with fewer than {least} inliers: {sorted(r['frame'] for r in few)}")
    good = seen.groupBy("point").count().filter("count >= 2").select("point")
    numbered = settled(indexed(points.join(good, "point"), "point").withColumn("id", F.col("i") + 1).drop("i"))
    near = numbered.filter(F.greatest("x", "y", "z") < widest).select("point", "id")
    obs = settled(seen.join(near, "point").select((F.col("frame") + 1).alias("image_id"), "id", "u", "v").withColumn("idx", F.row_number().over(W.partitionBy("image_id").orderBy("id")) - 1))
    per_image = obs.groupBy("image_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "u", "v", "id"))), lambda o: F.struct(o.u.alias("x"), o.v.alias("y"), o.id.alias("id"))).alias("points2d"))
    c = cameras.withColumn("image_id", F.col("frame") + 1)
    q = matrix_quaternion(_rows(F.col("camera.r")))
    images = c.join(per_image, "image_id", "left").select("image_id", F.array(q[3], q[0], q[1], q[2]).alias("q"), F.col("camera.t").alias("t"), F.col("image_id").alias("camera_id"), F.concat(F.lit("image_"), "image_id").alias("name"), F.coalesce("points2d", F.array()).alias("points2d"))
    tracks = obs.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("image_id", "idx"))).alias("track"))
    held = numbered.join(tracks, "id", "left").select("id", "point", "x", "y", "z", F.array("r", "g", "b").alias("rgb"), F.coalesce("track", F.array()).alias("track"))
    shots = c.select(F.col("image_id").alias("camera_id"), F.lit("PINHOLE").alias("model"), F.lit(width).alias("width"), F.lit(height).alias("height"), F.array(*(F.col(f"camera.{k}") for k in ("fx", "fy", "cx", "cy"))).alias("params"))
    return Reconstruction(shots, images, held)


def write_text(r: Reconstruction, path: str) -> None:
    """path/cameras, path/images (two lines an image) and path/points3D, as the text form of reconstructions has them; an unknown error of a point is -1."""
    joined = lambda *parts: F.concat_ws(" ", *(F.array_join(p.cast("array<string>"), " ") if kind else p.cast("string") for p, kind in parts))
    c = F.col
    r.cameras.select(joined((c("camera_id"), 0), (c("model"), 0), (c("width"), 0), (c("height"), 0), (c("params"), 1)).alias("value")).write.text(f"{path}/cameras")
    flat = F.array_join(F.transform("points2d", lambda p: F.concat_ws(" ", p.x.cast("string"), p.y.cast("string"), p.id.cast("string"))), " ")
    r.images.select(F.concat(joined((c("image_id"), 0), (c("q"), 1), (c("t"), 1), (c("camera_id"), 0), (c("name"), 0)), F.lit("\n"), flat).alias("value")).write.text(f"{path}/images")
    steps = F.transform("track", lambda s: F.concat_ws(" ", s.image_id.cast("string"), s.idx.cast("string")))
    r.points.select(F.concat_ws(" ", joined((c("id"), 0), (c("x"), 0), (c("y"), 0), (c("z"), 0), (c("rgb"), 1)), F.lit("-1"), F.array_join(steps, " ")).alias("value")).write.text(f"{path}/points3D")


def read_points(spark, path: str) -> DataFrame:
    """id, x, y, z, rgb, track of path/points3D."""
    w = spark.read.text(f"{path}/points3D").select(F.split(F.trim("value"), " ").alias("w"))
    steps = F.transform(F.sequence(F.lit(8), F.size("w") - 2, F.lit(2)), lambda k: F.struct(F.get("w", k).cast("bigint").alias("image_id"), F.get("w", k + 1).cast("bigint").alias("idx")))
    return w.select(F.col("w")[0].cast("bigint").alias("id"), *(F.col("w")[k].cast("double").alias(n) for k, n in ((1, "x"), (2, "y"), (3, "z"))), F.transform(F.slice("w", 5, 3), lambda v: v.cast("int")).alias("rgb"), F.when(F.size("w") > 9, steps).otherwise(F.array()).alias("track"))
