"""From tracks, a flight record and depth maps to states: what was seen, where it was, and how it moved."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from trackweave.functions import geo
from trackweave.operators import asof, states
from trackweave.sources.readers import indexed
from trackweave.sources.shared import settled


@dataclass(frozen=True)
class ChainParams:
    """fps: frames a second of the video; width, height: of the images that boxes refer to; rejected: percentile of a box's depths above which they count as background. flat: places by a flat earth about
    home instead of the ellipsoid. use_gimbal_yaw, add_drone_yaw, declination, offset: as in geo.gimbal_axes. accel, sigma, sigma_down: of the filter."""

    fps: float
    width: float
    height: float
    rejected: float = 70.0
    flat: bool = False
    use_gimbal_yaw: bool = False
    add_drone_yaw: bool = False
    declination: float = 0.0
    offset: float = 0.0
    accel: float = 0.5
    sigma: float = 5.0
    sigma_down: float = 2.0


def _at(sorted_values: Column, share: float) -> Column:
    """The percentile of a sorted array, linear between ranks."""
    k = (F.size(sorted_values) - 1) * F.lit(share)
    low, high = F.get(sorted_values, F.floor(k).cast("int")), F.get(sorted_values, F.ceil(k).cast("int"))
    return low + (high - low) * (k - F.floor(k))


def box_depths(boxes: DataFrame, maps: DataFrame, width: float, height: float, rejected: float = 70.0) -> DataFrame:
    """key, depth_m: the median of a box's depths up to their percentile `rejected`, of boxes (key, frame, bbox in an image of width x height) on maps (frame, h, w, depth by rows). Boxes without an area on the
    map, or a finite depth above 0, and those of frames without a map, are left out.

    Maps are cut into rows of pixels, and a box is joined to those that it covers and takes its part of each, so no box carries a map. Boxes that cover the same pixels are one until their depth is known.
    """
    sizes = maps.select("frame", "h", "w")
    b = boxes.select("key", "frame", "bbox").join(sizes, "frame")
    side = lambda k, scale, size: F.bround(F.col("bbox")[k] * F.col(size) / scale)  # noqa: E731  halves to even
    clamp = lambda v, most: F.greatest(F.lit(0), F.least(v, most)).cast("int")
    b = b.select("key", "frame", clamp(side(0, width, "w"), F.col("w") - 1).alias("x1"), clamp(side(1, height, "h"), F.col("h") - 1).alias("y1"), clamp(side(2, width, "w"), F.col("w")).alias("x2"), clamp(side(3, height, "h"), F.col("h")).alias("y2"))
    b = b.filter("x2 > x1 and y2 > y1")
    pixels = ["frame", "x1", "y1", "x2", "y2"]
    covered = b.select(pixels).distinct().withColumn("v", F.explode(F.sequence(F.col("y1"), F.col("y2") - 1)))
    lines = maps.select("frame", F.explode(F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda v: F.struct(v.cast("int").alias("v"), F.slice("depth", (v * F.col("w") + 1).cast("int"), F.col("w").cast("int")).alias("d")))).alias("_l")).select("frame", "_l.*")
    part = F.filter(F.slice("d", F.col("x1") + 1, F.col("x2") - F.col("x1")).cast("array<double>"), lambda x: (x > 0) & ~F.isnan(x) & (x != float("inf")))
    held = covered.join(lines, ["frame", "v"]).groupBy(pixels).agg(F.array_sort(F.flatten(F.collect_list(part))).alias("_d")).filter(F.size("_d") > 0)
    near = held.withColumn("_cut", _at(F.col("_d"), rejected / 100)).select(*pixels, F.filter("_d", lambda x: x <= F.col("_cut")).alias("_n"))
    return b.join(near.select(*pixels, _at(F.col("_n"), 0.5).alias("depth_m")), pixels).select("key", "depth_m")


def frames_of(telemetry: DataFrame, frames: DataFrame, fps: float) -> DataFrame:
    """frame and the telemetry row (its columns, and i, its number) nearest to its time, counted from the first row; without any time stamp the row of the frame's number, the last one for later frames.

    telemetry has seq, timestamp; frames has frame. Without telemetry there is no row.
    """
    t = settled(indexed(telemetry))
    about = t.agg(F.count("*").alias("n"), F.min_by(F.unix_micros("timestamp"), "i").alias("start"), F.count("timestamp").alias("stamped")).first()
    f = frames.select("frame").distinct()
    if about["stamped"] and about["start"] is not None:
        at = f.select("frame", (F.lit(about["start"]) + F.round(F.col("frame") * 1e6 / fps)).cast("bigint").alias("us"))
        found = asof.nearest(at, t.filter("timestamp is not null").select(F.unix_micros("timestamp").alias("us"), "i"), "us", "us", "i").select("frame", "i")
    else:
        found = f.select("frame", F.least(F.col("frame"), F.lit(about["n"] - 1)).cast("bigint").alias("i"))
    return found.join(t, "i")


def _placed(p: ChainParams):
    return (geo.lla_to_ned, geo.ned_to_lla) if p.flat else (geo.geodetic_to_ned, geo.ned_to_geodetic)


def measured(tracks: DataFrame, telemetry: DataFrame, home: DataFrame, maps: DataFrame, intrinsics: DataFrame, p: ChainParams) -> DataFrame:
    """tracks (row_id, frame_id, track_id, bbox, ...) that can be placed, with depth_m and pos_n, pos_e, pos_d about home. Left out: rows without a box, of frames that telemetry has fewer rows than, that have
    no depth map, or no valid depth in the box. intrinsics: frame, fx, fy, cx, cy; frames after the last have its."""
    rows, last = telemetry.count(), intrinsics.agg(F.max("frame")).first()[0]
    d = tracks.filter((F.col("frame_id") < rows) & (F.size("bbox") == 4))
    maps = settled(maps.join(d.select(F.col("frame_id").cast("bigint").alias("frame")).distinct(), "frame", "left_semi"))
    depth = box_depths(d.select(F.col("row_id").alias("key"), F.col("frame_id").cast("bigint").alias("frame"), "bbox"), maps, p.width, p.height, p.rejected).filter("depth_m > 0")
    d = d.join(depth.withColumnRenamed("key", "row_id"), "row_id")
    sizes = maps.select(F.col("frame").alias("frame_id"), (F.col("w") / p.width).alias("_sx"), (F.col("h") / p.height).alias("_sy"))
    k = intrinsics.select(F.col("frame").alias("_k"), "fx", "fy", "cx", "cy")
    there = frames_of(telemetry, d.select(F.col("frame_id").alias("frame")), p.fps).withColumnRenamed("frame", "frame_id")
    names = ("latitude", "longitude", "altitude", "gimbal_pitch", "gimbal_yaw", "gimbal_roll", "gimbal_mode", "drone_yaw", "drone_roll")
    j = d.join(sizes, "frame_id").withColumn("_k", F.least("frame_id", F.lit(last))).join(k, "_k").join(there.select("frame_id", *(F.col(c).alias(f"_{c}") for c in names)), "frame_id").crossJoin(F.broadcast(home))
    u, v = ((F.col("bbox")[a] + F.col("bbox")[a + 2]) / 2 * F.col(s) for a, s in ((0, "_sx"), (1, "_sy")))
    point = geo.unproject(u, v, F.col("depth_m"), *(F.col(c) for c in ("fx", "fy", "cx", "cy")))
    t = {c: F.col(f"_{c}") for c in names}
    axes = geo.gimbal_axes(t["gimbal_mode"], t["gimbal_pitch"], t["gimbal_yaw"], t["gimbal_roll"], t["drone_yaw"], t["drone_roll"], p.use_gimbal_yaw, p.add_drone_yaw, p.declination, p.offset)
    camera = _placed(p)[0](t["latitude"], t["longitude"], t["altitude"], F.col("home_lat"), F.col("home_lon"), F.col("home_height"))
    n, e, down = geo.camera_to_ned(axes, point, camera)
    return j.select(*tracks.columns, "depth_m", n.alias("pos_n"), e.alias("pos_e"), down.alias("pos_d"))


def object_states(tracks: DataFrame, telemetry: DataFrame, home: DataFrame, maps: DataFrame, intrinsics: DataFrame, p: ChainParams) -> DataFrame:
    """measured() rows with filtered places and velocities: first_detect_frame, lat, lon, alt, pos_ned, vel_ned, speed_mph, heading_deg (null at rest)."""
    m = settled(measured(tracks, telemetry, home, maps, intrinsics, p))
    k = states.kalman_tracks(m.withColumn("row_id", F.col("row_id").cast("bigint")).withColumn("track_id", F.col("track_id").cast("bigint")), p.fps, p.accel, p.sigma, p.sigma_down).drop("track_id")
    first = tracks.groupBy("track_id").agg(F.min("frame_id").alias("first_detect_frame"))
    j = m.join(k, "row_id").join(first, "track_id").crossJoin(F.broadcast(home))
    lat, lon, alt = _placed(p)[1](F.col("kf_n"), F.col("kf_e"), F.col("kf_d"), F.col("home_lat"), F.col("home_lon"), F.col("home_height"))
    vn, ve = F.col("kf_vn"), F.col("kf_ve")
    kept = [c for c in tracks.columns if c not in ("row_id",)]
    return j.select("row_id", *kept, "first_detect_frame", lat.alias("lat"), lon.alias("lon"), alt.alias("alt"), "depth_m", F.array("kf_n", "kf_e", "kf_d").alias("pos_ned"), F.array("kf_vn", "kf_ve", "kf_vd").alias("vel_ned"), geo.speed_mph(vn, ve).alias("speed_mph"), geo.heading(vn, ve).alias("heading_deg"))


def camera_states(telemetry: DataFrame, home: DataFrame, frames: DataFrame, p: ChainParams) -> DataFrame:
    """The camera's own rows, track 0 and class UAV, of each frame (frame): place, velocity and heading as telemetry has them."""
    t = frames_of(telemetry, frames, p.fps).crossJoin(F.broadcast(home))
    ned = _placed(p)[0](F.col("latitude"), F.col("longitude"), F.col("altitude"), F.col("home_lat"), F.col("home_lon"), F.col("home_height"))
    lat, lon, alt = _placed(p)[1](*ned, F.col("home_lat"), F.col("home_lon"), F.col("home_height"))
    heading = F.col("gimbal_yaw") if p.use_gimbal_yaw else F.col("drone_yaw")
    return t.select(F.col("frame").cast("int").alias("frame_id"), F.lit(0).cast("bigint").alias("track_id"), F.lit("UAV").alias("class_name"), lat.alias("lat"), lon.alias("lon"), alt.alias("alt"), F.array(*ned).alias("pos_ned"), F.array("vel_north", "vel_east", "vel_down").alias("vel_ned"), geo.speed_mph(F.col("vel_north"), F.col("vel_east")).alias("speed_mph"), heading.alias("heading_deg"))


def all_states(tracks: DataFrame, telemetry: DataFrame, home: DataFrame, maps: DataFrame, intrinsics: DataFrame, frames: DataFrame, p: ChainParams) -> DataFrame:
    """Objects' and the camera's rows in one table; what the camera's lack is null. writers.write_states puts them in order of frame and track."""
    return object_states(tracks, telemetry, home, maps, intrinsics, p).unionByName(camera_states(telemetry, home, frames, p), allowMissingColumns=True)
