"""The whole way from files to states: tracks, a flight record and depth maps are written as files, read back, and joined."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trackweave.functions import geo
from trackweave.operators import chain, metrics
from trackweave.plans.catalog import SQL, _kalman_sql, _with_home, query
from trackweave.plans.depth import _matrix, _r
from trackweave.plans.streets import _folder
from trackweave.sources import files, readers
from trackweave.sources.adapters import ctes
from trackweave.sources.shared import settled

C = F.col
PLAN = chain.ChainParams(fps=24.0, width=1280.0, height=720.0, flat=True)
FRAMES = 30
COLUMNS = {"lat": 7, "lon": 7, "alt": 4, "depth_m": 5, "speed_mph": 4}


def _read_back(d: DataFrame, t: DataFrame, p: DataFrame):
    """Tracks as JSON lines, telemetry as one record with a row each half second, maps as .npy files, and what is read from them."""
    spark, path = d.sparkSession, _folder(d, "flight")
    files.register(spark)
    d.select("frame_id", "track_id", F.array("x1", "y1", "x2", "y2").alias("bbox"), "confidence", "class_name", "row_id").write.json(f"{path}/tracks")
    clock = F.timestamp_millis(F.lit(1_704_067_200_000) + C("seq").cast("bigint") * 500)
    record = t.select(
        C("latitude").alias("OSD.latitude"), C("longitude").alias("OSD.longitude"), C("altitude").alias("OSD.height [m]"), C("gimbal_pitch").alias("GIMBAL.pitch"), C("gimbal_yaw").alias("GIMBAL.yaw"), C("gimbal_roll").alias("GIMBAL.roll"),
        C("drone_yaw").alias("OSD.yaw"), C("drone_roll").alias("OSD.roll"), C("gimbal_mode").alias("GIMBAL.mode"), C("is_video").alias("CAMERA.isVideo"), C("vel_north").alias("OSD.xSpeed"), C("vel_east").alias("OSD.ySpeed"),
        F.date_format(clock, "M/d/yyyy").alias("CUSTOM.date [local]"), F.date_format(clock, "h:mm:ss.SSS a").alias("CUSTOM.updateTime [local]"), "seq")
    record.repartition(1).sortWithinPartitions("seq").write.csv(f"{path}/record", header=True)  # a record is one file; coalesce would have its task number all rows, too
    maps = p.groupBy(C("frame_id").cast("bigint").alias("frame")).agg(F.transform(F.sort_array(F.collect_list(F.struct("v", "u", "depth"))), lambda x: x.depth.cast("float")).alias("depth"))
    maps.select("frame", F.lit(8).alias("h"), F.lit(8).alias("w"), "depth").write.format("npy").mode("append").save(f"{path}/depth")
    telemetry, home = readers.read_flight(spark, f"{path}/record")
    rows = spark.read.schema(f"{readers.TRACK}, row_id bigint").json(f"{path}/tracks").select("row_id", "frame_id", "track_id", "bbox", "confidence", "class_name")
    lens = spark.range(1).select(C("id").alias("frame"), *(F.lit(x).alias(n) for n, x in (("fx", 10.0), ("fy", 10.0), ("cx", 4.0), ("cy", 4.0))))
    return rows, telemetry, home, readers.read_depth(spark, f"{path}/depth"), lens


@query("detections", "telemetry", "depth_pixels")
def flight_states(d, t, p):
    """Objects' rows and the camera's in the first frames."""
    rows, telemetry, home, maps, lens = _read_back(d, t, p)
    rows, telemetry, home = settled(rows), settled(telemetry), settled(home)
    frames = d.sparkSession.range(FRAMES).select(C("id").alias("frame"))
    s = chain.all_states(rows, telemetry, home, maps, lens, frames, PLAN)
    return s.select("frame_id", "track_id", "row_id", "first_detect_frame", *(F.round(c, n).alias(c) for c, n in COLUMNS.items()))


_box = {k: f"greatest(0, least(round_even({c} * 8 / {s}, 0)::int, {most}))" for k, c, s, most in (("bx1", "x1", 1280.0, 7), ("by1", "y1", 720.0, 7), ("bx2", "x2", 1280.0, 8), ("by2", "y2", 720.0, 8))}
_measured = ctes("detections", "telemetry", "depth_pixels").replace("with ", "with recursive ", 1) + f""",
 f as (select *, row_number() over (order by seq) - 1 i, seq * 500000 us from telemetry where upper(is_video) in ('TRUE', '1', '1.0')), n as (select count(*) n, min(us) s0 from f), home as (select latitude lat0, longitude lon0 from telemetry where seq = 0),
 fr as (select frame_id from detections union select r from range({FRAMES}) t(r)), near as (select frame_id, arg_min(i, (abs(us - s0 - round(frame_id * 1e6 / 24)::bigint), us, i)) i from fr, f, n group by frame_id),
 bx as (select row_id, frame_id, track_id, x1, y1, x2, y2, {', '.join(f'{v} {k}' for k, v in _box.items())} from detections, n where frame_id < n),
 px as (select row_id, p.depth::float::double depth, quantile_cont(p.depth::float::double, 0.7) over (partition by row_id) cut from bx join depth_pixels p using (frame_id) where p.u >= bx1 and p.u < bx2 and p.v >= by1 and p.v < by2 and p.depth > 0),
 dm as (select row_id, median(depth) depth_m from px where depth <= cut group by row_id),
 g as (select row_id, frame_id, track_id, depth_m, ((x1 + x2) / 2 * 8 / 1280 - 4) * depth_m / 10 x, ((y1 + y2) / 2 * 8 / 720 - 4) * depth_m / 10 y, radians(drone_yaw) a, radians(gimbal_pitch) b, radians(case when lower(gimbal_mode) like '%fpv%' then drone_roll + gimbal_roll else gimbal_roll end) c, latitude, longitude, altitude
  from bx join dm using (row_id) join near using (frame_id) join f using (i)),
 measured as (select row_id, frame_id, track_id, depth_m, (latitude - lat0) * 111320 + (cos(a)*sin(b)*sin(c) - sin(a)*cos(c)) * x + (cos(a)*sin(b)*cos(c) + sin(a)*sin(c)) * y + cos(a)*cos(b) * depth_m pos_n,
  (longitude - lon0) * 111320 * cos(radians(lat0)) + (sin(a)*sin(b)*sin(c) + cos(a)*cos(c)) * x + (sin(a)*sin(b)*cos(c) - cos(a)*sin(c)) * y + sin(a)*cos(b) * depth_m pos_e,
  -altitude + cos(b)*sin(c) * x + cos(b)*cos(c) * y - sin(b) * depth_m pos_d from g, home)"""
_filtered = _kalman_sql(measured=_measured).replace("select row_id, track_id, round(pn, 6) + 0 kf_n", "select row_id, track_id, frame_id, pn kf_n").replace("round(pe, 6) + 0", "pe").replace("round(pd, 6) + 0", "pd").replace("round(vpn, 6) + 0", "vpn").replace("round(vpe, 6) + 0", "vpe").replace("round(vpd, 6) + 0", "vpd")
_head, _last = _filtered.rsplit("select row_id, track_id, frame_id, pn kf_n", 1)
SQL["flight_states"] = f"""{_head.rstrip()}, k as (select row_id, track_id, frame_id, pn kf_n{_last}),
 s as (select k.frame_id, k.track_id, k.row_id, first_detect_frame, lat0 + kf_n / 111320 lat, lon0 + kf_e / (111320 * cos(radians(lat0))) lon, -kf_d alt, depth_m, sqrt(kf_vn*kf_vn + kf_ve*kf_ve) * 2.23694 speed_mph
  from k join (select row_id, depth_m from measured) using (row_id) join (select track_id, min(frame_id) first_detect_frame from detections group by track_id) q on q.track_id = k.track_id, home
  union all select frame_id, 0, null, null, latitude, longitude, altitude, null, sqrt(vel_north*vel_north + vel_east*vel_east) * 2.23694 from near join f using (i) where frame_id < {FRAMES})
 select frame_id, track_id, row_id, first_detect_frame, {', '.join(f'round({c}, {n}) {c}' for c, n in COLUMNS.items())} from s"""


#: Errors of the poses against the telemetry row of the same number, about the first row.
_errors = f""", o as (select latitude lat0, longitude lon0, altitude alt0 from telemetry where seq = 0), e as (select seq, tx - radians(longitude - lon0) * 6371000 * cos(radians(lat0)) x, ty - radians(latitude - lat0) * 6371000 y, tz - (altitude - alt0) z,
 degrees(asin(greatest(-1, least(1, -{_r['12']})))) - gimbal_pitch pitch, degrees(atan2({_r['10']}, {_r['11']})) - gimbal_roll roll, degrees(atan2({_r['02']}, {_r['22']})) - gimbal_yaw yaw from poses join telemetry on seq = frame_id, o)"""
AXES = ("x", "y", "z", "pitch", "roll", "yaw")


def _errors_of(p: DataFrame, t: DataFrame) -> DataFrame:
    e, n = geo.local_metres(C("latitude"), C("longitude"), C("lat0"), C("lon0"))
    truth = _with_home(t).select(C("seq").alias("frame_id"), e.alias("x"), n.alias("y"), (C("altitude") - C("alt0")).alias("z"), C("gimbal_pitch").alias("pitch"), C("gimbal_roll").alias("roll"), C("gimbal_yaw").alias("yaw"))
    pitch, roll, yaw = geo.euler(_matrix())
    estimate = p.select("frame_id", C("tx").alias("x"), C("ty").alias("y"), C("tz").alias("z"), pitch.alias("pitch"), roll.alias("roll"), yaw.alias("yaw"))
    return metrics.sample_errors(estimate, truth, "frame_id", AXES)


@query("poses", "telemetry", sql=f"{_errors} select seq as frame_id, {', '.join(f'round({a}, 4) + 0 {a}' for a in AXES)} from e")
def pose_errors(p, t):
    """Estimate less truth, sample by sample."""
    return _errors_of(p, t).select("frame_id", *((F.round(a, 4) + F.lit(0.0)).alias(a) for a in AXES))


@query("poses", "telemetry", sql=f"{_errors} select {', '.join(f'round(sqrt(avg({a} * {a})), 4) rms_{a}' for a in AXES)}, round(sqrt(avg(x*x) + avg(y*y) + avg(z*z)), 4) rms_3d from e")
def rms_errors(p, t):
    return metrics.rms(_errors_of(p, t), AXES).select(*(F.round(f"rms_{a}", 4).alias(f"rms_{a}") for a in (*AXES, "3d")))
