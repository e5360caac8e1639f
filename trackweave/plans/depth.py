"""Queries of cameras and depth: rotations, ellipsoidal places, world points, projections, scales and planes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from trackweave.functions import geo
from trackweave.plans.catalog import SQL, _home, _n2, _with_home, query
from trackweave.sources.adapters import ctes

C = F.col


def exact(digits: int = 6, **columns) -> list:
    """Rounded, without a negative zero."""
    return [(F.round(c, digits) + F.lit(0.0)).alias(n) for n, c in columns.items()]


_angles = """ a as (select *, radians(drone_yaw + 1.5) y, radians(gimbal_pitch) p, radians(case when lower(gimbal_mode) like '%fpv%' then drone_roll + gimbal_roll else gimbal_roll end) r from telemetry)"""


@query("telemetry", sql=f",{_angles} select seq, round(cos(y)*sin(p)*sin(r) - sin(y)*cos(r), 6) + 0 r00, round(cos(y)*sin(p)*cos(r) + sin(y)*sin(r), 6) + 0 r01, round(cos(y)*cos(p), 6) + 0 r02, round(sin(y)*sin(p)*sin(r) + cos(y)*cos(r), 6) + 0 r10, round(sin(y)*sin(p)*cos(r) - cos(y)*sin(r), 6) + 0 r11, round(sin(y)*cos(p), 6) + 0 r12, round(cos(p)*sin(r), 6) + 0 r20, round(cos(p)*cos(r), 6) + 0 r21, round(-sin(p), 6) + 0 r22 from a")
def gimbal_matrix(t):
    """All nine entries, with the airframe's yaw, a declination of 1.5 degrees, and the airframe's roll in FPV mode."""
    r = _gimbal()
    return t.select("seq", *exact(**{f"r{i}{j}": r[i][j] for i in range(3) for j in range(3)}))


def _gimbal():
    return geo.gimbal_axes(C("gimbal_mode"), C("gimbal_pitch"), C("gimbal_yaw"), C("gimbal_roll"), C("drone_yaw"), C("drone_roll"), declination=1.5)


@query("telemetry", sql=f"{_home},{_angles} select seq, round((cos(y)*sin(p)*sin(r) - sin(y)*cos(r))*2 + (cos(y)*sin(p)*cos(r) + sin(y)*sin(r))*-1 + cos(y)*cos(p)*30 + (latitude-lat0)*111320, 6) + 0 n, round((sin(y)*sin(p)*sin(r) + cos(y)*cos(r))*2 + (sin(y)*sin(p)*cos(r) - cos(y)*sin(r))*-1 + sin(y)*cos(p)*30 + (longitude-lon0)*111320*cos(radians(lat0)), 6) + 0 e, round(cos(p)*sin(r)*2 + cos(p)*cos(r)*-1 - sin(p)*30 + alt0-altitude, 6) + 0 d from a, h")
def camera_points_ned(t):
    """A point 30 m ahead, 2 m to the right and 1 m up of each camera."""
    camera = geo.lla_to_ned(C("latitude"), C("longitude"), C("altitude"), C("lat0"), C("lon0"), C("alt0"))
    n, e, d = geo.camera_to_ned(_gimbal(), (F.lit(2.0), F.lit(-1.0), F.lit(30.0)), camera)
    return _with_home(t).select("seq", *exact(n=n, e=e, d=d))


def _ecef_sql(lat: str, lon: str, alt: str, n: str) -> str:
    big = f"(6378137.0::double / sqrt(1 - e2*sin(radians({lat}))*sin(radians({lat}))))"
    return f"({big} + {alt})*cos(radians({lat}))*cos(radians({lon})) {n}x, ({big} + {alt})*cos(radians({lat}))*sin(radians({lon})) {n}y, ({big}*(1 - e2) + {alt})*sin(radians({lat})) {n}z"


_wgs = f"{_home}, k as (select *, (1.0::double/298.257223563::double)*(2 - 1.0::double/298.257223563::double) e2 from telemetry, h), c as (select *, {_ecef_sql('latitude', 'longitude', 'altitude', 'a')}, {_ecef_sql('lat0', 'lon0', 'alt0', 'o')} from k), m as (select *, ax-ox dx, ay-oy dy, az-oz dz, sin(radians(lat0)) sa, cos(radians(lat0)) ca, sin(radians(lon0)) so, cos(radians(lon0)) co from c), g as (select *, -sa*co*dx - sa*so*dy + ca*dz gn, -so*dx + co*dy ge, -ca*co*dx - ca*so*dy - sa*dz gd from m)"


@query("telemetry", sql=f"{_wgs} select seq, round(gn, 4) + 0 n, round(ge, 4) + 0 e, round(gd, 4) + 0 d from g")
def lla_ned_wgs84(t):
    n, e, d = geo.geodetic_to_ned(*(C(c) for c in ("latitude", "longitude", "altitude", "lat0", "lon0", "alt0")))
    return _with_home(t).select("seq", *exact(4, n=n, e=e, d=d))


@query("telemetry", sql="select seq, round(latitude, 7) lat, round(longitude, 7) lon, round(altitude, 3) alt from telemetry")
def ned_lla_wgs84(t):
    """There and back gives the places again."""
    here = [C(c) for c in ("lat0", "lon0", "alt0")]
    x = _with_home(t).select("seq", "lat0", "lon0", "alt0", *(c.alias(n) for n, c in zip("ned", geo.geodetic_to_ned(C("latitude"), C("longitude"), C("altitude"), *here), strict=True)))
    lat, lon, alt = geo.ned_to_geodetic(C("n"), C("e"), C("d"), *here)
    return x.select("seq", F.round(lat, 7).alias("lat"), F.round(lon, 7).alias("lon"), F.round(alt, 3).alias("alt"))


@query("telemetry", sql=f"{_home}, x as (select *, radians(longitude-lon0)*6371000*cos(radians(lat0)) e, radians(latitude-lat0)*6371000 n, radians((select drone_yaw from telemetry where seq = 0)) a from telemetry, h) select seq, round(e, 5) + 0 east, round(n, 5) + 0 north, round(e*cos(a) - n*sin(a), 5) + 0 as right, round(-(altitude - alt0), 5) + 0 as down, round(e*sin(a) + n*cos(a), 5) + 0 ahead from x")
def relative_trajectory(t):
    """Places about the first, and turned by its yaw."""
    first = t.agg(F.min_by("drone_yaw", "seq").alias("yaw0"))
    e, n = geo.local_metres(C("latitude"), C("longitude"), C("lat0"), C("lon0"))
    right, ahead = geo.turned(e, n, C("yaw0"))
    return _with_home(t).crossJoin(F.broadcast(first)).select("seq", *exact(5, east=e, north=n, right=right, down=C("alt0") - C("altitude"), ahead=ahead))


_r = {"00": f"(1-2*(qy*qy+qz*qz)/{_n2})", "01": f"(2*(qx*qy-qz*qw)/{_n2})", "02": f"(2*(qx*qz+qy*qw)/{_n2})", "10": f"(2*(qx*qy+qz*qw)/{_n2})", "11": f"(1-2*(qx*qx+qz*qz)/{_n2})", "12": f"(2*(qy*qz-qx*qw)/{_n2})", "20": f"(2*(qx*qz-qy*qw)/{_n2})", "21": f"(2*(qy*qz+qx*qw)/{_n2})", "22": f"(1-2*(qx*qx+qy*qy)/{_n2})"}


def _matrix():
    return geo.quaternion_matrix(*(C(f"q{a}") for a in "xyzw"))


@query("poses", sql=f"select frame_id, round(degrees(asin(greatest(-1, least(1, -{_r['12']})))), 5) + 0 pitch, round(degrees(atan2({_r['10']}, {_r['11']})), 5) + 0 roll, round(degrees(atan2({_r['02']}, {_r['22']})), 5) + 0 yaw from poses")
def pose_euler(p):
    pitch, roll, yaw = geo.euler(_matrix())
    return p.select("frame_id", *exact(5, pitch=pitch, roll=roll, yaw=yaw))


@query("poses", sql=f"select frame_id, round(tx, 6) + 0 tx, {', '.join(f'round(q{a} * sign(case when qw <> 0 then qw else 1 end) / sqrt({_n2}), 6) + 0 q{a}' for a in 'xyzw')}, round(fov_h, 6) fov_h from poses")
def pose_encode(p):
    """Quaternions and fields of view, from the matrices and focal lengths that they decode to."""
    q = geo.matrix_quaternion(_matrix())
    fov = 2 * F.atan(F.lit(144.0) / geo.focal(C("fov_h"), 288.0))
    return p.select("frame_id", *exact(tx=C("tx"), **{f"q{a}": c for a, c in zip("xyzw", q, strict=True)}, fov_h=fov))


@query("poses", sql="select frame_id, round(-ty, 6) + 0 n, round(tx, 6) + 0 e, round(tz, 6) + 0 d from poses")
def axis_map(p):
    return p.select("frame_id", *exact(n=-C("ty"), e=C("tx"), d=C("tz")))


_K = {"fx": 10.0, "fy": 10.0, "cx": 3.5, "cy": 3.5}
_cam = ", c as (select *, (u - 3.5) * depth / 10 x, (v - 3.5) * depth / 10 y, depth z from depth_pixels join poses using (frame_id) where depth > 1e-8)"
_world = ", ".join(f"round({' + '.join(f'{_r[f"{j}{i}"]} * ({c} - t{c})' for j, c in enumerate('xyz'))}, 5) + 0 w{'xyz'[i]}" for i in range(3))


@query("depth_pixels", "poses", sql=f"{_cam} select frame_id, u, v, {_world} from c")
def depth_world_points(d, p):
    """World points of every pixel with depth."""
    return world_points(d, p).select("frame_id", "u", "v", *exact(5, wx=C("wx"), wy=C("wy"), wz=C("wz")))


def world_points(d: DataFrame, p: DataFrame) -> DataFrame:
    """Pixels (frame_id, u, v, depth) with poses (world to camera) by frame; pixels without depth, or of a frame without a pose, are left out."""
    x, y, z = geo.unproject(C("u"), C("v"), C("depth"), *(F.lit(_K[k]) for k in ("fx", "fy", "cx", "cy")))
    j = d.filter("depth > 1e-8").join(p, "frame_id")
    r = _matrix()
    back = [[r[k][i] for k in range(3)] for i in range(3)]
    w = geo.rotate(back, (x - C("tx"), y - C("ty"), z - C("tz")))
    return j.withColumns({f"w{a}": c for a, c in zip("xyz", w, strict=True)})


@query("depth_pixels", "poses", sql=f"{_cam} select frame_id, u, v, round(u, 4) + 0.0::double pu, round(v, 4) + 0.0::double pv, round(depth, 4) as depth from c")
def world_to_pixels(d, p):
    """World points seen by their own camera fall on their pixels again; -1 for what isn't in front."""
    r = _matrix()
    x, y, z = (a + C(f"t{b}") for a, b in zip(geo.rotate(r, (C("wx"), C("wy"), C("wz"))), "xyz", strict=True))
    ahead = lambda c, f, m: F.round(F.when(z > 1e-6, f * c / z + m).otherwise(-1.0), 4) + F.lit(0.0)
    return world_points(d, p).select("frame_id", "u", "v", ahead(x, _K["fx"], _K["cx"]).alias("pu"), ahead(y, _K["fy"], _K["cy"]).alias("pv"), F.round(z, 4).alias("depth"))


@query("poses", sql="select frame_id, round(tx * 0.3, 6) + 0 x, round(ty * 0.3, 6) + 0 y from poses")
def undistort_points(p):
    """Distorted and undistorted again."""
    u, v = geo.distorted(C("tx") * 0.3, C("ty") * 0.3, 0.1, 0.01)
    x, y = geo.undistorted(C("u"), C("v"), 0.1, 0.01, 40)
    return p.select("frame_id", u.alias("u"), v.alias("v")).select("frame_id", *exact(x=x, y=y))


@query("depth_pixels", sql=", f as (select frame_id, median(case when depth > 12 and frame_id % 3 <> 0 then 40 / depth end) s from depth_pixels group by frame_id), g as (select median(s) g from (select s from f where s is not null order by frame_id limit 20)) select frame_id, u, v, round(depth * coalesce(s, g), 5) as metric from depth_pixels join f using (frame_id), g")
def metric_depth(d):
    """Depth by each frame's scale, or the global one (of the first 20 frames that have any) where a frame has none."""
    f = d.groupBy("frame_id").agg(F.median(F.when((C("depth") > 12) & (C("frame_id") % 3 != 0), 40 / C("depth"))).alias("s"))
    g = f.filter("s is not null").orderBy("frame_id").limit(20).agg(F.median("s").alias("g"))
    return d.join(f, "frame_id").crossJoin(F.broadcast(g)).select("frame_id", "u", "v", F.round(C("depth") * F.coalesce("s", "g"), 5).alias("metric"))


@query("depth_pixels", sql=", x as (select frame_id, u, v, case when frame_id % 5 = 0 and u = 0 then 'nan'::double when frame_id % 5 = 1 and v = 0 then 'inf'::double else depth / 3 end d from depth_pixels) select frame_id, u, v, case when isfinite(d) then round(d, 4) end as depth from x")
def sanitised_depth(d):
    broken = F.when((C("frame_id") % 5 == 0) & (C("u") == 0), F.lit(float("nan"))).when((C("frame_id") % 5 == 1) & (C("v") == 0), F.lit(float("inf"))).otherwise(C("depth") / 3)
    return d.withColumn("d", broken).select("frame_id", "u", "v", F.round(geo.finite(C("d")), 4).alias("depth"))


@query("detections", "depth_pixels", sql="""select row_id, frame_id, round(median(depth), 6) box_depth from (select d.row_id, d.frame_id, p.depth, quantile_cont(p.depth, 0.7) over (partition by d.row_id) cut from detections d join depth_pixels p on p.frame_id = d.frame_id
 and p.u >= least(round_even(x1 / 160, 0), 7) and p.u < greatest(round_even(x2 / 160, 0), least(round_even(x1 / 160, 0), 7) + 1) and p.v >= least(round_even(y1 / 90, 0), 7) and p.v < greatest(round_even(y2 / 90, 0), least(round_even(y1 / 90, 0), 7) + 1)) where depth <= cut group by all""")
def detection_depth(d, p):
    """Robust depth inside each detection's box, scaled to the depth map: median of what is up to the 70th percentile. Detections of frames without a map are left out."""
    lo = {a: F.least(F.bround(C(f"{a}1") / s), F.lit(7.0)) for a, s in (("x", F.lit(160.0)), ("y", F.lit(90.0)))}
    boxes = d.select("row_id", "frame_id", lo["x"].alias("u0"), F.greatest(F.bround(C("x2") / F.lit(160.0)), lo["x"] + 1).alias("u1"), lo["y"].alias("v0"), F.greatest(F.bround(C("y2") / F.lit(90.0)), lo["y"] + 1).alias("v1"))
    rows = boxes.select("row_id", "frame_id", C("u0").cast("int").alias("u0"), C("u1").cast("int").alias("u1"), F.explode(F.sequence(C("v0").cast("int"), C("v1").cast("int") - 1)).alias("v"))
    j = rows.join(p, ["frame_id", "v"]).filter("u >= u0 and u < u1").groupBy("row_id", "frame_id").agg(F.array_sort(F.collect_list("depth")).alias("_in"))  # a box's own pixels, by rows of the map
    # percentile and median of the few pixels of a box, interpolated
    at = lambda x, q: (lambda k: F.element_at(x, (F.floor(k) + 1).cast("int")) + (F.element_at(x, (F.ceil(k) + 1).cast("int")) - F.element_at(x, (F.floor(k) + 1).cast("int"))) * (k - F.floor(k)))(q * (F.size(x) - 1))
    j = j.filter(F.size("_in") > 0).withColumn("_cut", at(C("_in"), F.lit(0.7))).withColumn("_low", F.filter("_in", lambda v: v <= C("_cut")))
    return j.select("row_id", "frame_id", F.round(at(C("_low"), F.lit(0.5)), 6).alias("box_depth"))


@query("detections", "poses", sql=", n as (select max(frame_id) m from poses where frame_id < 50) select row_id, round(144 / tan(fov_h / 2), 6) fy from detections d, n join poses p on p.frame_id = least(d.frame_id, m)")
def clamped_intrinsics(d, p):
    """Each detection with its frame's intrinsics, or the last there are."""
    held = p.filter("frame_id < 50")
    last = held.agg(F.max("frame_id").alias("m"))
    x = d.select("row_id", "frame_id").crossJoin(F.broadcast(last)).select("row_id", F.least("frame_id", "m").alias("frame_id"))
    return x.join(held, "frame_id").select("row_id", F.round(geo.focal(C("fov_h"), 288.0), 6).alias("fy"))


@query("depth_pixels", sql=", x as (select frame_id, u, v, depth, depth * (1 + 0.02 * ((u + v + frame_id) % 7)) seen from depth_pixels) select frame_id, u, v, bool_or(abs(n.depth - x.seen) <= 0.05 * x.seen) visible from x join (select frame_id, u nu, v nv, depth from depth_pixels) n using (frame_id) where nu between u and u + 1 and nv between v and v + 1 group by all")
def depth_visibility(d):
    """Whether a projected depth is within 5 % of one of the four pixels around its place."""
    x = d.select("frame_id", "u", "v", (C("depth") * (1 + F.lit(0.02) * ((C("u") + C("v") + C("frame_id")) % 7))).alias("seen"))
    around = x.withColumn("_s", F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1))))).withColumns({"nu": C("u") + C("_s.a"), "nv": C("v") + C("_s.b")})
    n = d.select("frame_id", C("u").alias("nu"), C("v").alias("nv"), C("depth").alias("near"))
    return around.join(n, ["frame_id", "nu", "nv"]).groupBy("frame_id", "u", "v").agg(F.bool_or(F.abs(C("near") - C("seen")) <= F.lit(0.05) * C("seen")).alias("visible"))


@query("poses", sql="select frame_id, round(259 / tan(fov_w / 2) * 0.5, 6) fx, round(144 / tan(fov_h / 2) * 0.5, 6) fy, round((259 - 100) * 0.5, 6) cx, round((144 - 20) * 0.5, 6) cy from poses")
def cropped_intrinsics(p):
    """Cut by 100 columns and 20 rows, then halved."""
    return p.select("frame_id", *exact(fx=geo.focal(C("fov_w"), 518.0) * 0.5, fy=geo.focal(C("fov_h"), 288.0) * 0.5, cx=F.lit((259 - 100) * 0.5), cy=F.lit((144 - 20) * 0.5)))


@query("depth_pixels", sql=", c as (select frame_id, (u - 3.5) * depth / 10 x, (v - 3.5) * depth / 10 y, depth z, row_number() over (partition by frame_id order by v, u) k, count(*) over (partition by frame_id) n from depth_pixels), s as (select frame_id, count(*) n, sum(x) sx, sum(y) sy, sum(z) sz, sum(x*x) sxx, sum(y*y) syy, sum(x*y) sxy, sum(x*z) sxz, sum(y*z) syz from c group by frame_id), m as (select *, sxx - sx*sx/n a, syy - sy*sy/n b, sxy - sx*sy/n c, sxz - sx*sz/n d, syz - sy*sz/n e from s) select frame_id, round((d*b - e*c)/(a*b - c*c), 5) alpha, round((e*a - d*c)/(a*b - c*c), 5) beta, round(sz/n - (d*b - e*c)/(a*b - c*c)*sx/n - (e*a - d*c)/(a*b - c*c)*sy/n, 4) gamma from m")
def least_squares_plane(d):
    """z = alpha x + beta y + gamma of each frame's camera points, by sums."""
    x, y, z = geo.unproject(C("u"), C("v"), C("depth"), *(F.lit(_K[k]) for k in ("fx", "fy", "cx", "cy")))
    p = d.select("frame_id", x.alias("x"), y.alias("y"), z.alias("z"))
    s = p.groupBy("frame_id").agg(F.count("*").alias("n"), *(F.sum(c).alias(f"s{c}") for c in "xyz"), *(F.sum(C(a) * C(b)).alias(f"s{a}{b}") for a, b in ("xx", "yy", "xy", "xz", "yz")))
    cov = {k: C(f"s{k}") - C(f"s{k[0]}") * C(f"s{k[1]}") / C("n") for k in ("xx", "yy", "xy", "xz", "yz")}
    det = cov["xx"] * cov["yy"] - cov["xy"] * cov["xy"]
    al, be = (cov["xz"] * cov["yy"] - cov["yz"] * cov["xy"]) / det, (cov["yz"] * cov["xx"] - cov["xz"] * cov["xy"]) / det
    return s.select("frame_id", F.round(al, 5).alias("alpha"), F.round(be, 5).alias("beta"), F.round(C("sz") / C("n") - al * C("sx") / C("n") - be * C("sy") / C("n"), 4).alias("gamma"))


def ransac_plane(points: DataFrame, tolerance: float = 1.0, trials: int = 64, seed: int = 7, least: int = 100) -> DataFrame:
    """frame_id, alpha, beta, gamma, inlier_ratio, tilt_deg of the plane z = alpha x + beta y + gamma that most points of a frame are near, refitted to these. A frame of fewer than
    `least` points, or without three that aren't in line, has none. A frame's points go to one task; triples are drawn with a seed, so results repeat."""
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["v", "u"])
        p = g[["x", "y", "z"]].to_numpy(float)
        if len(p) < least:
            return pd.DataFrame(columns=["frame_id", "alpha", "beta", "gamma", "inlier_ratio", "tilt_deg"])
        rng = np.random.default_rng([seed, int(g["frame_id"].iloc[0])])
        a = np.column_stack([p[:, :2], np.ones(len(p))])
        best = np.zeros(len(p), bool)
        for _ in range(trials):
            who = rng.choice(len(p), 3, replace=False)
            if abs(np.linalg.det(a[who])) < 1e-9:
                continue
            near = np.abs(a @ np.linalg.solve(a[who], p[who, 2]) - p[:, 2]) <= tolerance
            best = near if near.sum() > best.sum() else best
        if best.sum() < 3:
            return pd.DataFrame(columns=["frame_id", "alpha", "beta", "gamma", "inlier_ratio", "tilt_deg"])
        fit = np.linalg.lstsq(a[best], p[best, 2], rcond=None)[0]
        tilt = np.degrees(np.arccos(1 / np.sqrt(1 + fit[0] ** 2 + fit[1] ** 2)))
        return pd.DataFrame({"frame_id": [g["frame_id"].iloc[0]], "alpha": [fit[0]], "beta": [fit[1]], "gamma": [fit[2]], "inlier_ratio": [best.mean()], "tilt_deg": [tilt]})
    return points.select("frame_id", "u", "v", "x", "y", "z").groupBy("frame_id").applyInPandas(run, "frame_id int, alpha double, beta double, gamma double, inlier_ratio double, tilt_deg double")


@query("depth_pixels")
def ground_planes(d):
    """Planes of whole segments of ten frames, as one frame's map is small; the canonical height of the camera over them."""
    x, y, z = geo.unproject(C("u"), C("v"), C("depth"), *(F.lit(_K[k]) for k in ("fx", "fy", "cx", "cy")))
    p = ransac_plane(d.select(F.floor(C("frame_id") / 10).cast("int").alias("frame_id"), (C("frame_id") % 10 * 8 + C("u")).alias("u"), "v", x.alias("x"), y.alias("y"), z.alias("z")))
    return p.withColumn("height", F.abs("gamma") / F.sqrt(1 + C("alpha") ** 2 + C("beta") ** 2))


@query("poses", sql=f"select frame_id, round(tx - (select arg_min(tx, frame_id) from poses), 6) + 0 tx, round((sqrt(tx*tx+ty*ty+tz*tz)) / greatest((select sum(case when frame_id % 4 <> 0 then sqrt(tx*tx+ty*ty+tz*tz) else 0 end) / (count(*) filter (where frame_id % 4 <> 0) + 1e-3::double) from poses), 1e-6), 6) as scaled from poses")
def normalised_cameras(p):
    """Relative to the first frame, and distances by their mean over valid frames."""
    far = F.sqrt(C("tx") ** 2 + C("ty") ** 2 + C("tz") ** 2)
    m = p.agg(F.min_by("tx", "frame_id").alias("tx0"), (F.sum(F.when(C("frame_id") % 4 != 0, far).otherwise(0.0)) / (F.count_if(C("frame_id") % 4 != 0) + F.lit(1e-3))).alias("mean"))
    return p.crossJoin(F.broadcast(m)).select("frame_id", *exact(tx=C("tx") - C("tx0"), scaled=far / F.greatest("mean", F.lit(1e-6))))


@query("poses", sql="select round(min(tx), 6) low, round(max(tx), 6) high, round(avg(tx), 6) mean, round(median(tx), 6) mid, round(stddev_pop(tx), 6) spread, count(*) n from poses")
def summary_statistics(p):
    return p.agg(*(F.round(f("tx"), 6).alias(n) for f, n in ((F.min, "low"), (F.max, "high"), (F.avg, "mean"), (F.median, "mid"), (F.stddev_pop, "spread"))), F.count("*").alias("n"))


@query("depth_pixels", sql=", r as (select frame_id, u, v, least(depth, 60) c, row_number() over (partition by frame_id order by least(depth, 60), v, u) k, count(*) over (partition by frame_id) n from depth_pixels), q as (select frame_id, c cut from r where k = round_even(0.9 * (n - 1), 0) + 1) select frame_id, count(*) kept, round(avg(c), 6) mean from r join q using (frame_id) where n <= 10 or c <= cut group by frame_id")
def quantile_filtered(d):
    """Values clamped at 60, then those up to the 90 % rank of their frame, where it has more than ten."""
    c = F.least("depth", F.lit(60.0))
    by = W.partitionBy("frame_id")
    r = d.select("frame_id", "u", "v", c.alias("c")).withColumns({"k": F.row_number().over(by.orderBy("c", "v", "u")), "n": F.count("*").over(by)})
    q = r.filter("k = cast(bround(0.9D * (n - 1)) as int) + 1").select("frame_id", C("c").alias("cut"))
    return r.join(q, "frame_id").filter("n <= 10 or c <= cut").groupBy("frame_id").agg(F.count("*").alias("kept"), F.round(F.avg("c"), 6).alias("mean"))


@query("depth_pixels", sql=", b as (select frame_id, avg(depth) v, count(*) n from depth_pixels where u >= frame_id % 4 group by frame_id) select frame_id // 50 run, round(sum(v * n) / sum(n), 6) meter, sum(n)::bigint n from b group by 1")
def running_average(d):
    """Weighted mean of frames' means, as a meter keeps it."""
    b = d.filter("u >= frame_id % 4").groupBy("frame_id").agg(F.avg("depth").alias("v"), F.count("*").alias("n"))
    return b.groupBy(F.floor(C("frame_id") / 50).cast("int").alias("run")).agg(F.round(F.sum(C("v") * C("n")) / F.sum("n"), 6).alias("meter"), F.sum("n").alias("n"))


@query("poses", sql=", x as (select frame_id, tx, ty, tz, qx, qy from poses), n as (select frame_id, tx/l tx, ty/l ty, tz/l tz, qx/l qx, qy/l qy from (select *, sqrt(tx*tx+ty*ty+tz*tz+qx*qx+qy*qy) l from x)), s as (select a.frame_id, sum(a.tx*b.tx+a.ty*b.ty+a.tz*b.tz+a.qx*b.qx+a.qy*b.qy) s from n a, n b group by a.frame_id) select frame_id, round(s, 4) as total from s order by round(s, 4) desc, frame_id limit 1")
def most_common_frame(p):
    """The frame most like all others: the sum of its cosines is its product with the sum of unit vectors, so no pairs are made."""
    cols = ("tx", "ty", "tz", "qx", "qy")
    length = F.sqrt(sum((C(c) ** 2 for c in cols), F.lit(0.0)))
    x = p.select("frame_id", *((C(c) / length).alias(c) for c in cols))
    m = x.agg(*(F.sum(c).alias(f"s_{c}") for c in cols))
    t = F.round(sum((C(c) * C(f"s_{c}") for c in cols), F.lit(0.0)), 4)
    return x.crossJoin(F.broadcast(m)).select("frame_id", t.alias("total")).orderBy(F.desc("total"), "frame_id").limit(1)


_joint = "(a.seg + 1) % 7 <> 3 and b.depth > 1e-6 and a.depth > 1e-6"


@query("depth_pixels")
def overlap_scales(d):
    """Each segment's scale to the first one's: from the last two frames of the one before, scaled, and its own first two; 1 outright where no pixel is valid in both (here: every seventh segment).

    So scales are products of steps since the last such segment. The window is over a row per segment.
    """
    x = d.select(F.floor(C("frame_id") / 10).cast("int").alias("seg"), (C("frame_id") % 10).alias("local"), "u", "v", "depth")
    a = x.filter("local >= 8 and (seg + 1) % 7 <> 3").select((C("seg") + 1).alias("seg"), (C("local") - 8).alias("local"), "u", "v", C("depth").alias("before"))
    r = x.join(a, ["seg", "local", "u", "v"]).filter("depth > 1e-6 and before > 1e-6").groupBy("seg").agg(F.median(C("before") / C("depth")).alias("step"))
    order = W.orderBy("seg").rowsBetween(W.unboundedPreceding, 0)
    y = x.select("seg").distinct().join(r, "seg", "left").withColumn("run", F.sum(C("step").isNull().cast("int")).over(order))
    scale = F.exp(F.sum(F.coalesce(F.ln("step"), F.lit(0.0))).over(W.partitionBy("run").orderBy("seg").rowsBetween(W.unboundedPreceding, 0)))
    return y.select("seg", F.round("step", 6).alias("step"), F.round(scale, 5).alias("scale"))


SQL["overlap_scales"] = ctes("depth_pixels").replace("with ", "with recursive ", 1) + f""", x as (select frame_id // 10 seg, frame_id % 10 as local, u, v, depth from depth_pixels),
 r as (select b.seg, median(a.depth / b.depth) step from x a join x b on a.seg + 1 = b.seg and a.local - 8 = b.local and a.u = b.u and a.v = b.v where {_joint} group by b.seg),
 g as (select seg, step, row_number() over (order by seg) k from (select distinct seg from x) left join r using (seg)),
 w as (select seg, step, k, 1.0::double as scale from g where k = 1 union all select g.seg, g.step, g.k, case when g.step is null then 1.0 else w.scale * g.step end from w join g on g.k = w.k + 1)
 select seg, round(step, 6) step, round(scale, 5) as scale from w"""
