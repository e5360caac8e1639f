"""All queries by name, each over whole tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W

from trackweave.functions import geo
from trackweave.operators import joins, metrics, states, windows
from trackweave.sources.adapters import ctes, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(*tables: str, sql: str | None = None):
    """Registers f(*adapters) under its name; sql may use the adapters as tables."""
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*(view(spark, sf_dir, t) for t in tables))
        if sql:
            SQL[f.__name__] = f"{ctes(*tables)} {sql}" if not sql.lstrip().startswith(",") else f"{ctes(*tables)}{sql}"
        return f
    return add


def rounded(**columns) -> list:
    return [F.round(c, 6).alias(n) for n, c in columns.items()]


P = "(select * from detections where class_name = 'person' and track_id <> 0)"
C = F.col

query("detections", sql=f""", p as {P}, s as (select crowd_id, lag(crowd_id) over (partition by track_id order by frame_id, row_id) b from p where crowd_id is not null)
 select (select coalesce(sum(case when b <> crowd_id then 1 else 0 end), 0)::bigint from s) switches, (select round(coalesce(avg(case when crowd_id is null then 1.0::double else 0 end), 1), 6) from p) noise_ratio,
 (select count(distinct crowd_id) from p) unique_ids, (select round(coalesce(stddev_pop(n), 0), 6) from (select count(distinct crowd_id) n from p group by video_id, frame_id)) count_std""")(metrics.crowd_metrics)
query("detections", sql=f"select track_id, median(pos_n) median_n, median(pos_e) median_e, min(frame_id) first_frame, count(*) n_rows from {P} group by track_id")(metrics.track_medians)
query("detections", sql="select count(*) n_rows, count(*) filter (where class_name = 'person') n_persons, count(distinct track_id) n_tracks, count(*) filter (where crowd_id is null) n_unassigned from detections")(metrics.counts)
query("detections", sql=f"select video_id, frame_id, crowd_id, median(pos_n) centre_n, median(pos_e) centre_e, count(*) n from {P} where crowd_id is not null group by video_id, frame_id, crowd_id")(metrics.cluster_states)
query("detections", sql=f"select row_id, round((pos_n - avg(pos_n) over w) / greatest(stddev_pop(pos_n) over w, 1e-6), 6) + 0 z_pos_n, round((pos_e - avg(pos_e) over w) / greatest(stddev_pop(pos_e) over w, 1e-6), 6) + 0 z_pos_e from {P} window w as (partition by video_id, frame_id)")(metrics.zscores)
query("depth_pixels", sql="select round(quantile_cont(depth, 0.01), 6) p1, round(quantile_cont(depth, 0.99), 6) p99, count(*) n from depth_pixels where isfinite(depth) and depth > 0")(metrics.depth_range)
query("depth_pixels", sql="select frame_id, round(median(depth), 6) centre_depth from depth_pixels where u between 3 and 5 and v between 3 and 5 group by frame_id")(metrics.centre_depth)
query("depth_pixels", sql=", c as (select frame_id, quantile_cont(depth, 0.7) cut from depth_pixels group by frame_id) select frame_id, round(median(depth), 6) robust_depth from depth_pixels join c using (frame_id) where depth <= cut group by frame_id")(metrics.robust_depth)
query("telemetry", sql="select round(case when max(epoch_us(ts)) > min(epoch_us(ts)) then (count(*) - 1) * 1e6 / (max(epoch_us(ts)) - min(epoch_us(ts))) else 24 end, 9) fps from telemetry")(metrics.frame_rate)


@query("telemetry", sql="select seq, round(sqrt(vel_north*vel_north+vel_east*vel_east) * 2.23694, 6) speed_mph, round(case when abs(vel_north) > .01 or abs(vel_east) > .01 then degrees(atan2(vel_east, vel_north)) end, 6) heading_deg, round(case when sqrt(vel_north*vel_north+vel_east*vel_east) < 1e-6 then 0 else (degrees(atan2(vel_east, vel_north)) + 360) % 360 end, 6) heading_360 from telemetry")
def speed_heading(t):
    vn, ve = C("vel_north"), C("vel_east")
    return t.select("seq", *rounded(speed_mph=geo.speed_mph(vn, ve), heading_deg=geo.heading(vn, ve), heading_360=geo.heading_360(vn, ve)))


@query("telemetry", sql="select seq, round(least((gimbal_yaw - drone_yaw + 720) % 360, 360 - (gimbal_yaw - drone_yaw + 720) % 360), 6) diff, round(degrees(atan2(sin(radians(gimbal_yaw + 90)), cos(radians(gimbal_yaw + 90)))), 6) wrapped from telemetry")
def angles(t):
    return t.select("seq", *rounded(diff=geo.angular_difference(C("gimbal_yaw"), C("drone_yaw")), wrapped=geo.wrap_180(C("gimbal_yaw") + 90)))


_home = ", h as (select latitude lat0, longitude lon0, altitude alt0 from telemetry where seq = 0)"


def _with_home(t):
    h = t.agg(F.min_by(F.struct(C("latitude").alias("lat0"), C("longitude").alias("lon0"), C("altitude").alias("alt0")), "seq").alias("h")).select("h.*")
    return t.crossJoin(F.broadcast(h))


@query("telemetry", sql=_home + " select seq, round((latitude-lat0)*111320, 6) n, round((longitude-lon0)*111320*cos(radians(lat0)), 6) e, round(alt0-altitude, 6) d from telemetry, h")
def lla_ned_flat(t):
    n, e, d = geo.lla_to_ned(C("latitude"), C("longitude"), C("altitude"), C("lat0"), C("lon0"), C("alt0"))
    return _with_home(t).select("seq", *rounded(n=n, e=e, d=d))


@query("telemetry", sql=_home + " select seq, round(lat0 + vel_north*10/111320, 6) lat, round(lon0 + vel_east*10/(111320*cos(radians(lat0))), 6) lon, round(alt0 - vel_down, 6) alt from telemetry, h")
def ned_lla_flat(t):
    lat, lon, alt = geo.ned_to_lla(C("vel_north") * 10, C("vel_east") * 10, C("vel_down"), C("lat0"), C("lon0"), C("alt0"))
    return _with_home(t).select("seq", *rounded(lat=lat, lon=lon, alt=alt))


@query("telemetry", sql="select round(min(x), 3) x0, round(max(x), 3) x1, round(min(y), 3) y0, round(max(y), 3) y1 from (select longitude*20037508.34/180 x, ln(tan((90+least(85, greatest(-85, latitude)))*pi()/360))/(pi()/180)*20037508.34/180 y from telemetry)")
def mercator_bounds(t):
    x, y = geo.mercator(C("latitude"), C("longitude"))
    return t.select(x.alias("x"), y.alias("y")).agg(F.round(F.min("x"), 3).alias("x0"), F.round(F.max("x"), 3).alias("x1"), F.round(F.min("y"), 3).alias("y0"), F.round(F.max("y"), 3).alias("y1"))


@query("detections", sql="select row_id, round(((x1+x2)/2*0.5-320)*20/500, 6) x, round(((y1+y2)/2*0.5-180)*20/500, 6) y from detections")
def unproject_bbox(d):
    """Centres of boxes, scaled to half size, at 20 m."""
    x, y, _ = geo.unproject((C("x1") + C("x2")) / 2 * 0.5, (C("y1") + C("y2")) / 2 * 0.5, F.lit(20.0), F.lit(500.0), F.lit(500.0), F.lit(320.0), F.lit(180.0))
    return d.select("row_id", *rounded(x=x, y=y))


_yaw = "case when lower(gimbal_mode) like '%fpv%' then drone_yaw else gimbal_yaw end"


@query("telemetry", sql=f"select seq, round(round(cos(y)*cos(p), 9), 6) + 0 n, round(round(sin(y)*cos(p), 9), 6) + 0 e, round(round(-sin(p), 9), 6) + 0 d, round(case when abs(cos(p)) > 1e-6 then degrees(atan2(round(sin(y)*cos(p), 9) + 0, round(cos(y)*cos(p), 9) + 0)) else drone_yaw end, 6) heading from (select *, radians({_yaw}) y, radians(gimbal_pitch) p from telemetry)")
def camera_heading_ne(t):
    """Where the camera's axis points, and its heading; the airframe's if it looks straight down."""
    r = geo.camera_axes(geo.effective_yaw(C("gimbal_mode"), C("gimbal_yaw"), C("drone_yaw")), C("gimbal_pitch"), C("gimbal_roll"))
    n, e, d = (F.round(row[2], 9) + F.lit(0.0) for row in r)  # no negative zero
    return t.select("seq", *rounded(n=n, e=e, d=d, heading=F.when(F.hypot(n, e) > 1e-6, F.degrees(F.atan2(e, n))).otherwise(C("drone_yaw"))))


@query("telemetry", sql="select seq, round(least(greatest(-gimbal_pitch, 0), 90), 6) below, round(case when altitude > 0 and -gimbal_pitch >= 5 then altitude / sin(radians(least(-gimbal_pitch, 90))) end, 6) slant from telemetry")
def slant_ranges(t):
    below = geo.pitch_below_horizontal(C("gimbal_pitch"))
    return t.select("seq", *rounded(below=below, slant=geo.slant_range(C("altitude"), below)))


_n2 = "(qx*qx+qy*qy+qz*qz+qw*qw)"


@query("poses", sql=f"select frame_id, round(1-2*(qy*qy+qz*qz)/{_n2}, 6) r00, round(2*(qx*qy-qz*qw)/{_n2}, 6) r01, round(2*(qx*qz+qy*qw)/{_n2}, 6) r02, round(144/tan(fov_h/2), 6) fy, round(259/tan(fov_w/2), 6) fx from poses")
def pose_decode(p):
    r = geo.quaternion_matrix(*(C(f"q{a}") for a in "xyzw"))
    return p.select("frame_id", *rounded(r00=r[0][0], r01=r[0][1], r02=r[0][2], fy=geo.focal(C("fov_h"), 288.0), fx=geo.focal(C("fov_w"), 518.0)))


@query("poses", sql=f"select frame_id, round(-((1-2*(qy*qy+qz*qz)/{_n2})*tx + 2*(qx*qy+qz*qw)/{_n2}*ty + 2*(qx*qz-qy*qw)/{_n2}*tz), 6) cx, round(-(2*(qx*qy-qz*qw)/{_n2}*tx + (1-2*(qx*qx+qz*qz)/{_n2})*ty + 2*(qy*qz+qx*qw)/{_n2}*tz), 6) cy, round(-(2*(qx*qz+qy*qw)/{_n2}*tx + 2*(qy*qz-qx*qw)/{_n2}*ty + (1-2*(qx*qx+qy*qy)/{_n2})*tz), 6) cz from poses")
def se3_inverse(p):
    """Camera centres of world-to-camera poses."""
    _, t = geo.rigid_inverse(geo.quaternion_matrix(*(C(f"q{a}") for a in "xyzw")), (C("tx"), C("ty"), C("tz")))
    return p.select("frame_id", *rounded(cx=t[0], cy=t[1], cz=t[2]))


@query("detections", sql="select row_id, case when count(*) over (partition by track_id) < 5 then round(pos_n, 6) else round(avg(pos_n) over (partition by track_id order by frame_id, row_id rows between 2 preceding and 2 following), 6) end smooth_n from detections")
def moving_average(d):
    return d.select("row_id", F.round(windows.moving_average(d, "pos_n", "track_id", ["frame_id", "row_id"]), 6).alias("smooth_n"))


@query("detections", sql=""", x as (select *, coalesce(lead(pos_n) over w, pos_n) v1, coalesce(lag(pos_n) over w, pos_n) v0, coalesce(lead(frame_id) over w, frame_id) f1, coalesce(lag(frame_id) over w, frame_id) f0, frame_id - lag(frame_id) over w gap from detections window w as (partition by track_id order by frame_id, row_id))
 select row_id, round(case when f1 = f0 then 0 else (v1 - v0) * 24 / (f1 - f0) end, 6) vel_n, gap from x""")
def central_difference(d):
    order = ["frame_id", "row_id"]
    return d.select("row_id", F.round(windows.central_difference("pos_n", "track_id", "frame_id", order, 24.0), 6).alias("vel_n"), windows.frame_gap("track_id", "frame_id", order).alias("gap"))


@query("detections", sql=""", x as (select *, case when crowd_id is distinct from lag(crowd_id) over w or row_number() over w = 1 then 1 else 0 end c from detections window w as (partition by track_id order by frame_id, row_id))
 select track_id, max(run)::bigint - 1 transitions from (select track_id, sum(c) over (partition by track_id order by frame_id, row_id) run from x) group by track_id""")
def crowd_runs(d):
    return windows.with_runs(d, "crowd_id", "track_id", ["frame_id", "row_id"]).groupBy("track_id").agg((F.max("run") - 1).alias("transitions"))


@query("detections", sql=""", a as (select row_id, track_id, crowd_id, cast(floor(pos_n / 16) as int) street, row_number() over (partition by track_id order by frame_id, row_id) k from detections),
 r as (select *, k - row_number() over (partition by track_id, street order by k) island from a),
 c as (select x.row_id, x.crowd_id own, y.crowd_id v, count(*) n, min(y.k) f from r x join r y on x.track_id = y.track_id and x.street = y.street and x.island = y.island and abs(x.k - y.k) <= 7 where y.crowd_id is not null group by all),
 m as (select row_id, arg_max(v, (n, case when v = own then 1 else 0 end, -f)) v from c group by row_id)
 select r.row_id, m.v crowd_id_mode from r left join m on m.row_id = r.row_id""")
def mode_filter(d):
    """Within stretches of one street (here: bands of 16 m)."""
    x = d.withColumn("street", F.floor(C("pos_n") / 16).cast("int"))
    return windows.mode_filter(x, "crowd_id", "track_id", ["frame_id", "row_id"], segment="street").select("row_id", "crowd_id_mode")


@query("detections", sql="select row_id, track_id, video_id from (select *, row_number() over (partition by video_id, frame_id order by row_id) k from detections) where k = 1")
def dedupe_first(d):
    return windows.first_per(d, ["video_id", "frame_id"], ["row_id"]).select("row_id", "track_id", "video_id")


@query("detections", sql="select crowd_id, row_number() over (order by f, r) compact_id from (select crowd_id, min(frame_id) f, arg_min(row_id, (frame_id, row_id)) r from detections where crowd_id is not null group by crowd_id)")
def id_compaction(d):
    return windows.compact_ids(d, "crowd_id", ["frame_id", "row_id"])


@query("telemetry", sql=""", x as (select *, upper(is_video) in ('TRUE', '1', '1.0') v, cast(floor(epoch_us(ts) / 86400000000) as bigint) as day from telemetry), y as (select *, case when v is distinct from lag(v) over (partition by day order by seq) or row_number() over (partition by day order by seq) = 1 then 1 else 0 end c from x), z as (select *, sum(c) over (partition by day order by seq)::bigint run from y)
 select day, run, min(seq) as first, max(seq) as last, count(*) n from z where v group by day, run""")
def video_sessions(t):
    x = t.withColumns({"v": geo.truthy(C("is_video")), "day": F.floor(F.unix_micros(C("ts").cast("timestamp")) / 86400000000)})
    return windows.sessions(x, "v", "day", "seq")


@query("telemetry", sql="select seq, round(altitude - first_value(altitude) over (partition by epoch_us(ts) // 86400000000 order by seq), 6) climb from telemetry")
def relative_altitude(t):
    x = t.withColumn("day", F.floor(F.unix_micros(C("ts").cast("timestamp")) / 86400000000))
    return x.select("seq", F.round(windows.relative_to_first("altitude", "day", "seq"), 6).alias("climb"))


_hops = ", m as (select max(frame_id) + 1 m from poses), s as (select s * 24 s from m, range(1 + greatest(0, ceil((m - 30) / 24.0)::int)) t(s)), h as (select (s // 24)::bigint segment, (s + k)::bigint as frame, k as local from s, m, range(30) t(k) where s + k < m)"


@query("poses", sql=_hops + " select segment, frame, local from h")
def hopping_segments(p):
    """Of the poses' frames, 30 a segment, 6 of them in the next one, too."""
    frames = p.agg(F.max("frame_id")).first()[0] + 1
    return windows.hopping_segments(p.sparkSession, frames, 30, 6)


@query("poses", sql=_hops + " select segment, frame, local, round(tx, 6) tx from h join poses on frame_id = frame where segment = 0 or local >= 6")
def segment_dedupe(p):
    """Each pose once, in the first segment that has its frame."""
    frames = p.agg(F.max("frame_id")).first()[0] + 1
    kept = windows.hopping_segments(p.sparkSession, frames, 30, 6).filter("segment = 0 or local >= 6")
    return kept.join(p.select(C("frame_id").cast("bigint").alias("frame"), F.round("tx", 6).alias("tx")), "frame")


def _us(c):
    return F.unix_micros(C(c).cast("timestamp"))


@query("detections", "telemetry", sql=", x as (select row_id, (select arg_min(seq, (abs(epoch_us(t.ts) - epoch_us(d.ts)), epoch_us(t.ts), seq)) from telemetry t) seq, (select min(abs(epoch_us(t.ts) - epoch_us(d.ts))) from telemetry t) dt_us from detections d) select row_id, seq, dt_us from x")
def telemetry_nearest(d, t):
    return joins.nearest_in_time(d.select("row_id", _us("ts").alias("us")), t.select(C("seq").cast("bigint").alias("seq"), _us("ts").alias("us")), "us", "us", "seq").select("row_id", C("seq").cast("int").alias("seq"), "dt_us")


@query("detections", sql=f", p as {P} select a.row_id, count(*) - 1 density from p a join p b on a.video_id = b.video_id and a.frame_id = b.frame_id and (a.pos_n-b.pos_n)*(a.pos_n-b.pos_n)+(a.pos_e-b.pos_e)*(a.pos_e-b.pos_e) <= 100 + 1e-9 group by a.row_id")
def neighbour_density_10m(d):
    return joins.radius_neighbours(metrics.persons(d), ["video_id", "frame_id"], "pos_n", "pos_e", "row_id")


_poly = f""", p as {P}, g as (select name, n, e, coalesce(lead(n) over w, first_value(n) over w) n2, coalesce(lead(e) over w, first_value(e) over w) e2 from polygon_vertices window w as (partition by name, ring_id order by seq)),
 a as (select name, round(abs(sum(n*e2-n2*e))/2, 9) area from g group by name), i as (select p.row_id, g.name from p join g on true where g.e <> g.e2 group by p.row_id, g.name having sum(case when ((g.e > p.pos_e) <> (g.e2 > p.pos_e)) and p.pos_n < (g.n2-g.n)*(p.pos_e-g.e)/(g.e2-g.e)+g.n then 1 else 0 end) % 2 = 1),
 b as (select row_id, name, row_number() over (partition by row_id order by area, name) k from i join a using (name)), placed as (select p.row_id, p.track_id, b.name place from p left join b on b.row_id = p.row_id and k = 1)"""


def _placed(d, v):
    p = metrics.persons(d)
    return p.select("row_id", "track_id").join(joins.smallest_polygon(p, "row_id", "pos_n", "pos_e", v), "row_id")


@query("detections", "polygon_vertices", sql=_poly + " select row_id, place from placed")
def point_in_polygon_smallest(d, v):
    return _placed(d, v).select("row_id", "place")


@query("detections", "polygon_vertices", sql=_poly + """, n as (select track_id, place, count(*) n from placed group by all), r as (select *, sum(n) over (partition by track_id) total, row_number() over (partition by track_id order by n desc, place nulls last) k from n)
 select track_id, max(place) filter (where k = 1) as first, round(max(n) filter (where k = 1) / max(total), 6) as share, max(place) filter (where k = 2) as second, round(coalesce(max(n) filter (where k = 2), 0) / max(total), 6) second_share, max(n) filter (where k = 1) / max(total) < 0.8 as cross from r group by track_id""")
def residency_qa(d, v):
    return metrics.residency(_placed(d, v))


@query("polygon_vertices", sql="select name, dense_rank() over (order by name)::int street_index from (select distinct name from polygon_vertices)")
def street_index_map(v):
    return v.select("name").distinct().withColumn("street_index", F.dense_rank().over(W.orderBy("name")))


@query("graph_edges", sql="select src, dst, round((degrees(atan2(x2-x1, y2-y1)) + 360) % 360, 6) bearing from graph_edges")
def edge_bearings(g):
    return g.select("src", "dst", F.round(F.pmod(F.degrees(F.atan2(C("x2") - C("x1"), C("y2") - C("y1"))), F.lit(360.0)), 6).alias("bearing"))


@query("detections", "graph_edges", sql=f", p as {P}, n as (select distinct src node, x1, y1 from graph_edges) select row_id, arg_min(node, (round((pos_n-n.x1)*(pos_n-n.x1)+(pos_e-n.y1)*(pos_e-n.y1), 9), node)) node from p, n group by row_id")
def nearest_node(d, g):
    return _snapped(d, g).select("row_id", "node")


def _snapped(d, g):
    n = g.select(C("src").alias("node"), "x1", "y1").distinct()
    return joins.nearest_point(metrics.persons(d), "row_id", "pos_n", "pos_e", n, "node", "x1", "y1", cell=8.0)


@query("detections", "graph_edges", sql=f""", recursive_placeholder as (select 1)""")
def eta_shortest_path(d, g):
    starts = _snapped(d, g).select("row_id", "node", ((C("row_id") * 13) % 360).cast("double").alias("heading_deg"), (C("row_id") % 7 / F.lit(4.0)).cast("double").alias("speed"))
    return states.arrival_times(starts, g, states.distances_to(g, 24))


SQL["eta_shortest_path"] = ctes("detections", "graph_edges").replace("with ", "with recursive ", 1) + f""", p as {P}, n as (select distinct src node, x1, y1 from graph_edges),
 s as (select row_id, arg_min(node, (round((pos_n-n.x1)*(pos_n-n.x1)+(pos_e-n.y1)*(pos_e-n.y1), 9), node)) node, (row_id*13 % 360)::double h, (row_id % 7)/4.0::double sp from p, n group by row_id),
 w as (select 24 node, 0::double dist, 0 hops union select e.src, w.dist + e.length, hops + 1 from w join graph_edges e on e.dst = w.node where hops < 12),
 t as (select node, min(dist) dist from w group by node),
 x as (select row_id, sp, length + dist d, (degrees(atan2(x2-x1, y2-y1)) + 360) % 360 - h b from s join graph_edges g on g.src = s.node join t on t.node = g.dst),
 y as (select row_id, sp, coalesce(min(d) filter (where least((b + 360) % 360, 360 - (b + 360) % 360) <= 90), min(d)) d from x group by row_id, sp)
 select row_id, round(d, 2) distance_m, round(d / greatest(sp, 0.5), 1) eta_s from y"""


@query("detections", sql="select frame_id, count(*) filter (where class_name = 'person') n_persons, coalesce(string_agg(track_id::varchar, ',' order by track_id) filter (where class_name = 'person'), '') ids from (select f frame_id, track_id, class_name from range(0, (select max(frame_id) + 1 from detections)) r(f) left join detections on frame_id = f) group by frame_id")
def frame_buckets(d):
    """Every frame from 0 to the last, with its persons in order."""
    top = d.agg(F.max("frame_id").alias("m")).select(F.explode(F.sequence(F.lit(0), C("m"))).alias("frame_id"))
    g = metrics.persons(d).groupBy("frame_id").agg(F.sort_array(F.collect_list("track_id")).alias("_ids"))
    x = top.join(g, "frame_id", "left")
    return x.select(C("frame_id").cast("bigint").alias("frame_id"), F.coalesce(F.size("_ids"), F.lit(0)).cast("bigint").alias("n_persons"), F.coalesce(F.array_join(C("_ids").cast("array<string>"), ","), F.lit("")).alias("ids"))


@query("detections", sql=", m as (select (max(frame_id) + 1) / 41.0::double ratio, max(frame_id) >= 41 beyond from detections) select row_id, least(greatest(case when beyond then round_even(frame_id / ratio, 0) else frame_id end, 0), 40)::bigint frame from detections, m")
def frame_remap(d):
    """Frames on 41 depth maps, by the ratio that is found."""
    return metrics.remapped_frames(d.select("row_id", C("frame_id").alias("frame")), "frame", 41)


@query("telemetry", sql="select row_number() over (order by i) - 1 as sample, seq, altitude from (select i, floor(i * ((select count(*) from telemetry) - 1) / 119)::bigint k from range(120) r(i)) join telemetry on seq = k")
def telemetry_resample(t):
    n = t.count()
    return joins.resample_index(t.withColumn("seq", C("seq").cast("bigint")), "seq", 120, n).select("sample", C("seq").cast("int").alias("seq"), "altitude")


@query("detections", sql=f", p as {P}, c as (select video_id, frame_id, crowd_id, median(pos_n) n, median(pos_e) e from p where crowd_id is not null group by all) select a.video_id, a.frame_id, a.crowd_id a, b.crowd_id b, round(sqrt((a.n-b.n)*(a.n-b.n)+(a.e-b.e)*(a.e-b.e)), 6) cost from c a join c b on b.video_id = a.video_id and b.frame_id = a.frame_id + 1")
def cluster_cost_matrix(d):
    c = metrics.cluster_states(d)
    b = c.select("video_id", (C("frame_id") - 1).alias("frame_id"), C("crowd_id").alias("b"), C("centre_n").alias("n2"), C("centre_e").alias("e2"))
    return c.join(b, ["video_id", "frame_id"]).select("video_id", "frame_id", C("crowd_id").alias("a"), "b", F.round(F.hypot(C("centre_n") - C("n2"), C("centre_e") - C("e2")), 6).alias("cost"))




def _kalman_sql(down: float = 4.0, fps: float = 24.0, measured: str | None = None) -> str:
    """The same filter, row by row of a track: covariances of the horizontal axes (h) and the vertical one (z), predicted over a gap in closed form."""
    dt, q, g = f"(1.0::double/{fps}::double)", "0.25::double", "(n.frame_id - w.frame_id)::double"
    grown = (
        lambda a: f"w.{a}00 + 2*{g}*{dt}*w.{a}01 + {g}*{g}*{dt}*{dt}*w.{a}11 + {q}*{dt}*{dt}*{dt}*{dt}*({g}/4 + {g}*({g}-1)/2 + {g}*({g}-1)*(2*{g}-1)/6)",
        lambda a: f"w.{a}01 + {g}*{dt}*w.{a}11 + {q}*{dt}*{dt}*{dt}*({g}/2 + {g}*({g}-1)/2)",
        lambda a: f"w.{a}11 + {q}*{dt}*{dt}*{g}",
    )
    predicted = ", ".join(f"{f(a)} {a}{k}" for a in "hz" for f, k in zip(grown, ("00", "01", "11"), strict=True))
    moved = ", ".join(f"w.{x} + {g}*{dt}*w.v{x} {x}, w.v{x} v{x}" for x in ("pn", "pe", "pd"))
    gain = ", ".join(f"{a}00/({a}00+{r}) {a}k, {a}01/({a}00+{r}) {a}l" for a, r in (("h", "25.0::double"), ("z", f"{down}::double")))
    new = ", ".join(f"{x} + {a}k*(m{x} - {x}) {x}, v{x} + {a}l*(m{x} - {x}) v{x}" for x, a in (("pn", "h"), ("pe", "h"), ("pd", "z")))
    left = ", ".join(f"{a}00 - {a}k*{a}00 {a}00, {a}01 - {a}k*{a}01 {a}01, {a}11 - {a}l*{a}01 {a}11" for a in "hz")
    start = ctes("detections").replace("with ", "with recursive ", 1) + ", " if measured is None else measured + ", "
    rows = "m as (select row_id, track_id, frame_id, pos_n mpn, pos_e mpe, -(40 + row_id % 60)::double mpd, row_number() over (partition by track_id order by frame_id, row_id) k from detections)" if measured is None else "m as (select row_id, track_id, frame_id, pos_n mpn, pos_e mpe, pos_d mpd, row_number() over (partition by track_id order by frame_id, row_id) k from measured)"
    return start + rows + f""",
     w as (select row_id, track_id, frame_id, k, mpn pn, 0.0::double vpn, mpe pe, 0.0::double vpe, mpd pd, 0.0::double vpd, 25.0::double h00, 0.0::double h01, 4.0::double h11, 25.0::double z00, 0.0::double z01, 4.0::double z11 from m where k = 1
      union all select row_id, track_id, frame_id, k, {new}, {left} from (select *, {gain} from (select n.row_id, n.track_id, n.frame_id, n.k, mpn, mpe, mpd, {moved}, {predicted} from m n join w on n.track_id = w.track_id and n.k = w.k + 1)))
     select row_id, track_id, round(pn, 6) + 0 kf_n, round(pe, 6) + 0 kf_e, round(pd, 6) + 0 kf_d, round(vpn, 6) + 0 kf_vn, round(vpe, 6) + 0 kf_ve, round(vpd, 6) + 0 kf_vd from w"""


@query("detections")
def kalman_tracks(d):
    """Places in three axes; heights made up from the row, as detections have none."""
    k = states.kalman_tracks(d.withColumn("pos_d", -(40 + C("row_id") % 60).cast("double")))
    return k.select("row_id", "track_id", *((F.round(f"kf_{x}", 6) + F.lit(0.0)).alias(f"kf_{x}") for x in ("n", "e", "d", "vn", "ve", "vd")))


SQL["kalman_tracks"] = _kalman_sql()


@query("detections")
def kalman_isotropic(d):
    """Equal noise on all axes."""
    k = states.kalman_tracks(d.withColumn("pos_d", -(40 + C("row_id") % 60).cast("double")), sigma_down=5.0)
    return k.select("row_id", "track_id", *((F.round(f"kf_{x}", 6) + F.lit(0.0)).alias(f"kf_{x}") for x in ("n", "e", "d", "vn", "ve", "vd")))


SQL["kalman_isotropic"] = _kalman_sql(25.0)


@query("detections")
def crowd_identity(d):
    c = metrics.persons(d).filter("crowd_id is not null").groupBy("video_id", "frame_id", C("crowd_id").alias("label")).agg(F.median("pos_n").alias("centre_n"), F.median("pos_e").alias("centre_e"))
    return states.cluster_identity(c, "video_id")


SQL = {k: v for k, v in SQL.items() if "placeholder" not in v}
