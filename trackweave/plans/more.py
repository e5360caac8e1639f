"""Further queries of the catalog: set operations, interpolation, sampling, scales, point filters and shapes to draw."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from trackweave.functions import geo
from trackweave.operators import asof, crowds, joins, metrics, windows
from trackweave.plans.catalog import P, query, rounded
from trackweave.sources.readers import indexed
from trackweave.sources.shared import settled

C = F.col
_day = "epoch_us(ts) // 86400000000"


@query("detections", sql=f""", p as {P}, s as (select track_id, crowd_id, lag(crowd_id) over (partition by track_id order by frame_id, row_id) b from p where crowd_id is not null)
 select round((select coalesce(sum(case when b <> crowd_id then 1 else 0 end), 0) from s) / greatest((select count(*) from p), 1)::double + 50 * (select coalesce(round(avg(case when crowd_id is null then 1.0::double else 0 end), 6), 1) from p)
  + 0.5 * (select count(distinct crowd_id) from p) + 2 * (select coalesce(round(stddev_pop(n), 6), 0) from (select count(distinct crowd_id) n from p group by video_id, frame_id)), 5)::double as cost""")
def tuning_cost(d):
    return metrics.composite_cost(metrics.crowd_metrics(d).crossJoin(metrics.persons(d).agg(F.count("*").alias("n"))))


def _day_of(ts: str):
    return F.floor(F.unix_micros(C(ts).cast("timestamp")) / 86400000000)


@query("polygon_vertices", sql=", w as (select name, seq, n + 1 as n2 from polygon_vertices where n > 10), k as (select name, seq, n from polygon_vertices where n < 24) select coalesce(k.name, w.name) as name, coalesce(k.seq, w.seq) as seq, round(coalesce(n2, n), 6) as n from k full join w on k.name = w.name and k.seq = w.seq")
def polygon_upsert(v):
    """Vertices north of 10 replace or join those south of 24."""
    new, old = v.filter("n > 10").select("name", "seq", (C("n") + 1).alias("n2")), v.filter("n < 24").select("name", "seq", "n")
    return old.join(new, ["name", "seq"], "full").select("name", "seq", F.round(F.coalesce("n2", "n"), 6).alias("n"))


@query("polygon_vertices", sql="select distinct name from polygon_vertices where name not in (select name from polygon_vertices where n > 20)")
def names_without_collision(v):
    return v.select("name").distinct().join(v.filter("n > 20").select("name"), "name", "left_anti")


@query("detections", sql="(select track_id, 'both' as side from detections where crowd_id = 1 intersect select track_id, 'both' from detections where crowd_id = 2) union all (select track_id, 'first' from detections where crowd_id = 1 except select track_id, 'first' from detections where crowd_id = 2)")
def track_sets(d):
    one, two = (d.filter(C("crowd_id") == k).select("track_id") for k in (1, 2))
    return one.intersect(two).withColumn("side", F.lit("both")).unionByName(one.subtract(two).withColumn("side", F.lit("first")))


@query("detections", "telemetry", sql="select 'object' as kind, frame_id::bigint frame, track_id::bigint track, confidence from detections union all select 'camera', seq, 0, null from telemetry")
def objects_and_camera(d, t):
    """All rows of both in one table; what the camera's lack is null."""
    o = d.select(F.lit("object").alias("kind"), C("frame_id").cast("bigint").alias("frame"), C("track_id").cast("bigint").alias("track"), "confidence")
    return o.unionByName(t.select(F.lit("camera").alias("kind"), C("seq").cast("bigint").alias("frame"), F.lit(0).cast("bigint").alias("track")), allowMissingColumns=True)


@query("detections", sql="select crowd_id, count(*) n from detections where crowd_id is not null group by crowd_id order by n desc, min(row_id) limit 8")
def largest_crowds(d):
    return d.filter("crowd_id is not null").groupBy("crowd_id").agg(F.count("*").alias("n"), F.min("row_id").alias("_first")).orderBy(F.desc("n"), "_first").limit(8).drop("_first")


@query("poses", sql="select frame_id trial, round(abs(tx) + abs(ty), 6) as cost from poses order by 2, 1 limit 10")
def best_trials(p):
    return p.select(C("frame_id").alias("trial"), F.round(F.abs("tx") + F.abs("ty"), 6).alias("cost")).orderBy("cost", "trial").limit(10)


@query("detections", sql="select row_id from (select row_id, row_number() over (partition by video_id order by frame_id, row_id) - 1 k from detections) where k % 5 = 0")
def every_fifth(d):
    return windows.numbered_within(d.select("row_id", "video_id", "frame_id"), "video_id", ["frame_id", "row_id"]).filter("k % 5 = 0").select("row_id")


@query("detections", sql="select row_id, row_number() over (order by frame_id, track_id, row_id) - 1 as i from detections")
def rows_in_order(d):
    """Each row's number in the order of frames and tracks."""
    x = indexed(d.select("row_id", F.struct("frame_id", "track_id", "row_id").alias("at")), "at")
    return x.select("row_id", C("i").cast("bigint").alias("i"))


@query("detections", sql="select row_id, string_agg(frame_id::varchar, '-') over (partition by track_id order by frame_id, row_id rows unbounded preceding) trail from detections")
def track_trails(d):
    """The frames of a track up to each of its rows."""
    return windows.trail(d, "track_id", ["frame_id", "row_id"], ["frame_id"]).select("row_id", F.array_join(F.transform("trail", lambda x: x.frame_id.cast("string")), "-").alias("trail"))


@query("detections", sql="select row_id from detections order by md5('7:' || row_id::varchar), row_id limit 100")
def seeded_cap(d):
    """At most 100 rows, by a seeded hash."""
    return d.select("row_id").orderBy(F.md5(F.concat(F.lit("7:"), C("row_id").cast("string")).cast("binary")), "row_id").limit(100)


@query("detections", sql="select row_id, video_id * 10000 + crowd_id as global_id, (video_id * 10000 + crowd_id) // 10000 as street, (video_id * 10000 + crowd_id) % 10000 as local_id, (crowd_id - 1) % 12 as palette from detections where crowd_id is not null")
def crowd_namespace(d):
    g = C("video_id") * 10000 + C("crowd_id")
    return d.filter("crowd_id is not null").select("row_id", g.alias("global_id"), F.floor(g / 10000).cast("int").alias("street"), (g % 10000).alias("local_id"), ((C("crowd_id") - 1) % 12).alias("palette"))


_near = f", p as {P}, n as (select a.row_id, count(*) - 1 density from p a join p b on a.video_id = b.video_id and a.frame_id = b.frame_id and (a.pos_n-b.pos_n)*(a.pos_n-b.pos_n)+(a.pos_e-b.pos_e)*(a.pos_e-b.pos_e) <= 100 + 1e-9 group by a.row_id), cap as (select greatest(quantile_cont(density, 0.99), 0.1) cap from n)"


@query("detections", sql=f"{_near}, t as (select row_id, least(1, greatest(0, density / cap)) t from n, cap) select row_id, printf('#%02X%02X%02X', floor(204 * (1 - t) + 10 * t)::int, floor(204 * (1 - t) + 36 * t)::int, floor(204 * (1 - t) + 99 * t)::int) colour from t")
def density_colours(d):
    """People's density on a scale up to its 99th percentile."""
    n = settled(joins.radius_neighbours(metrics.persons(d), ["video_id", "frame_id"], "pos_n", "pos_e", "row_id"))
    cap = metrics.density_cap(n, "density").first()["cap"]
    return n.select("row_id", geo.density_colour(C("density").cast("double"), cap).alias("colour"))


@query("telemetry", sql="select seq, k::int k, round(10 * cos(radians(drone_yaw - 45 + 3.75 * k)), 6) + 0 n, round(10 * sin(radians(drone_yaw - 45 + 3.75 * k)), 6) + 0 e from telemetry, range(25) r(k)")
def heading_sectors(t):
    """25 points of an arc of 10 m, 45 degrees to either side of the heading."""
    a = F.radians(C("drone_yaw") - 45 + 3.75 * C("k"))
    return t.select("seq", "drone_yaw", F.explode(F.sequence(F.lit(0), F.lit(24))).alias("k")).select("seq", "k", (F.round(10 * F.cos(a), 6) + F.lit(0.0)).alias("n"), (F.round(10 * F.sin(a), 6) + F.lit(0.0)).alias("e"))


@query("telemetry", sql="select seq, round(latitude + vel_north / 111320, 8) lat2, round(longitude + vel_east / (111320 * cos(radians(latitude))), 8) lon2 from telemetry where sqrt(vel_north*vel_north + vel_east*vel_east) >= 0.15")
def velocity_arrows(t):
    """Places one second ahead of everything that moves."""
    return t.filter(F.hypot("vel_north", "vel_east") >= 0.15).select("seq", F.round(C("latitude") + C("vel_north") / 111320, 8).alias("lat2"), F.round(C("longitude") + C("vel_east") / (111320 * F.cos(F.radians("latitude"))), 8).alias("lon2"))


@query("telemetry", sql=f"select seq, coalesce(case when seq % 7 <> 0 then gimbal_yaw end, 0) yaw, round(coalesce(case when seq % 5 <> 0 then altitude end, avg(case when seq % 5 <> 0 then altitude end) over (partition by {_day})), 6) altitude, coalesce(case when seq % 3 <> 0 then gimbal_mode end, 'Follow Yaw') as mode from telemetry")
def telemetry_fill(t):
    """Gaps in yaw, altitude (the day's mean) and mode."""
    alt = F.when(C("seq") % 5 != 0, C("altitude"))
    x = t.select("seq", _day_of("ts").alias("day"), F.when(C("seq") % 7 != 0, C("gimbal_yaw")).alias("yaw"), alt.alias("_a"), F.when(C("seq") % 3 != 0, C("gimbal_mode")).alias("mode"))
    return x.withColumn("altitude", F.round(F.coalesce("_a", F.avg("_a").over(W.partitionBy("day"))), 6)).na.fill({"yaw": 0.0, "mode": "Follow Yaw"}).select("seq", "yaw", "altitude", "mode")


@query("detections", sql="select row_id, frame_id - 10 as frame from detections where frame_id between 10 and 40")
def time_crop(d):
    return d.filter(C("frame_id").between(10, 40)).select("row_id", (C("frame_id") - 10).alias("frame"))


@query("poses", sql="select frame_id, y::int y, x::int x from poses, range(4) a(y), range(6) b(x)")
def pixel_grid(p):
    return p.select("frame_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("y")).select("frame_id", "y", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("x"))


@query("depth_pixels", sql=", p as (select *, (frame_id % 28) / 4.0::double u0, (frame_id % 24) / 4.0::double v0 from depth_pixels) select frame_id, round(sum(depth * (1 - abs(u - u0)) * (1 - abs(v - v0))), 6) as sample from p where abs(u - u0) < 1 and abs(v - v0) < 1 group by frame_id")
def bilinear_sample(p):
    """Depth at one fractional pixel of each frame from its four neighbours."""
    du, dv = F.abs(C("u") - (C("frame_id") % 28) / F.lit(4.0)), F.abs(C("v") - (C("frame_id") % 24) / F.lit(4.0))
    return p.filter((du < 1) & (dv < 1)).groupBy("frame_id").agg(F.round(F.sum(C("depth") * (1 - du) * (1 - dv)), 6).alias("sample"))


@query("depth_pixels", sql=", q as (select frame_id, quantile_cont(depth, 0.01) lo, quantile_cont(depth, 0.99) hi from depth_pixels group by frame_id) select frame_id, u, v, round(case when depth between lo and hi then depth else 0 end, 6) as depth from depth_pixels join q using (frame_id)")
def depth_clamp(p):
    q = p.groupBy("frame_id").agg(F.percentile("depth", F.array(F.lit(0.01), F.lit(0.99))).alias("q"))
    return p.join(q, "frame_id").select("frame_id", "u", "v", F.round(F.when(C("depth").between(C("q")[0], C("q")[1]), C("depth")).otherwise(0.0), 6).alias("depth"))


@query("depth_pixels", sql=", f as (select frame_id, median(40 / depth) s from depth_pixels where depth > 12 group by frame_id order by frame_id limit 20) select round(median(s), 6) as scale, count(*) n from f")
def global_scale(p):
    """From the first 20 frames with valid pixels."""
    f = p.filter("depth > 12").groupBy("frame_id").agg(F.median(40 / C("depth")).alias("s")).orderBy("frame_id").limit(20)
    return f.agg(F.round(F.median("s"), 6).alias("scale"), F.count("*").alias("n"))


@query("depth_pixels", sql=", x as (select frame_id // 10 seg, frame_id % 10 as local, u, v, depth from depth_pixels), r as (select b.seg, median(a.depth / b.depth) step from x a join x b on a.seg + 1 = b.seg and a.local = b.local and a.u = b.u and a.v = b.v where b.depth > 1e-8 group by b.seg) select seg, round(step, 6) step, round(exp(sum(ln(step)) over (order by seg)), 6) as scale from r")
def segment_scales(p):
    """Median depth ratio of each segment to the one before, and their running product; a window over one row per segment."""
    x = p.select(F.floor(C("frame_id") / 10).cast("int").alias("seg"), (C("frame_id") % 10).alias("local"), "u", "v", "depth")
    a = x.select((C("seg") + 1).alias("seg"), "local", "u", "v", C("depth").alias("before"))
    r = x.filter("depth > 1e-8").join(a, ["seg", "local", "u", "v"]).groupBy("seg").agg(F.median(C("before") / C("depth")).alias("step"))
    return r.select("seg", F.round("step", 6).alias("step"), F.round(F.exp(F.sum(F.ln("step")).over(W.orderBy("seg"))), 6).alias("scale"))


@query("detections", sql="select frame_id, count(*) n from detections where confidence >= 0.75 group by frame_id having count(*) >= 2")
def frame_inliers(d):
    return d.filter("confidence >= 0.75").groupBy("frame_id").agg(F.count("*").alias("n")).filter("n >= 2")


@query("telemetry", sql="select round(min(latitude) - 0.002, 6) south, round(max(latitude) + 0.002, 6) north, round(min(longitude) - 0.002, 6) west, round(max(longitude) + 0.002, 6) east from telemetry")
def bounds_with_margin(t):
    return metrics.bounds(t, "latitude", "longitude", 0.002).select(*rounded(south=C("south"), north=C("north"), west=C("west"), east=C("east")))


@query("poses", sql="select frame_id, round(coalesce(case when tz > 1e-6 then 500 * tx / tz + 320 end, -1), 6) u, round(coalesce(case when tz > 1e-6 then 500 * ty / tz + 180 end, -1), 6) v from poses")
def project_points(p):
    """Pixels of camera points, -1 behind the camera."""
    return p.select("frame_id", *(F.round(F.when(C("tz") > 1e-6, 500 * C(f"t{a}") / C("tz") + c).otherwise(-1.0), 6).alias(n) for a, c, n in (("x", 320, "u"), ("y", 180, "v"))))


@query("poses", sql="select frame_id, round(tx * (1 + 0.1 * (tx*tx+ty*ty) + 0.01 * (tx*tx+ty*ty) * (tx*tx+ty*ty)), 6) u, round(ty * (1 + 0.1 * (tx*tx+ty*ty) + 0.01 * (tx*tx+ty*ty) * (tx*tx+ty*ty)), 6) v from poses")
def radial_distortion(p):
    r2 = C("tx") * C("tx") + C("ty") * C("ty")
    return p.select("frame_id", *rounded(u=C("tx") * (1 + 0.1 * r2 + 0.01 * r2 * r2), v=C("ty") * (1 + 0.1 * r2 + 0.01 * r2 * r2)))


_DIMS = ("tx", "ty", "tz", "qx", "qy", "qz", "qw")
_norm = f"sqrt({' + '.join(f'{c}*{c}' for c in _DIMS)})"


@query("poses", sql=f", x as (select frame_id, {', '.join(f'{c} / {_norm} as {c}' for c in _DIMS)} from poses), m as (select {', '.join(f'avg({c}) as m_{c}' for c in _DIMS)} from x) select frame_id, round({' + '.join(f'{c} * m_{c}' for c in _DIMS)}, 6) as likeness from x, m")
def mean_similarity(p):
    """Mean cosine of each frame with all frames: the product with the mean unit vector, so no pairs are made."""
    norm = F.sqrt(reduce(lambda a, b: a + b, (C(c) * C(c) for c in _DIMS)))
    x = p.select("frame_id", *((C(c) / norm).alias(c) for c in _DIMS))
    m = x.agg(*(F.avg(c).alias(f"m_{c}") for c in _DIMS))
    return x.crossJoin(F.broadcast(m)).select("frame_id", F.round(reduce(lambda a, b: a + b, (C(c) * C(f"m_{c}") for c in _DIMS)), 6).alias("likeness"))


@query("detections", sql="select row_id, last_value(crowd_id ignore nulls) over (partition by track_id order by frame_id, row_id rows between unbounded preceding and 1 preceding) before, count(*) over (partition by track_id order by frame_id, row_id) so_far from detections")
def previous_crowd(d):
    w = W.partitionBy("track_id").orderBy("frame_id", "row_id")
    return d.select("row_id", F.last("crowd_id", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)).alias("before"), F.count("*").over(w).alias("so_far"))


@query("telemetry", sql=f"select seq, round(coalesce(latitude - lag(latitude) over w, 0) * 24 * 111320, 4) + 0 vel from telemetry window w as (partition by {_day} order by seq)")
def camera_velocity(t):
    before = F.lag("latitude").over(W.partitionBy("day").orderBy("seq"))
    return t.withColumn("day", _day_of("ts")).select("seq", (F.round(F.coalesce(C("latitude") - before, F.lit(0.0)) * 24 * 111320, 4) + F.lit(0.0)).alias("vel"))


@query("telemetry", sql=", n as (select count(*) - 1 n from telemetry), s as (select i, i * n / 119.0::double p from range(120) r(i), n) select i as sample, round(a.altitude + (b.altitude - a.altitude) * (p - floor(p)), 6) as altitude from s join telemetry a on a.seq = floor(p)::int join telemetry b on b.seq = ceil(p)::int")
def telemetry_interpolate(t):
    """Altitude at 120 even places along the rows, linear between neighbours."""
    n = t.agg((F.count("*") - 1).alias("n"))
    s = n.select("n", F.explode(F.sequence(F.lit(0), F.lit(119))).alias("i")).select(C("i").cast("bigint").alias("sample"), (C("i") * C("n") / F.lit(119.0)).alias("p"))
    lo, hi = (t.select(C("seq").alias(f"{k}_seq"), C("altitude").alias(k)) for k in ("lo", "hi"))
    x = s.join(lo, C("lo_seq") == F.floor("p")).join(hi, C("hi_seq") == F.ceil("p"))
    return x.select("sample", F.round(C("lo") + (C("hi") - C("lo")) * (C("p") - F.floor("p")), 6).alias("altitude"))


@query("detections", sql=", q as (select quantile_cont(confidence, 0.5) cut from detections) select row_id from detections, q where confidence >= cut and confidence > 1e-5")
def confident_points(d):
    return metrics.kept_points(d, "confidence", 50.0).select("row_id")


_rgb = "(frame_id*37 + u*29 + v*11) % 256 r, (frame_id*53 + u*31) % 256 g, (frame_id*71 + v*43) % 256 b"


@query("depth_pixels", sql=f""", x as (select frame_id, u, v, depth, {_rgb}, case when (frame_id + u) % 9 = 0 then 0.5 else depth end z from depth_pixels), q as (select quantile_cont(depth, 0.25) cut from x)
 select frame_id, u, v, r, g, b from x, q where depth >= cut and depth > 1e-5 and r + g + b >= 16 and not (r > 240 and g > 240 and b > 240) and z > 0.6""")
def coloured_points(p):
    """Pixels as points with made-up colours: without the least confident quarter, black and white ground, and what is too near. Depth stands for confidence."""
    x = p.selectExpr("frame_id", "u", "v", "depth", *_rgb.replace("% 256 ", "% 256 as ").split(", "), "case when (frame_id + u) % 9 = 0 then 0.5 else depth end z")
    return metrics.kept_points(x, "depth", 25.0, colours=("r", "g", "b"), z="z", nearest=0.6).select("frame_id", "u", "v", "r", "g", "b")


@query("detections", "telemetry", sql=""", l as (select row_id, epoch_us(ts) + (row_id % 3 - 1) * 864000000000 us from detections), r as (select epoch_us(ts) us, min((altitude, gimbal_yaw)) s from telemetry group by 1),
 k as (select us, s[1] altitude, s[2] yaw, row_number() over (order by us) i, count(*) over () n from r),
 x as (select l.row_id, l.us, least(greatest(coalesce(p.i, 0), 1), (select any_value(n) - 1 from k)) i from l asof left join k p on l.us >= p.us),
 y as (select row_id, a.altitude a0, b.altitude a1, radians(a.yaw) y0, radians(b.yaw) y1, (x.us - a.us) / (b.us - a.us)::double w from x join k a on a.i = x.i join k b on b.i = x.i + 1)
 select row_id, round(a0 + (a1 - a0) * w, 4) altitude, round(degrees(atan2(round(sin(y0) + (sin(y1) - sin(y0)) * w, 9) + 0, round(cos(y0) + (cos(y1) - cos(y0)) * w, 9) + 0)), 3) yaw from y""")
def telemetry_between(d, t):
    """Altitude and yaw at detections' times, a third of them ten days early and a third ten days late."""
    us = lambda c: F.unix_micros(C(c).cast("timestamp"))
    x = asof.interpolated(d.select("row_id", (us("ts") + (C("row_id") % 3 - 1) * 864000000000).alias("us")), t.select(us("ts").alias("us"), "altitude", C("gimbal_yaw").alias("yaw")), "us", "us", ["altitude"], ["yaw"])
    return x.select("row_id", F.round("altitude", 4).alias("altitude"), F.round("yaw", 3).alias("yaw"))


@query("detections")
def crowd_clusters(d: DataFrame):
    return crowds.density_clusters(metrics.persons(d))


@query("detections")
def crowd_hulls(d: DataFrame):
    return crowds.hull_areas(metrics.persons(d).filter("crowd_id is not null"))


@query("detections")
def voronoi_density(d: DataFrame):
    return crowds.voronoi_density(metrics.persons(d))
