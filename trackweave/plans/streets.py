"""Queries of streets, crowds, batches and files: clusters by street, stable numbers, sets of polygons, lookups, orders, and round trips through files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from trackweave.operators import crowds, joins, metrics, overlay, states, windows
from trackweave.plans.catalog import P, SQL, _placed, _poly, query
from trackweave.sources import keyed, readers, writers
from trackweave.sources.shared import new_folder, settled

C = F.col


def _folder(d: DataFrame, name: str) -> str:
    """A new folder under the one that all executors share."""
    return new_folder(d.sparkSession, name)


@query("detections", sql="select row_id, frame_id, track_id, confidence, class_name, x1, y2 from detections")
def tracks_json(d):
    """Detections written as JSON lines and read back."""
    path = _folder(d, "tracks")
    d.select("frame_id", "track_id", F.array("x1", "y1", "x2", "y2").alias("bbox"), "confidence", "class_name", "row_id").write.json(path)
    back = d.sparkSession.read.schema(f"{readers.TRACK}, row_id bigint").json(path)
    return back.select("row_id", "frame_id", F.coalesce("track_id", "id").alias("track_id"), "confidence", "class_name", C("bbox")[0].alias("x1"), C("bbox")[3].alias("y2"))


@query("telemetry", sql="select seq, round(latitude, 6) latitude, gimbal_pitch, drone_yaw, gimbal_mode, vel_north, epoch_us(date_trunc('second', ts)) us from telemetry where upper(is_video) in ('TRUE', '1')")
def flight_csv(t):
    """Telemetry written as a flight record and read back, without what is outside of videos."""
    path = _folder(t, "flight")
    clock = F.col("ts").cast("timestamp")
    t.select(C("latitude").alias("OSD.latitude"), C("longitude").alias("OSD.longitude"), C("altitude").alias("OSD.height [m]"), C("gimbal_pitch").alias("GIMBAL.pitch"), C("gimbal_yaw").alias("GIMBAL.yaw"), C("gimbal_roll").alias("GIMBAL.roll"), C("drone_yaw").alias("OSD.yaw"), C("gimbal_mode").alias("GIMBAL.mode"), C("is_video").alias("CAMERA.isVideo"), C("vel_north").alias("OSD.xSpeed"), C("seq").alias("time"), F.date_format(clock, "M/d/yyyy").alias("CUSTOM.date [local]"), F.date_format(clock, "h:mm:ss.SSS a").alias("CUSTOM.updateTime [local]")).write.csv(path, header=True)
    back, _ = readers.read_flight(t.sparkSession, path)
    return back.select(C("time").cast("int").alias("seq"), F.round("latitude", 6).alias("latitude"), "gimbal_pitch", "drone_yaw", "gimbal_mode", "vel_north", F.unix_micros(F.date_trunc("second", "timestamp")).alias("us"))


@query("telemetry", sql="select arg_min(latitude, seq) home_lat, arg_min(longitude, seq) home_lon from telemetry where seq % 10 = 3")
def first_home(t):
    """Of records that carry a home now and then, the first."""
    known = C("seq") % 10 == 3
    x = t.select("seq", F.when(known, C("latitude")).cast("string").alias("home_lat"), F.when(known, C("longitude")).cast("string").alias("home_lon"), C("latitude").cast("string").alias("latitude"), C("longitude").cast("string").alias("longitude"))
    return readers._home(x, dict.fromkeys(x.columns)).select("home_lat", "home_lon")


@query("telemetry", sql=", s as (select *, upper(is_video) in ('TRUE', '1', '1.0') v from telemetry), a as (select min(seq) a from s where v), b as (select min(seq) b from s, a where seq > a and not v), o as (select latitude lat0, longitude lon0, altitude alt0 from s, a where seq = a) select seq, round(radians(longitude-lon0)*6371000*cos(radians(lat0)), 5) + 0 east, round(radians(latitude-lat0)*6371000, 5) + 0 north, round(altitude-alt0, 5) + 0 up from s, a, b, o where seq >= a and seq < b")
def first_session_path(t):
    return readers.session_trajectory(t).select("seq", *((F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("east", "north", "up")))


@query("detections", sql="select row_id, printf('{\"track_id\": %d, \"lat\": %.10f, \"alt\": %.2f, \"pos\": [%.6f, %.6f], \"crowd_id\": %s}', track_id, pos_n / 7, confidence, x1 / 3, y1 / 3, coalesce(crowd_id::varchar, 'null')) line from detections")
def state_lines(d):
    x = d.select("row_id", "track_id", (C("pos_n") / 7).alias("lat"), C("confidence").alias("alt"), F.array(C("x1") / 3, C("y1") / 3).alias("pos"), "crowd_id")
    return x.select("row_id", writers.state_json(x.drop("row_id")).alias("line"))


@query("detections", sql="select f frame_id, count(track_id) filter (where class_name = 'person') persons, sum(round(pos_n / 7, 7)) filter (where class_name = 'person') total from range(0, (select max(frame_id) + 1 from detections)) r(f) left join detections on frame_id = f group by f")
def frames_json(d):
    """Frames written packed, every one from 0 to the last, and read back."""
    path = _folder(d, "frames")
    lit = lambda t: F.lit(None).cast(t)
    s = d.filter("class_name = 'person'").select("class_name", "frame_id", "track_id", "row_id", (C("pos_n") / 7).alias("lat"), C("pos_e").alias("lon"), lit("double").alias("alt"), lit("double").alias("heading_deg"), lit("double").alias("speed_mph"), "crowd_id", lit("double").alias("crowd_density"), lit("double").alias("vn"), lit("double").alias("ve"), lit("int").alias("street_index"))
    writers.write_frames(s, {"fps": "24"}, path)
    back = d.sparkSession.read.schema("frame_id bigint, persons array<struct<tid:bigint,lat:double>>").json(f"{path}/frames")
    return back.select("frame_id", F.size("persons").cast("bigint").alias("persons"), F.aggregate("persons", F.lit(None).cast("double"), lambda a, p: F.coalesce(a, F.lit(0.0)) + p.lat).alias("total")).withColumn("total", F.round("total", 5))


SQL["frames_json"] = SQL["frames_json"].replace("sum(round(pos_n / 7, 7)) filter (where class_name = 'person') total", "round(sum(round(pos_n / 7, 7)) filter (where class_name = 'person'), 5) total")


@query("detections", sql="select track_id, count(*) n from detections where video_id in (0, 1) and not (video_id = 0) group by track_id")
def pending_videos(d):
    """Rows of the videos that are there and not done."""
    v = d.select("video_id").distinct()
    left = writers.pending(v, v.filter("video_id = 0"), v.filter("video_id < 2"))
    return d.join(left, "video_id", "left_semi").groupBy("track_id").agg(F.count("*").alias("n"))


@query("detections", sql="select video_id, count(*) n, sum(case when video_id = 1 then confidence + 1 else confidence end) total from detections group by video_id")
def batch_replace(d):
    """A batch of three videos, of which one is written again."""
    path = _folder(d, "batch")
    x = d.select("video_id", "row_id", "confidence")
    writers.write_batch(x, path)
    writers.write_batch(x.filter("video_id = 1").withColumn("confidence", C("confidence") + 1), path)
    return d.sparkSession.read.parquet(path).groupBy("video_id").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 6).alias("total"))


SQL["batch_replace"] = SQL["batch_replace"].replace("sum(case when video_id = 1 then confidence + 1 else confidence end)", "round(sum(case when video_id = 1 then confidence + 1 else confidence end), 6)")


@query("detections", sql="select row_id, first_frame from (select row_id, min(frame_id) over (partition by track_id) first_frame from detections)")
def first_detection(d):
    return d.select("row_id", F.min("frame_id").over(W.partitionBy("track_id")).alias("first_frame"))


@query("detections", sql="select row_id, frame_id, track_id from (select *, row_number() over (partition by frame_id, track_id order by row_id desc) k from detections where class_name = 'person') where k = 1 and frame_id = 7 and track_id = 11")
def point_lookup(d):
    return readers.lookup(d, 7, 11).select("row_id", "frame_id", "track_id")


@query("detections", "polygon_vertices", sql=_poly + ", k as (select track_id, place, count(*) n from placed group by all), r as (select track_id, max(n) / sum(n) share from k group by 1) select track_id, round(share, 6) as share from r where share < 0.8 order by round(share, 6), track_id limit 15")
def worst_residents(d, v):
    """The 15 tracks whose main place holds least of them."""
    r = metrics.residency(_placed(d, v))
    return r.filter("cross").select("track_id", "share").orderBy("share", "track_id").limit(15)


@query("detections", sql="select row_id from detections where video_id in (select distinct video_id from detections order by 1 limit 2)")
def first_videos(d):
    return d.join(d.select("video_id").distinct().orderBy("video_id").limit(2), "video_id", "left_semi").select("row_id")


@query("polygon_vertices", sql=", m as (select * from (values ('FRANCE', 'Wood Street'), ('ASIA', 'Quay')) v(a, b)) select distinct coalesce(b, name) as name from polygon_vertices left join m on a = name")
def renamed_places(v):
    names = v.sparkSession.createDataFrame([("FRANCE", "Wood Street"), ("ASIA", "Quay")], "name string, own string")
    return v.select("name").distinct().join(F.broadcast(names), "name", "left").select(F.coalesce("own", "name").alias("name"))


@query("polygon_vertices", sql="select name, count(*) n, 'own' as source from polygon_vertices where n < 8 group by name union all select name, count(*), 'map' from polygon_vertices where name not in (select name from polygon_vertices where n < 8) group by name")
def united_polygons(v):
    """Own polygons and those of the map whose names don't collide."""
    own = v.filter("n < 8")
    rest = v.join(own.select("name").distinct(), "name", "left_anti")
    count = lambda x, s: x.groupBy("name").agg(F.count("*").alias("n")).withColumn("source", F.lit(s))
    return count(own, "own").unionByName(count(rest, "map"))


@query("detections", "graph_edges", sql=f", p as {P}, s as (select src, dst, x1, y1, x2, y2, (x2-x1)*(x2-x1)+(y2-y1)*(y2-y1) l from graph_edges where src < dst), t as (select row_id, greatest(0, least(1, ((pos_n-x1)*(x2-x1)+(pos_e-y1)*(y2-y1))/l)) t, s.*, pos_n, pos_e from (select row_id, pos_n, pos_e from p) p, s) select row_id, bool_or((pos_n-x1-t*(x2-x1))*(pos_n-x1-t*(x2-x1))+(pos_e-y1-t*(y2-y1))*(pos_e-y1-t*(y2-y1)) <= 2.25 + 1e-9) near from t group by row_id")
def within_buffer(d, g):
    """Whether a person is within 1.5 m of any street's line; lines and people meet in grid cells that the widened lines cover."""
    s = g.filter("src < dst")
    return joins.near_lines(metrics.persons(d), "row_id", "pos_n", "pos_e", s, ("x1", "y1", "x2", "y2"), 1.5).select("row_id", "near")


@query("detections", "telemetry", sql="select row_number() over (order by source, id) - 1 as idx, source, k as sample, id from (select 0 source, row_number() over (order by row_id) - 1 k, row_id::bigint id from detections union all select 1, row_number() over (order by seq) - 1, seq from telemetry)")
def joined_datasets(d, t):
    """Two sets under one numbering: each row's number in all, its set, and its number there."""
    return windows.concatenated([d.select(C("row_id").cast("bigint").alias("id")), t.select(C("seq").cast("bigint").alias("id"))], "id")


@query("detections", sql=f", p as {P}, n as (select a.row_id, count(*) - 1 density from p a join p b on a.video_id = b.video_id and a.frame_id = b.frame_id and (a.pos_n-b.pos_n)*(a.pos_n-b.pos_n)+(a.pos_e-b.pos_e)*(a.pos_e-b.pos_e) <= 100 + 1e-9 group by a.row_id) select round(greatest(quantile_cont(density, 0.99), 0.1), 6) cap from n")
def density_cap(d):
    return metrics.density_cap(joins.radius_neighbours(metrics.persons(d), ["video_id", "frame_id"], "pos_n", "pos_e", "row_id"), "density")


@query("detections", sql=f", p as {P}, n as (select a.row_id, count(*) - 1 density from p a join p b on a.video_id = b.video_id and a.frame_id = b.frame_id and (a.pos_n-b.pos_n)*(a.pos_n-b.pos_n)+(a.pos_e-b.pos_e)*(a.pos_e-b.pos_e) <= 100 + 1e-9 group by a.row_id) select round(greatest((select density from (select density, row_number() over (order by density) - 1 k, count(*) over () c from n) where k = floor(0.99 * (c - 1))), 0.1), 6) cap")
def density_cap_lower(d):
    """The value at the lower rank, as a viewer takes it."""
    return metrics.density_cap(joins.radius_neighbours(metrics.persons(d), ["video_id", "frame_id"], "pos_n", "pos_e", "row_id"), "density", lower=True)


@query("telemetry", sql=", m as (select min(longitude*20037508.34/180) x0, max(longitude*20037508.34/180) x1, min(ln(tan((90+latitude)*pi()/360))/(pi()/180)*20037508.34/180) y0, max(ln(tan((90+latitude)*pi()/360))/(pi()/180)*20037508.34/180) y1 from telemetry), s as (select *, greatest(x1-x0, y1-y0) * 1.2 / 2 h from m) select round((x0+x1)/2-h, 3) west, round((x0+x1)/2+h, 3) east, round((y0+y1)/2-h, 3) south, round((y0+y1)/2+h, 3) north from s")
def square_bounds(t):
    """Bounds with a tenth more on each side, as wide as high."""
    from trackweave.functions import geo

    x, y = geo.mercator(C("latitude"), C("longitude"))
    m = t.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    h = F.greatest(C("x1") - C("x0"), C("y1") - C("y0")) * 1.2 / 2
    mid = {a: (C(f"{a}0") + C(f"{a}1")) / 2 for a in "xy"}
    return m.select(*(F.round(c, 3).alias(n) for n, c in (("west", mid["x"] - h), ("east", mid["x"] + h), ("south", mid["y"] - h), ("north", mid["y"] + h))))


@query("poses", sql="select frame_id, case when frame_id = 0 then 17 when frame_id = 17 then 0 else frame_id end place from poses")
def swapped_to_front(p):
    """Frame 17 changes places with the first."""
    return p.select("frame_id", F.when(C("frame_id") == 0, 17).when(C("frame_id") == 17, 0).otherwise(C("frame_id")).alias("place"))


@query("detections")
def clusters_by_street(d):
    return crowds.by_street(metrics.persons(d).withColumn("street_index", F.floor(C("pos_n") / 16).cast("int")))


@query("detections")
def parameter_search(d):
    return crowds.search_parameters(metrics.persons(d), [(3, 2), (4, 2), (5, 3)])


@query("detections")
def best_parameters(d):
    """The trial of least cost, the first of equals."""
    t = crowds.search_parameters(metrics.persons(d), [(3, 2), (4, 2)])
    return t.agg(F.min_by(F.struct("trial", "least", "neighbours", "cost"), F.struct("cost", "trial")).alias("b")).select("b.*")


@query("detections")
def stable_crowds(d):
    c = metrics.persons(d).filter("crowd_id is not null").groupBy(C("video_id").alias("street_index"), "frame_id", C("crowd_id").cast("bigint").alias("crowd_id")).agg(F.avg("pos_n").alias("n"), F.avg("pos_e").alias("e"))
    return states.stabilised(c, limit=6.0)


@query("poses")
def farthest_frames(p):
    x = p.withColumn("segment", F.floor(C("frame_id") / 50).cast("int"))
    return states.farthest_order(x, "segment", "frame_id", ["tx", "ty", "tz"])


@query("detections")
def crowd_tracks(d):
    """row_id, crowd of people by place and smoothed velocity: clusters of each frame, matched over frames by both."""
    k = states.kalman_tracks(d.withColumn("pos_d", F.lit(0.0)))
    x = metrics.persons(d).select("video_id", "frame_id", "row_id").join(k, "row_id").select("video_id", "frame_id", "row_id", C("kf_n").alias("n"), C("kf_e").alias("e"), C("kf_vn").alias("vn"), C("kf_ve").alias("ve"))
    x = settled(x)
    found = settled(crowds.density_clusters(x, features=(("n", 1.0), ("e", 1.0), ("vn", 1.5), ("ve", 1.5)), epsilon=0.2))
    names = states.moving_identity(crowds.macro_states(x, found))
    return x.join(found, "row_id").join(names.withColumnRenamed("label", "cluster"), ["video_id", "frame_id", "cluster"], "left").select("row_id", C("identity").alias("crowd"))


_draw = "('0x' || substring(md5(concat_ws('-', 7, frame_id, k)), 1, 8))::bigint"


@query("poses", sql=f", b as (select frame_id, greatest(0, frame_id - 16) low, least((select max(frame_id) + 1 from poses), frame_id + 16) high from poses) select frame_id, k::int k, (case when k = 0 then frame_id else low + {_draw} % (high - low) end)::int picked from b, range(0, 8) r(k)")
def nearby_frames(p):
    """Of each frame, itself and seven drawn with repetition from those less than twice as many frames away."""
    top = p.agg((F.max("frame_id") + 1).alias("total"))
    return joins.nearby(p.select("frame_id").join(F.broadcast(top)), "frame_id", C("total"), 8, seed=7)


@query("detections", "telemetry", sql=f", p as {P}, l as (select frame_id, track_id, max(row_id) row_id from detections where class_name = 'person' group by all), k as (select distinct seq % 40 frame_id, seq % 23 + 1 track_id from telemetry) select frame_id, track_id, row_id, confidence from k join l using (frame_id, track_id) join (select row_id, confidence from detections) using (row_id)")
def indexed_lookups(d, t):
    """Persons written as an indexed table, and those of a table of keys read from it."""
    path = _folder(d, "tracks")
    keyed.tracks_index(d, path)
    wanted = t.select((C("seq") % 40).alias("frame_id"), (C("seq") % 23 + 1).alias("track_id"))
    return keyed.find_all(wanted, path).select("frame_id", "track_id", "row_id", "confidence")


@query("polygon_vertices", sql=""", g as (select name, length(name) % 3 as shape, min(n) n0, max(n) n1, min(e) e0, max(e) e1 from polygon_vertices group by name having count(distinct n) = 2),
 ns as (select shape, n, lead(n) over (partition by shape order by n) n2 from (select shape, n0 n from g union select shape, n1 from g)), es as (select shape, e, lead(e) over (partition by shape order by e) e2 from (select shape, e0 e from g union select shape, e1 from g))
 select shape::int shape, round(sum((n2 - n) * (e2 - e)), 3) area from ns join es using (shape) where n2 is not null and e2 is not null and exists (select 1 from g where g.shape = ns.shape and n0 <= n and n2 <= n1 and e0 <= e and e2 <= e1) group by shape""")
def square_unions(v):
    """Areas of the unions of the square polygons, by the length of their names."""
    squares = v.groupBy("name").agg(F.countDistinct("n").alias("_c")).filter("_c = 2")
    x = v.join(squares, "name").select((F.length("name") % 3).cast("string").alias("name"), F.xxhash64("name", "ring_id").alias("ring_id"), "seq", "n", "e")
    return overlay.union_areas(x).select(C("name").cast("int").alias("shape"), F.round("area", 3).alias("area"))


@query("graph_edges", sql="select cast(y1 as int) as row, round(2 * 1.5 * (greatest(max(x1), max(x2)) - least(min(x1), min(x2))) + 1.5 * 1.5 * 32 * sin(2 * pi() / 64), 3) area from graph_edges where y1 = y2 group by y1")
def buffered_rows(g):
    """Areas within 1.5 m of the graph's rows, each of several edges in both directions."""
    lines = g.filter("y1 = y2").select(C("y1").cast("int").cast("string").alias("name"), C("x1").alias("n"), C("y1").alias("e"), C("x2").alias("n2"), C("y2").alias("e2"), F.lit(1.5).alias("metres"))
    return overlay.union_areas(overlay.buffers(lines)).select(C("name").cast("int").alias("row"), F.round("area", 3).alias("area"))


_dominant = _poly + """, k as (select row_id, track_id, place from placed where place is not null), n as (select track_id, place, count(*) n, min(row_id) f from k group by all),
 t as (select track_id, arg_max(place, (n, -f)) dominant, max(n) n from n group by track_id)"""


@query("detections", "polygon_vertices", sql=_dominant + """ select t.track_id, dominant, round(median(pos_n), 6) median_n, round(median(pos_e), 6) median_e from t join k using (track_id) join (select row_id, pos_n, pos_e from detections) using (row_id)
 where n < 3 or place = dominant group by t.track_id, dominant""")
def dominant_streets(d, v):
    """Each track's main place and where it mostly is there."""
    x = _placed(d, v).join(d.select("row_id", "pos_n", "pos_e"), "row_id")
    m = metrics.dominant_places(x)
    return m.select("track_id", "dominant", F.round("median_n", 6).alias("median_n"), F.round("median_e", 6).alias("median_e"))


@query("detections", "polygon_vertices", sql=_dominant + " select dominant, count(*) n_tracks from t group by dominant order by n_tracks desc, min(track_id) limit 8")
def largest_streets(d, v):
    """The eight places that most tracks have as their main one; of equal ones that of the smaller track first."""
    x = _placed(d, v).join(d.select("row_id", "pos_n", "pos_e"), "row_id")
    g = metrics.dominant_places(x).groupBy("dominant").agg(F.count("*").alias("n_tracks"), F.min("track_id").alias("_first"))
    return g.orderBy(F.desc("n_tracks"), "_first").limit(8).drop("_first")


@query("depth_pixels", sql="select frame_id, round(median(depth), 6) third_depth from depth_pixels where u >= 2 and u < 5 and v >= 2 and v < 5 group by frame_id")
def third_depth(p):
    """The median of each map's middle third."""
    return metrics.centre_depth(p, third=True).withColumnRenamed("centre_depth", "third_depth")
