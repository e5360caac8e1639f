"""Readers of flight records, tracks, poses, depth maps, polygons, graphs and pasted ids. Schemas are explicit; rows that have an order in their file get a row_id."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W

TRACK = "frame_id int, track_id bigint, id bigint, bbox array<double>, confidence double, class_name string"


def _texts(spark: SparkSession, path: str) -> DataFrame:
    """A row per file: path and value, its whole text. A JSON array can't be cut, so a file is one task's work; large data belongs in many files or in lines."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def read_tracks(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """row_id, frame_id, track_id (or else id), bbox, confidence, class_name of files whose root is a list of rows or {"tracks": [rows]}; with lines, of files with a row a line.

    row_id is the place in the file, and with lines any growing number. Any other root is an error. An empty list has no rows.
    """
    if lines:
        return spark.read.schema(TRACK).json(path).select(F.monotonically_increasing_id().alias("row_id"), "frame_id", F.coalesce("track_id", "id").alias("track_id"), "bbox", "confidence", "class_name")
    listed = F.when(F.col("value").rlike(r"^\s*\["), F.from_json("value", f"array<struct<{_fields(TRACK)}>>"))
    held = F.when(F.col("value").rlike(r"^\s*\{"), F.from_json("value", f"tracks array<struct<{_fields(TRACK)}>>")["tracks"])
    rows = F.coalesce(listed, held, F.raise_error(F.lit("a list of rows or an object with tracks is needed")).cast(f"array<struct<{_fields(TRACK)}>>"))
    x = _texts(spark, path).select(F.posexplode(rows).alias("row_id", "r"))
    return x.select(F.col("row_id").cast("bigint").alias("row_id"), "r.frame_id", F.coalesce("r.track_id", "r.id").alias("track_id"), "r.bbox", "r.confidence", "r.class_name")


def _fields(ddl: str) -> str:
    return ", ".join(f"{f.split()[0]}:{f.split()[1]}" for f in ddl.split(", "))


#: Names that a flight record's columns go by, a unit in brackets behind them allowed, and which of them must be there.
FLIGHT = {
    "latitude": ("OSD.latitude",), "longitude": ("OSD.longitude",), "altitude": ("OSD.height", "OSD.altitude"), "gimbal_pitch": ("GIMBAL.pitch",), "gimbal_yaw": ("GIMBAL.yaw",), "gimbal_roll": ("GIMBAL.roll",),
    "drone_yaw": ("OSD.yaw",), "drone_roll": ("OSD.roll",), "drone_pitch": ("OSD.pitch",), "gimbal_mode": ("GIMBAL.mode",), "is_video": ("CAMERA.isVideo", "isVideo"), "time": ("OSD.flyTime", "time", "Time", "timestamp"),
    "home_lat": ("HOME.latitude",), "home_lon": ("HOME.longitude",), "home_height": ("HOME.height",), "vel_north": ("OSD.xSpeed",), "vel_east": ("OSD.ySpeed",), "vel_down": ("OSD.zSpeed",), "date": ("CUSTOM.date",), "clock": ("CUSTOM.updateTime",),
}
NEEDED = ("latitude", "longitude", "altitude", "gimbal_pitch", "gimbal_yaw", "gimbal_roll")
FILLED = ("gimbal_pitch", "gimbal_yaw", "gimbal_roll", "drone_yaw", "drone_roll", "drone_pitch", "vel_north", "vel_east", "vel_down")


def resolved(columns: list[str]) -> dict[str, str]:
    """The columns of a record by what they mean: a name as it is goes before one with a unit, earlier names before later ones."""
    out = {}
    for meaning, names in FLIGHT.items():
        found = next((n for n in names if n in columns), None) or next((c for n in names for c in columns if c.startswith(f"{n} [")), None)
        if found:
            out[meaning] = found
    if missing := [m for m in NEEDED if m not in out]:
        raise ValueError(f"columns of a flight record are missing: {missing}")
    return out


def duration(text: Column) -> Column:
    """Seconds of a number or of a text like 9m 15.0s; else null."""
    minutes, seconds = (F.regexp_extract(text, r"^(\d+)m\s*([\d.]+)s", i) for i in (1, 2))
    return F.coalesce(text.try_cast("double"), minutes.try_cast("double") * 60 + seconds.try_cast("double"))


def _record(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    raw = spark.read.csv(path, header=True)
    at = resolved(raw.columns)
    return raw.select(F.monotonically_increasing_id().alias("seq"), *(F.col(f"`{c}`").alias(m) for m, c in at.items())), at


def _home(raw: DataFrame, at: dict[str, str]) -> DataFrame:
    """One row, home_lat, home_lon, home_height: of the first row that has both degrees, else the first place and no height."""
    number = lambda c: F.col(c).try_cast("double") if c in at else F.lit(None).cast("double")
    x = raw.select("seq", number("home_lat").alias("a"), number("home_lon").alias("b"), F.coalesce(number("home_height"), F.lit(0.0)).alias("h"), number("latitude").alias("la"), number("longitude").alias("lo"))
    known = F.min_by(F.struct("a", "b", "h"), F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.col("seq")))
    first = F.min_by(F.struct(F.col("la").alias("a"), F.col("lo").alias("b"), F.lit(0.0).alias("h")), "seq")
    return x.agg(F.coalesce(known, first).alias("o")).select(F.col("o.a").alias("home_lat"), F.col("o.b").alias("home_lon"), F.col("o.h").alias("home_height"))


def read_flight(spark: SparkSession, path: str, zone: str = "UTC", placed: tuple[str, ...] = ("latitude", "longitude", "altitude")) -> tuple[DataFrame, DataFrame]:
    """(telemetry, home) of a flight record in CSV.

    Rows outside of videos (if the record says so) and rows that lack one of `placed` go; what is no number is null, and null angles and speeds are 0, a null mode is 'Follow Yaw'.
    `timestamp` is the record's local date and clock in the zone, each on its own row. Columns that are needed and missing are an error.
    """
    raw, at = _record(spark, path)
    x = raw.filter(F.upper("is_video").isin("TRUE", "1", "1.0")) if "is_video" in at else raw
    number = lambda m: F.col(m).try_cast("double") if m in at else F.lit(None).cast("double")
    stamp = F.lit(None).cast("timestamp")
    if "date" in at and "clock" in at:
        stamp = F.to_utc_timestamp(F.try_to_timestamp(F.concat_ws(" ", "date", F.regexp_replace("clock", r"\.(\d)\b", ".$10")), F.lit("M/d/yyyy h:mm:ss[.SSS][.SS] a")), zone)
    out = x.select(
        "seq", *(number(m).alias(m) for m in ("latitude", "longitude", "altitude")), *(F.coalesce(number(m), F.lit(0.0)).alias(m) for m in FILLED),
        (F.coalesce(F.col("gimbal_mode"), F.lit("Follow Yaw")) if "gimbal_mode" in at else F.lit("Follow Yaw")).alias("gimbal_mode"),
        (duration(F.col("time")) if "time" in at else F.lit(None).cast("double")).alias("time"), stamp.alias("timestamp"))
    return out.dropna(subset=list(placed)) if placed else out, _home(raw, at)


def indexed(d: DataFrame, order: str = "seq") -> DataFrame:
    """d with `i`, the number of a row from 0 in its order: rows are counted within partitions of the order's range, and counts before are added."""
    from trackweave.sources.shared import settled

    x = settled(d.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id()))
    before = x.groupBy("_part").count().withColumn("_before", F.sum("count").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)))  # a row per partition
    n = F.row_number().over(W.partitionBy("_part").orderBy(order))
    return x.withColumn("_n", n).join(F.broadcast(before), "_part").withColumn("i", F.col("_n") - 1 + F.coalesce("_before", F.lit(0))).drop("_part", "_n", "count", "_before")


def read_telemetry(spark: SparkSession, path: str, frames: int, least: float = 0.0, override: float | None = None) -> DataFrame:
    """frame, altitude, pitch, roll, below (horizontal, within least to 90), yaw and timestamp of a video's frames: even places along its rows, linear between neighbours, the time of the row before.

    A missing altitude is the mean. If the gimbal's pitch is zero throughout, it is `override`, or without one the result is empty.
    """
    from trackweave.operators.asof import interpolated
    from trackweave.sources.shared import settled

    t, _ = read_flight(spark, path, placed=())
    t = settled(indexed(t.withColumn("altitude", F.when(~F.isnan("altitude"), F.col("altitude")))))
    known = t.agg(F.max(F.abs("gimbal_pitch")).alias("most"), F.avg("altitude").alias("mean"), F.count("*").alias("n")).first()
    if known["n"] and not known["most"]:
        t = t.withColumn("gimbal_pitch", F.lit(override).cast("double"))
    empty = not known["n"] or (not known["most"] and override is None)
    t = t.select(F.col("i").cast("double").alias("at"), F.coalesce("altitude", F.lit(known["mean"])).alias("altitude"), F.col("gimbal_pitch").alias("pitch"), F.col("gimbal_roll").alias("roll"), F.col("gimbal_yaw").alias("yaw"), F.col("i").alias("row"), "timestamp")
    places = spark.range(0 if empty else frames).select(F.col("id").alias("frame"), (F.col("id") * float((known["n"] or 1) - 1) / max(1, frames - 1)).alias("place"))
    x = interpolated(places, t.drop("row", "timestamp"), "place", "at", ["altitude", "pitch", "roll", "yaw"])
    x = x.join(t.select("row", "timestamp"), F.floor(F.col("place")).cast("bigint") == F.col("row"))
    return x.select("frame", "altitude", "pitch", "roll", F.least(F.greatest(-F.col("pitch"), F.lit(least)), F.lit(90.0)).alias("below"), "yaw", "timestamp")


def session_trajectory(t: DataFrame) -> DataFrame:
    """Of telemetry (seq, is_video, latitude, longitude, altitude, drone_yaw) the first stretch in which video runs: seq and east, north, up and yaw (within 180 degrees) relative to its first row."""
    from trackweave.functions import geo

    flag = geo.truthy(F.col("is_video"))
    start = t.agg(F.min(F.when(flag, F.col("seq"))).alias("_from"))
    x = t.crossJoin(F.broadcast(start)).filter("seq >= _from")
    stop = x.agg(F.min(F.when(~flag, F.col("seq"))).alias("_to"))
    x = x.crossJoin(F.broadcast(stop)).filter("_to is null or seq < _to")
    first = x.agg(F.min_by(F.struct(F.col("latitude").alias("lat0"), F.col("longitude").alias("lon0"), F.col("altitude").alias("alt0"), F.col("drone_yaw").alias("yaw0")), "seq").alias("o")).select("o.*")
    e, n = geo.local_metres(F.col("latitude"), F.col("longitude"), F.col("lat0"), F.col("lon0"))
    return x.crossJoin(F.broadcast(first)).select("seq", e.alias("east"), n.alias("north"), (F.col("altitude") - F.col("alt0")).alias("up"), geo.wrap_180(F.col("drone_yaw") - F.col("yaw0")).alias("yaw"))


def _arrays(spark: SparkSession, path: str, schema: str, rows) -> DataFrame:
    """rows(file path, content) of numpy files; a file is read whole by one task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for where, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                yield from rows(where, content)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


#: Names of a frame's depth map, the first that is there counts; the number has four digits, or in the last two none in front.
DEPTH_NAMES = ("depth_metric_{:04d}.npy", "depth_{:04d}.npy", "frame_{:04d}_depth.npy", "{:04d}.npy", "depth_metric_{}.npy", "depth_{}.npy")


def depth_name(name: str) -> tuple[int, int] | None:
    """Frame and rank of a depth map's file name; None of any other name."""
    import re

    number = re.search(r"(\d+)(?:_depth)?\.npy$", name)
    rank = next((k for k, form in enumerate(DEPTH_NAMES) if number and form.format(int(number[1])) == name), None)
    return None if rank is None else (int(number[1]), rank)


def read_poses(spark: SparkSession, path: str, key: str = "poses") -> DataFrame:
    """frame, r (nine numbers by rows), t of .npz files: the array named key or else camera_poses, extrinsics or the first, of 3x4 or 4x4 matrices. Extrinsics go from world to camera and come back inverted."""
    def rows(_, content):
        with np.load(io.BytesIO(content)) as z:
            name = next((k for k in (key, "camera_poses", "extrinsics") if k in z.files), z.files[0])
            m = np.asarray(z[name], float).reshape(-1, *z[name].shape[-2:])[:, :3, :4]
        r, t = m[:, :, :3], m[:, :, 3]
        if name == "extrinsics":
            r = r.transpose(0, 2, 1)
            t = -(r @ t[:, :, None])[:, :, 0]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(m))), pa.array(r.reshape(-1, 9).tolist(), pa.list_(pa.float64())), pa.array(t.tolist(), pa.list_(pa.float64()))], ["frame", "r", "t"])
    return _arrays(spark, path, "frame long, r array<double>, t array<double>", rows)


def _named(spark: SparkSession, path: str, suffix: str) -> DataFrame | None:
    """path: files of a folder with this ending, listed by one task, so that their number isn't the driver's memory; None if only Spark's readers can open the folder."""
    from pyarrow import fs

    from trackweave.sources.files import opened

    if ":/" not in path and not spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").startswith("file:"):
        return None
    try:
        if opened(path)[0].get_file_info(opened(path)[1]).type != fs.FileType.Directory:
            return None
    except (OSError, pa.ArrowException):
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(path)
        for _ in (b for b in batches if b.num_rows):
            names = [f.base_name for f in system.get_file_info(fs.FileSelector(base)) if f.type == fs.FileType.File and f.base_name.endswith(suffix) and not f.base_name.startswith(("_", "."))]
            for k in range(0, len(names), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array([f"{path.rstrip('/')}/{n}" for n in names[k : k + 10_000]], pa.string())], ["path"])
    return spark.range(1).coalesce(1).mapInArrow(run, "path string")


#: Bytes of maps that a reader's task hands on at a time, beyond a single map.
MAP_BYTES = 4 << 20


def read_depth(spark: SparkSession, path: str) -> DataFrame:
    """frame, h, w, depth (by rows) of one map a frame from .npy files, under any of DEPTH_NAMES, the first of them that a frame has. Files of other names aren't depth maps.

    Names are listed by one task and dealt out by frame, so many small files are neither a task each few nor all of them in the driver; a folder that only Spark's readers know is read by these.
    """
    def table(maps: list[tuple]) -> pa.RecordBatch:
        frame, rank, x = zip(*maps, strict=True)
        depth = pa.ListArray.from_arrays(np.cumsum([0, *(m.size for m in x)], dtype=np.int32), np.concatenate([m.astype(np.float32).ravel() for m in x]))
        return pa.RecordBatch.from_arrays([pa.array(frame, pa.int64()), pa.array(rank, pa.int32()), pa.array([m.shape[0] for m in x], pa.int32()), pa.array([m.shape[1] for m in x], pa.int32()), depth], ["frame", "rank", "h", "w", "depth"])

    schema = "frame long, rank int, h int, w int, depth array<float>"
    files = _named(spark, path, ".npy")
    if files is None:
        def rows(where, content):
            if named := depth_name(where.rsplit("/", 1)[-1]):
                yield table([(*named, np.load(io.BytesIO(content)))])
        x = _arrays(spark, f"{path}/*.npy", schema, rows)
        return x.groupBy("frame").agg(F.min_by(F.struct("h", "w", "depth"), "rank").alias("_m")).select("frame", "_m.*")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(*k, p) for p in b.column(0).to_pylist() if (k := depth_name(p.rsplit("/", 1)[-1]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*found, strict=True) if found else ((), (), ()), (pa.int64(), pa.int32(), pa.string()), strict=True)], ["frame", "rank", "path"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from trackweave.sources.files import opened

        system, base = opened(path)
        held, size = [], 0
        for b in batches:
            for frame, rank, where in zip(*(b.column(c).to_pylist() for c in ("frame", "rank", "path")), strict=True):
                with system.open_input_stream(f"{base.rstrip('/')}/{where.rsplit('/', 1)[-1]}") as f:
                    x = np.load(io.BytesIO(f.read()))
                held.append((frame, rank, x))
                size += x.size * 4
                if size >= MAP_BYTES:
                    yield table(held)
                    held, size = [], 0
        if held:
            yield table(held)

    first = files.mapInArrow(named, "frame long, rank int, path string").groupBy("frame").agg(F.min_by(F.struct("rank", "path"), "rank").alias("_f")).select("frame", "_f.*")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # names are small, what they stand for isn't
    return first.repartition(tasks, "frame").mapInArrow(read, schema).drop("rank")


def depth_pixels(maps: DataFrame) -> DataFrame:
    """frame, v, u, depth of depth maps."""
    x = maps.select("frame", "w", F.posexplode("depth").alias("_i", "depth"))
    return x.select("frame", F.floor(F.col("_i") / F.col("w")).cast("int").alias("v"), (F.col("_i") % F.col("w")).alias("u"), F.col("depth").cast("double").alias("depth"))


def read_intrinsics(spark: SparkSession, path: str) -> DataFrame:
    """frame, fx, fy, cx, cy of a .npy file of 3x3 matrices, or of one, which is frame 0."""
    def rows(_, content):
        k = np.load(io.BytesIO(content)).reshape(-1, 3, 3)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(k))), *(pa.array(k[:, i, j].astype(float)) for i, j in ((0, 0), (1, 1), (0, 2), (1, 2)))], ["frame", "fx", "fy", "cx", "cy"])
    return _arrays(spark, path, "frame long, fx double, fy double, cx double, cy double", rows)


def read_annotations(spark: SparkSession, path: str, least: int) -> DataFrame:
    """seq, idx, filepath, extri, intri of files (packed or not) with an object of frames by sequence; sequences of fewer than `least` frames are left out."""
    frame = "array<struct<filepath:string,extri:array<array<double>>,intri:array<array<double>>>>"
    x = _texts(spark, path).select(F.explode(F.from_json("value", f"map<string,{frame}>")).alias("seq", "_frames")).filter(F.size("_frames") >= least)
    return x.select("seq", F.posexplode("_frames").alias("idx", "_f")).select("seq", "idx", "_f.*")


def read_camera_text(spark: SparkSession, path: str, camera: int) -> DataFrame:
    """Numbers by frame of a text table with blanks between columns and a header, of one camera."""
    x = spark.read.text(path).filter(F.col("value").rlike(r"^\s*\d")).select(F.split(F.trim("value"), r"\s+").alias("_c"))
    return x.filter(F.col("_c")[1].cast("int") == camera).select(F.col("_c")[0].cast("int").alias("frame"), F.transform(F.slice("_c", F.lit(3), F.greatest(F.size("_c") - 2, F.lit(0))), lambda c: c.cast("double")).alias("numbers"))


def read_user_polygons(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rings, buffers) of an object by name. Rings: name, ring_id, seq, node of a list of ids or a list of such lists; buffers: name, way, metres of {from_osm_name, buffer_m}. Empty entries are left out."""
    entries = _texts(spark, path).select(F.explode(F.from_json("value", "map<string,string>")).alias("name", "v")).filter(F.col("v").isNotNull() & ~F.col("v").rlike(r"^\s*(\[\s*\]|\{\s*\}|null)?\s*$"))
    nested = F.when(F.col("v").rlike(r"^\s*\[\s*\["), F.from_json("v", "array<array<bigint>>")).when(F.col("v").rlike(r"^\s*\["), F.array(F.from_json("v", "array<bigint>")))
    rings = entries.filter(nested.isNotNull()).select("name", F.posexplode(F.filter(nested, lambda r: F.size(r) > 0)).alias("ring_id", "_ids")).select("name", "ring_id", F.posexplode("_ids").alias("seq", "node"))
    b = entries.filter(F.col("v").rlike(r"^\s*\{")).select("name", F.from_json("v", "from_osm_name string, buffer_m double").alias("_b"))
    return rings, b.select("name", F.coalesce("_b.from_osm_name", "name").alias("way"), F.col("_b.buffer_m").alias("metres"))


def ring_vertices(rings: DataFrame, nodes: DataFrame, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """(vertices, missing): rings' nodes (node, n, e) in order, rings of fewer than `least` known ones left out; and how many ids of each name are unknown."""
    x = rings.join(nodes, "node", "left")
    known = x.filter("n is not null").withColumn("_k", F.count("*").over(W.partitionBy("name", "ring_id"))).filter(F.col("_k") >= least)
    return known.select("name", "ring_id", "seq", "n", "e"), x.groupBy("name").agg(F.count_if(F.col("n").isNull()).alias("missing"))


def named_polygons(features: DataFrame) -> DataFrame:
    """Features (name, kind, ...) that are polygons and have a name."""
    return features.filter(F.col("kind").isin("Polygon", "MultiPolygon") & (F.trim("name") != ""))


def graph_key(south: float, west: float, north: float, east: float, length: int = 16) -> Column:
    """Name of a cached graph: the start of the digest of its bounds, rounded to four places."""
    text = F.concat_ws(",", *(F.format_string("%.4f", F.round(F.lit(float(x)), 4)) for x in (south, west, north, east)))
    return F.substring(F.sha1(text.cast("binary")), 1, length)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph kept as two tables; edges have their bearing, and their ends' places."""
    nodes, edges = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
    end = lambda k, name: nodes.select(F.col("id").alias(name), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    j = edges.join(end(1, "src"), "src").join(end(2, "dst"), "dst")
    return nodes, j.withColumn("bearing", F.pmod(F.degrees(F.atan2(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))), F.lit(360.0)))


def read_pasted_ids(spark: SparkSession, path: str) -> DataFrame:
    """street, k, node: ids of six digits or more, one on a line, under the last header `# street`; the first of repeated ids counts, and lines before any header don't."""
    lines = _texts(spark, path).select("path", F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    header = F.regexp_extract("text", r"^\s*#\s*(.+?)\s*$", 1)
    by = W.partitionBy("path").orderBy("line")  # a pasted text
    x = lines.withColumn("street", F.last(F.when(header != "", header), True).over(by)).withColumn("node", F.regexp_extract("text", r"^\s*(\d{6,})(?:\s*\(.*\))?\s*$", 1).try_cast("bigint"))
    x = x.filter("street is not null and node is not null").groupBy("street", "node").agg(F.min("line").alias("line"))
    return x.select("street", (F.row_number().over(W.partitionBy("street").orderBy("line")) - 1).alias("k"), "node")


def lookup(tracks: DataFrame, frame_id: int, track_id: int) -> DataFrame:
    """The person's row of a frame and track, the last of several; no row if there is none. The filter reaches the scan."""
    hit = tracks.filter((F.col("frame_id") == frame_id) & (F.col("track_id") == track_id) & (F.col("class_name") == "person"))
    return hit.orderBy(F.desc("row_id")).limit(1)
