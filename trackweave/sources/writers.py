"""Writers of states, frames, metadata, paths and batches. A table and its metadata are two jobs, and Spark moves a job's files one by one at its end; where a reader must not see half of them, use files.OneObject, keyed or ledger.Batch."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

#: Decimal places of a state's fields; other numbers have six.
PLACES = {"lat": 10, "lon": 10, "alt": 2, "depth_m": 4, "speed_mph": 4, "heading_deg": 2}


def state_json(d: DataFrame) -> Column:
    """A row as a JSON object in the order of its columns, numbers with the decimal places of their fields, nulls, NaN and infinities as null."""
    parts = []
    for name, kind in d.dtypes:
        c, places = F.col(name), PLACES.get(name, 6)
        number = lambda x, p=6: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), "null").otherwise(F.format_string(f"%.{p}f", x))
        if kind in ("double", "float"):
            text = number(c.cast("double"), places)
        elif kind in ("array<double>", "array<float>"):
            text = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: number(x.cast("double"))), ", "), F.lit("]"))
        elif kind in ("tinyint", "smallint", "int", "bigint", "boolean"):
            text = c.cast("string")
        else:
            whole = F.to_json(F.struct(c.alias("v")))
            text = F.substring(whole, F.lit(len('{"v":') + 1), F.length(whole) - len('{"v":}'))
        parts.append(F.concat(F.lit(f'"{name}": '), F.when(c.isNull(), "null").otherwise(text)))
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def write_states(d: DataFrame, path: str) -> None:
    """A state a line, by frame and track within each file."""
    ordered = d.repartitionByRange("frame_id", "track_id").sortWithinPartitions("frame_id", "track_id")
    ordered.select(state_json(ordered).alias("value")).write.text(path)


def write_with_metadata(d: DataFrame, metadata: Mapping[str, str], path: str) -> None:
    """The rows under path/tracks, and one object of metadata under path/metadata."""
    d.write.parquet(f"{path}/tracks")
    d.sparkSession.range(1).select(*(F.lit(v).alias(k) for k, v in metadata.items())).coalesce(1).write.json(f"{path}/metadata")


def frame_buckets(d: DataFrame, places: int = 7) -> DataFrame:
    """frame_id, uav, persons of every frame from 0 to the last: states (class_name, frame_id, track_id, row_id, lat, lon, alt, heading_deg, speed_mph, crowd_id, crowd_density, vn, ve, street_index) in nested rows, persons in order of row_id, rounded; what isn't finite is null."""
    r = lambda c, n: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.round(c, n)).alias(c)
    uav = F.struct(r("lat", places), r("lon", places), r("alt", 2), F.round("heading_deg", 1).alias("heading"), r("speed_mph", 1))
    person = F.struct("row_id", F.struct(F.col("track_id").alias("tid"), r("lat", places), r("lon", places), F.col("crowd_id").alias("cid"), F.round("crowd_density", 4).alias("cd"), F.coalesce(F.round("vn", 3), F.lit(0.0)).alias("vn"), F.coalesce(F.round("ve", 3), F.lit(0.0)).alias("ve"), F.col("street_index").alias("si")).alias("p"))
    is_uav = F.col("class_name") == "UAV"
    g = d.filter("frame_id is not null").groupBy("frame_id").agg(F.max_by(F.when(is_uav, uav), F.when(is_uav, F.col("row_id"))).alias("uav"), F.sort_array(F.collect_list(F.when(~is_uav, person))).alias("_p"))
    top = d.agg(F.max("frame_id").alias("m")).filter("m is not null").select(F.explode(F.sequence(F.lit(0), F.col("m"))).alias("frame_id"))
    return top.join(g, "frame_id", "left").select("frame_id", "uav", F.coalesce(F.transform("_p", lambda x: x.p), F.array()).alias("persons"))


def write_frames(d: DataFrame, metadata: Mapping[str, str], path: str) -> None:
    """Frames as packed JSON lines in order, and their metadata."""
    f = frame_buckets(d).repartitionByRange("frame_id").sortWithinPartitions("frame_id")
    f.write.json(f"{path}/frames", compression="gzip")
    d.sparkSession.range(1).select(*(F.lit(v).alias(k) for k, v in metadata.items())).coalesce(1).write.json(f"{path}/metadata")


def line(places: Column) -> Column:
    """An array of places (lon, lat) as a GeoJSON line; a single place is none."""
    shape = F.struct(F.lit("LineString").alias("type"), F.transform(places, lambda p: F.array(p.lon, p.lat)).alias("coordinates"))
    return F.when(F.size(places) > 1, F.to_json(shape))


def line_string(hops: DataFrame, key: str) -> DataFrame:
    """key, geojson: a line through the places (hop, lon, lat) in order; a single place is no line and has none."""
    g = hops.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("hop", "lon", "lat"))).alias("_h"))
    return g.select(key, line(F.col("_h")).alias("geojson"))


def write_depth(maps: DataFrame, path: str) -> None:
    maps.write.parquet(path)


def pending(videos: DataFrame, done: DataFrame, available: DataFrame) -> DataFrame:
    """Videos that are there and not done yet."""
    return videos.join(available.select("video_id"), "video_id", "left_semi").join(done.select("video_id"), "video_id", "left_anti")


def write_batch(d: DataFrame, path: str) -> None:
    """Replaces the videos that d has, by folders; other videos stay. A job that is stopped before its end leaves all as it was; its end moves folder by folder. ledger.Batch replaces whole parts at once."""
    d.repartition("video_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("video_id").parquet(path)
