"""Aggregates over tracks, crowds, positions and depth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from trackweave.functions import geo
from trackweave.operators.quantiles import percentiles
from trackweave.sources.shared import settled


def persons(d: DataFrame) -> DataFrame:
    return d.filter((F.col("class_name") == "person") & (F.col("track_id") != 0))


def crowd_metrics(d: DataFrame) -> DataFrame:
    """One row: switches between consecutive known crowds of a track, share without a crowd (1 if there is nobody), crowds, and the spread of crowds per frame."""
    p = settled(persons(d).select("video_id", "track_id", "frame_id", "row_id", "crowd_id"))
    before = F.lag("crowd_id").over(W.partitionBy("track_id").orderBy("frame_id", "row_id"))
    switches = p.filter("crowd_id is not null").withColumn("_b", before).agg(F.coalesce(F.sum((F.col("_b") != F.col("crowd_id")).cast("int")), F.lit(0)).cast("bigint").alias("switches"))
    share = p.agg(F.coalesce(F.avg(F.col("crowd_id").isNull().cast("double")), F.lit(1.0)).alias("noise_ratio"), F.countDistinct("crowd_id").alias("unique_ids"))
    spread = p.groupBy("video_id", "frame_id").agg(F.countDistinct("crowd_id").alias("_n")).agg(F.coalesce(F.stddev_pop("_n"), F.lit(0.0)).alias("count_std"))
    return switches.crossJoin(share).crossJoin(spread).select("switches", F.round("noise_ratio", 6).alias("noise_ratio"), "unique_ids", F.round("count_std", 6).alias("count_std"))


def composite_cost(m: DataFrame, streets: int = 1) -> DataFrame:
    n = F.greatest(F.col("n"), F.lit(1))
    return m.select(F.round(F.col("switches") / n + 50 * F.col("noise_ratio") + 0.5 * F.col("unique_ids") / streets + 2 * F.col("count_std"), 5).alias("cost"))


def track_medians(d: DataFrame) -> DataFrame:
    return persons(d).groupBy("track_id").agg(F.median("pos_n").alias("median_n"), F.median("pos_e").alias("median_e"), F.min("frame_id").alias("first_frame"), F.count("*").alias("n_rows"))


def counts(d: DataFrame) -> DataFrame:
    return d.agg(F.count("*").alias("n_rows"), F.count_if(F.col("class_name") == "person").alias("n_persons"), F.countDistinct("track_id").alias("n_tracks"), F.count_if(F.col("crowd_id").isNull()).alias("n_unassigned"))


def cluster_states(d: DataFrame) -> DataFrame:
    """Median place and size of each crowd in each frame of a video."""
    return persons(d).filter("crowd_id is not null").groupBy("video_id", "frame_id", "crowd_id").agg(F.median("pos_n").alias("centre_n"), F.median("pos_e").alias("centre_e"), F.count("*").alias("n"))


def zscores(d: DataFrame, columns: tuple[str, ...] = ("pos_n", "pos_e"), least: float = 1e-6) -> DataFrame:
    by = W.partitionBy("video_id", "frame_id")
    return persons(d).select("row_id", *[(F.round((F.col(c) - F.avg(c).over(by)) / F.greatest(F.stddev_pop(c).over(by), F.lit(least)), 6) + F.lit(0.0)).alias(f"z_{c}") for c in columns])


def residency(tracks: DataFrame, place: str = "place") -> DataFrame:
    """Each track's two most frequent places and their shares; cross: the first holds under 80 %."""
    n = tracks.groupBy("track_id", place).agg(F.count("*").alias("n"))
    ranked = n.withColumns({"total": F.sum("n").over(W.partitionBy("track_id")), "k": F.row_number().over(W.partitionBy("track_id").orderBy(F.desc("n"), F.col(place).asc_nulls_last()))})
    pick = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    g = ranked.filter("k <= 2").groupBy("track_id").agg(pick(1, place).alias("first"), pick(1, "n").alias("_a"), pick(2, place).alias("second"), pick(2, "n").alias("_b"), F.max("total").alias("n"))
    return g.select("track_id", "first", F.round(F.col("_a") / F.col("n"), 6).alias("share"), "second", F.round(F.coalesce(F.col("_b"), F.lit(0)) / F.col("n"), 6).alias("second_share"), (F.col("_a") / F.col("n") < 0.8).alias("cross"))


def depth_range(d: DataFrame) -> DataFrame:
    """First and 99th percentile of all finite depths above 0, and their number; null without any."""
    v = d.filter(geo.finite(F.col("depth")) > 0)
    return v.agg(*(F.round(F.lit(x).cast("double"), 6).alias(n) for x, n in zip(percentiles(v, "depth", (0.01, 0.99)), ("p1", "p99"), strict=True)), F.count("*").alias("n"))


def centre_depth(d: DataFrame, third: bool = False) -> DataFrame:
    """frame_id, centre_depth: the median around each map's middle pixel, a twentieth of the shorter side to each side and one pixel at least, or with `third` of the middle third of both sides. A map's sides
    are told by its largest u and v."""
    sizes = d.groupBy("frame_id").agg((F.max("v") + 1).alias("_h"), (F.max("u") + 1).alias("_w"))
    half = F.greatest(F.lit(1), F.floor(F.least("_h", "_w") / 20))
    around = lambda c, size: F.col(c).between(F.floor(F.col(size) / 2) - half, F.floor(F.col(size) / 2) + half)
    middle = lambda c, size: (F.col(c) >= F.floor(F.col(size) / 3)) & (F.col(c) < F.floor(2 * F.floor(F.col(size)) / 3))
    inside = (lambda c, size: middle(c, size)) if third else around
    return d.join(sizes, "frame_id").filter(inside("u", "_w") & inside("v", "_h")).groupBy("frame_id").agg(F.round(F.median("depth"), 6).alias("centre_depth"))


def robust_depth(d: DataFrame) -> DataFrame:
    """Median of the depths up to the 70th percentile of each frame."""
    cut = d.groupBy("frame_id").agg(F.percentile("depth", F.lit(0.7)).alias("_cut"))
    return d.join(cut, "frame_id").filter("depth <= _cut").groupBy("frame_id").agg(F.round(F.median("depth"), 6).alias("robust_depth"))


def density_cap(d: DataFrame, value: str, lower: bool = False) -> DataFrame:
    """99th percentile, 0.1 at least, linear or that of the lower rank; 0.5 if there is no value."""
    (found,) = percentiles(d, value, (0.99,), lower)
    return d.sparkSession.range(1).select(F.round(F.lit(0.5 if found is None else max(found, 0.1)), 6).alias("cap"))


def frame_rate(d: DataFrame) -> DataFrame:
    """(rows - 1) / seconds between the first and the last; 24 if that is undefined."""
    t = d.agg(F.count("*").alias("n"), (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("us"))
    return t.select(F.round(F.when(F.col("us") > 0, (F.col("n") - 1) * 1e6 / F.col("us")).otherwise(24.0), 9).alias("fps"))


def kept_points(d: DataFrame, confidence: str, percent: float, colours: tuple[str, str, str] | None = None, black: bool = True, white: bool = True, z: str | None = None, nearest: float = 0.01) -> DataFrame:
    """Points of a confidence at the table's percentile or above it (0: all) that is over 1e-5; with colours (0 to 255) not nearly black or white; with z finite and farther than `nearest`."""
    (cut,) = percentiles(d, confidence, (percent / 100,)) if percent else (0.0,)
    keep = (F.col(confidence) >= F.lit(cut).cast("double")) & (F.col(confidence) > 1e-5)
    if colours:
        r, g, b = (F.col(c) for c in colours)
        keep = keep & (r + g + b >= 16 if black else F.lit(True)) & (~((r > 240) & (g > 240) & (b > 240)) if white else F.lit(True))
    return d.filter(keep & (geo.finite(F.col(z)) > nearest if z else F.lit(True)))


def sample_errors(estimate: DataFrame, truth: DataFrame, key: str, axes: Sequence[str]) -> DataFrame:
    """key and, by axis, estimate less truth of the samples that both have."""
    t = truth.select(key, *(F.col(a).alias(f"_{a}") for a in axes))
    return estimate.join(t, key).select(key, *((F.col(a) - F.col(f"_{a}")).alias(a) for a in axes))


def rms(errors: DataFrame, axes: Sequence[str], place: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """rms_ of each axis, nulls and NaN left out, and rms_3d of those of the place together; null without samples."""
    square = {a: F.avg(F.when(~F.isnan(a), F.col(a) * F.col(a))) for a in axes}
    return errors.agg(*(F.sqrt(square[a]).alias(f"rms_{a}") for a in axes), F.sqrt(square[place[0]] + square[place[1]] + square[place[2]]).alias("rms_3d"))


def dominant_places(tracks: DataFrame, place: str = "place", order: str = "row_id") -> DataFrame:
    """track_id, dominant, median_n, median_e: each track's most frequent place (the one seen first of equal ones), and its median position there, or of all its rows if the place has fewer than three. Rows
    of tracks (track_id, place, order, pos_n, pos_e) without a place take no part."""
    t = tracks.filter(F.col(place).isNotNull())
    n = t.groupBy("track_id", place).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    top = n.groupBy("track_id").agg(F.max_by(F.struct(F.col(place).alias("place"), "n"), F.struct("n", -F.col("_first"))).alias("_top"))
    j = t.join(top, "track_id")
    counts = (F.col(place) == F.col("_top.place")) | (F.col("_top.n") < 3)
    return j.filter(counts).groupBy("track_id").agg(F.first("_top.place").alias("dominant"), F.median("pos_n").alias("median_n"), F.median("pos_e").alias("median_e"))


def remapped_frames(d: DataFrame, frame: str, frames: int, ratio: float | None = None) -> DataFrame:
    """d with `frame` divided by the ratio, rounded half to even, within 0 and frames - 1. Without a ratio it is found: if the largest frame is beyond, so that it fits, else 1."""
    if ratio is None:
        most = d.agg(F.max(frame)).first()[0]
        ratio = (most + 1) / frames if most is not None and most >= frames else 1.0
    at = F.bround(F.col(frame) / F.lit(float(ratio))) if ratio != 1 else F.col(frame)
    return d.withColumn(frame, F.greatest(F.lit(0), F.least(at, F.lit(frames - 1))).cast("bigint"))


def bounds(d: DataFrame, lat: str, lon: str, margin: float) -> DataFrame:
    """One row, south, north, west, east: the extent of all places and a margin; an error without any."""
    held = d.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    out = held.agg(F.count("*").alias("_n"), (F.min(lat) - margin).alias("south"), (F.max(lat) + margin).alias("north"), (F.min(lon) - margin).alias("west"), (F.max(lon) + margin).alias("east"))
    checked = F.when(F.col("_n") == 0, F.raise_error(F.lit("no places to bound")).cast("double")).otherwise(F.col("south"))
    return out.select(checked.alias("south"), "north", "west", "east")
