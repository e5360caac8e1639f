"""Operators over ordered rows of a track, a record or a segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W


def moving_average(d: DataFrame, value: str, key: str, order: list[str], window: int = 5) -> Column:
    """Centred, cut at the ends; the value itself in series shorter than the window."""
    by = W.partitionBy(key).orderBy(*order)
    n = F.count("*").over(W.partitionBy(key))
    return F.when(n < window, F.col(value)).otherwise(F.avg(value).over(by.rowsBetween(-(window // 2), window // 2)))


def central_difference(value: str, key: str, frame: str, order: list[str], fps: float) -> Column:
    """(next - previous) / time between, one-sided at the ends, 0 without a neighbour or without time between."""
    by = W.partitionBy(key).orderBy(*order)
    v1, v0 = F.coalesce(F.lead(value).over(by), F.col(value)), F.coalesce(F.lag(value).over(by), F.col(value))
    f1, f0 = F.coalesce(F.lead(frame).over(by), F.col(frame)), F.coalesce(F.lag(frame).over(by), F.col(frame))
    return F.when(f1 == f0, F.lit(0.0)).otherwise((v1 - v0) * fps / (f1 - f0))


def frame_gap(key: str, frame: str, order: list[str]) -> Column:
    return F.col(frame) - F.lag(frame).over(W.partitionBy(key).orderBy(*order))


def run_id(value: str, key: str, order: list[str]) -> Column:
    """1, 2, ... for maximal runs of a constant value, null being a value."""
    by = W.partitionBy(key).orderBy(*order)
    changed = ~F.col(value).eqNullSafe(F.lag(value).over(by)) | (F.row_number().over(by) == 1)
    return F.when(changed, 1).otherwise(0)


def with_runs(d: DataFrame, value: str, key: str, order: list[str]) -> DataFrame:
    by = W.partitionBy(key).orderBy(*order)
    return d.withColumn("_new", run_id(value, key, order)).withColumn("run", F.sum("_new").over(by).cast("bigint")).drop("_new")


def mode_filter(d: DataFrame, value: str, key: str, order: list[str], half: int = 7, segment: str | None = None) -> DataFrame:
    """The most frequent non-null value among `half` rows either way, within stretches of a constant `segment`; the row's own if it is among the most frequent, else the one that appears first. A null gets the mode, too, and stays null where all around are."""
    keys = [key]
    if segment:
        d, keys = with_runs(d, segment, key, order), [key, "run"]
    by = W.partitionBy(*keys).orderBy(*order).rowsBetween(-half, half)
    x = d.withColumn("_w", F.collect_list(value).over(by))
    own = lambda c: F.coalesce(c == F.col(value), F.lit(False)).cast("int")
    counts = F.transform(F.array_distinct("_w"), lambda c: F.struct(F.size(F.filter("_w", lambda o: o == c)).alias("n"), own(c).alias("own"), (-F.array_position(F.col("_w"), c)).alias("first"), c.alias("value")))
    return x.withColumn(f"{value}_mode", F.array_max(counts)["value"]).drop("_w", "run" if segment else "_w")


def first_per(d: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return d.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_k = 1").drop("_k")


def compact_ids(d: DataFrame, value: str, order: list[str]) -> DataFrame:
    """value to 1, 2, ... by first appearance. Only one row per id is ordered, in ranges whose counts are added up."""
    from trackweave.sources.readers import indexed

    firsts = d.filter(F.col(value).isNotNull()).groupBy(value).agg(F.min(F.struct(*order)).alias("_at"))
    return indexed(firsts, "_at").select(value, (F.col("i") + 1).cast("bigint").alias("compact_id"))


def concatenated(sets: list[DataFrame], order: str) -> DataFrame:
    """The rows of several sets of equal columns with idx, their number in all, source, their set's number, and sample, their number within it by `order`; all from 0."""
    from functools import reduce

    from trackweave.sources.readers import indexed

    parts, before = [], 0
    for k, d in enumerate(sets):
        parts.append(indexed(d, order).select(*d.columns, (F.col("i") + before).cast("bigint").alias("idx"), F.lit(k).alias("source"), F.col("i").cast("bigint").alias("sample")))
        before += d.count()
    return reduce(DataFrame.unionByName, parts)


def sessions(d: DataFrame, flag: str, key: str, order: str) -> DataFrame:
    """First and last order value and length of the maximal runs in which flag holds."""
    x = with_runs(d, flag, key, [order])
    return x.filter(flag).groupBy(key, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def hopping_segments(spark, frames: int, size: int, overlap: int) -> DataFrame:
    """(segment, frame, local) of overlapping segments; the first that reaches the end is the last."""
    stride = size - overlap
    n = 1 if frames <= size else 1 + -(-(frames - size) // stride)
    s = spark.range(n).withColumnRenamed("id", "segment")
    start = F.col("segment") * stride
    return s.select("segment", F.explode(F.sequence(start, F.least(start + size, F.lit(frames)) - 1)).alias("frame")).withColumn("local", F.col("frame") - F.col("segment") * stride)


def relative_to_first(value: str, key: str, order: str) -> Column:
    return F.col(value) - F.first(value).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0))


def numbered_within(d: DataFrame, key: str, order: list[str]) -> DataFrame:
    """d with `k`, a row's number from 0 within its key's rows in order: numbers of one sort over ranges, less the key's first, so that no key is one task's work. The order must tell rows apart."""
    from trackweave.sources.readers import indexed

    x = indexed(d.withColumn("_order", F.struct(key, *order)), "_order").drop("_order")
    first = x.groupBy(key).agg(F.min("i").alias("_first"))
    return x.join(first, key).withColumn("k", F.col("i") - F.col("_first")).drop("i", "_first")


def trail(d: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """d with `trail`: the columns of the key's rows up to this one, in order, as an array of structs. What a row carries grows along its key."""
    by = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return d.withColumn("trail", F.collect_list(F.struct(*columns)).over(by))
