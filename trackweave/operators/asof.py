"""As-of joins that give both neighbours in time, and what is interpolated between them.

Both sides lie together in partitions by ranges of time, which Spark draws from a sample so that they are about equal, however the times are spread; rows of one time are dealt by a hash as
well. Within a partition a window carries the last and the next sample; what a partition lacks comes from a table of one row a partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from trackweave.sources.shared import settled


def neighbours(left: DataFrame, right: DataFrame, left_time: str, right_time: str, values: list[str], first: str | None = None) -> DataFrame:
    """left with _before and _after, structs of t and `values`: right's last sample up to the row's time, and its first one after it; null where there is none, or the row has no time.

    Of right rows of one time that with the smallest `first` counts (by default the smallest values). Right rows without a time take no part. Times are numbers.
    """
    sample = F.struct(F.col(right_time).alias("t"), *values)
    r = right.filter(F.col(right_time).isNotNull()).groupBy(F.col(right_time).alias("_t")).agg(F.min_by(sample, first or F.struct(*values)).alias("_r"))
    row = F.struct(*(F.col(c) for c in left.columns))
    l = left.select(F.col(left_time).alias("_t"), row.alias("_row"), F.lit(1).alias("_side"), F.xxhash64(*left.columns).alias("_salt"))
    both = l.withColumn("_r", F.lit(None).cast(r.schema["_r"].dataType)).unionByName(r.select("_t", F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), F.lit(0).alias("_side"), F.lit(0).cast("bigint").alias("_salt"), "_r"))
    x = settled(both.repartitionByRange("_t", "_side", "_salt").withColumn("_part", F.spark_partition_id()))
    ahead = W.partitionBy("_part").orderBy("_t", "_side", "_salt").rowsBetween(W.unboundedPreceding, 0)
    back = W.partitionBy("_part").orderBy(F.desc("_t"), F.desc("_side"), F.desc("_salt")).rowsBetween(W.unboundedPreceding, 0)
    ends = x.filter("_side = 0").groupBy("_part").agg(F.min_by("_r", "_t").alias("_first"), F.max_by("_r", "_t").alias("_last"))
    order = W.orderBy("_part")  # a row a partition
    parts = x.select("_part").distinct().join(ends, "_part", "left").select(
        "_part", F.last("_last", True).over(order.rowsBetween(W.unboundedPreceding, -1)).alias("_earlier"), F.last("_first", True).over(W.orderBy(F.desc("_part")).rowsBetween(W.unboundedPreceding, -1)).alias("_later"))
    y = x.withColumns({"_b": F.last("_r", True).over(ahead), "_a": F.last("_r", True).over(back)}).filter("_side = 1").join(F.broadcast(parts), "_part")
    timed = lambda c: F.when(F.col("_t").isNotNull(), c)
    return y.select("_row.*", timed(F.coalesce("_b", "_earlier")).alias("_before"), timed(F.coalesce("_a", "_later")).alias("_after"))


def interpolated(left: DataFrame, right: DataFrame, left_time: str, right_time: str, linear: list[str], circular: list[str] = (), extrapolate: bool = True) -> DataFrame:
    """left with right's columns at the row's time: linear ones on the line through both neighbours, circular ones (degrees) by their sine and cosine, within -180 and 180.

    Before the first and after the last sample the line through the two nearest ones goes on, or without `extrapolate` the nearest one holds. With a single sample it is that; with none, or a row without a
    time, null. A null in either neighbour gives null. Samples of one time count as one, that of the smallest values.
    """
    values = [*linear, *circular]
    near = neighbours(left, right, left_time, right_time, values)
    one = right.filter(F.col(right_time).isNotNull()).groupBy(F.col(right_time).alias("t")).agg(F.min(F.struct(*values)).alias("_v")).select(F.struct("t", "_v.*").alias("_r"), "t")
    pair = lambda order: F.broadcast(one.orderBy(order).limit(2).agg(F.sort_array(F.collect_list("_r")).alias("_p")))
    near = near.crossJoin(pair(F.asc("t")).withColumnRenamed("_p", "_start")).crossJoin(pair(F.desc("t")).withColumnRenamed("_p", "_end"))
    start, end = (F.when(F.size(c) > 1, F.struct(F.col(c)[0].alias("a"), F.col(c)[1].alias("b"))) for c in ("_start", "_end"))
    there = F.when(F.col("_before").isNotNull() & F.col("_after").isNotNull(), F.struct(F.col("_before").alias("a"), F.col("_after").alias("b")))
    beyond = F.when(F.col("_before").isNotNull(), end).when(F.col("_after").isNotNull(), start)
    single = F.coalesce("_before", "_after")
    x = near.withColumn("_ab", F.coalesce(there, beyond, F.when(single.isNotNull(), F.struct(single.alias("a"), single.alias("b")))))
    width = F.col("_ab.b.t") - F.col("_ab.a.t")
    share = F.when(width > 0, (F.col(left_time) - F.col("_ab.a.t")) / width).otherwise(0.0)
    x = x.withColumn("_w", share if extrapolate else F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))
    line = lambda f: f("_ab.a") + (f("_ab.b") - f("_ab.a")) * F.col("_w")

    def turned(c: str) -> Column:
        sine, cosine = (F.round(line(lambda s, g=g: g(F.radians(F.col(f"{s}.{c}")))), 9) + F.lit(0.0) for g in (F.sin, F.cos))
        return F.degrees(F.atan2(sine, cosine))

    return x.select(*left.columns, *(line(lambda s, c=c: F.col(f"{s}.{c}").cast("double")).alias(c) for c in linear), *(turned(c).alias(c) for c in circular))


def nearest(left: DataFrame, right: DataFrame, left_time: str, right_time: str, right_id: str) -> DataFrame:
    """left, right_id and dt_us: right's row of the least distance in time, the earlier one on a tie, of equal times that with the smallest id; null where right has no row, or the row has no time."""
    x = neighbours(left, right, left_time, right_time, [right_id], right_id)
    t, b, a = F.col(left_time), F.col("_before"), F.col("_after")
    near = F.when(b.isNull(), a).when(a.isNull() | (t - b.t <= a.t - t), b).otherwise(a)
    return x.withColumn("_m", near).select(*left.columns, F.col(f"_m.{right_id}").alias(right_id), F.abs(F.col("_m.t") - t).alias("dt_us"))
