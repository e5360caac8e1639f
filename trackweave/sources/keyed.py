"""A stored table with an index on its keys: sorted by key over files with their key ranges in a table beside them, so that a lookup opens one file and reads the pages around one key.

path/rows holds the rows, in files of a range of keys each, in small row groups with the bounds of their columns; path/files has a row a file: its name, its first and last key. A version
is written whole to a folder of its own name; path/versions has a row a version, and the last one is read, so readers see the old table or the new one.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bytes of a row group, and rows of a page: what a lookup reads at least.
GROUP_BYTES, PAGE_ROWS = 1 << 20, 1_000


def newest(d: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row, by `order`, of each key; rows with a null in a key are left out."""
    row = F.struct(*(F.col(c) for c in d.columns))
    return d.dropna(subset=list(keys)).groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.max_by(row, order).alias("_r")).select("_r.*")


def write(d: DataFrame, path: str, keys: Sequence[str], order: str, files: int | None = None) -> None:
    """Writes d as the table's next version: of rows with equal keys the last by `order`. files: how many there are (by default as Spark's shuffles)."""
    spark, version = d.sparkSession, uuid.uuid4().hex
    ranged = newest(d, keys, order)
    ranged = ranged.repartitionByRange(files, *keys) if files else ranged.repartitionByRange(*keys)
    options = {"parquet.block.size": GROUP_BYTES, "parquet.page.row.count.limit": PAGE_ROWS, "parquet.bloom.filter.enabled": "false"}
    ranged.sortWithinPartitions(*keys).write.options(**options).parquet(f"{path}/rows/{version}")
    back = spark.read.parquet(f"{path}/rows/{version}").select(F.col("_metadata.file_path").alias("file"), F.struct(*keys).alias("k"))
    back.groupBy("file").agg(F.min("k").alias("first"), F.max("k").alias("last"), F.count("*").alias("rows")).coalesce(1).write.parquet(f"{path}/files/{version}")
    spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("written")).coalesce(1).write.mode("append").parquet(f"{path}/versions")


def version(spark: SparkSession, path: str) -> str:
    """The last version that was written whole; an error if there is none."""
    return spark.read.parquet(f"{path}/versions").orderBy(F.desc("written"), F.desc("version")).first()["version"]


def read(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the last version."""
    return spark.read.parquet(f"{path}/rows/{version(spark, path)}")


def merge(changes: DataFrame, path: str, keys: Sequence[str], order: str, files: int | None = None) -> None:
    """The next version: the last one's rows and the changes, of equal keys the last by `order`, of equal order the change."""
    held = read(changes.sparkSession, path).withColumn("_new", F.lit(0))
    both = held.unionByName(changes.withColumn("_new", F.lit(1))).withColumn("_order", F.struct(order, "_new"))
    write(newest(both, keys, "_order").drop("_new", "_order"), path, keys, order, files)


def find(spark: SparkSession, path: str, **key) -> DataFrame:
    """The row with this key (all of the index's columns, by name); none if there is none. Of the table one file is opened, and of that the pages that the key may stand in."""
    held = version(spark, path)
    files = spark.read.parquet(f"{path}/files/{held}")
    names = [f.name for f in files.schema["first"].dataType.fields]
    if set(names) != set(key):
        raise ValueError(f"the index is by {names}")
    one: Column = F.struct(*(F.lit(key[n]).cast(f.dataType).alias(n) for n, f in zip(names, files.schema["first"].dataType.fields, strict=True)))
    hit = files.filter((F.col("first") <= one) & (F.col("last") >= one)).select("file").first()  # ranges don't overlap
    rows = spark.read.parquet(hit["file"]) if hit else spark.read.parquet(f"{path}/rows/{held}").limit(0)
    for n in names:
        rows = rows.filter(F.col(n) == F.lit(key[n]))
    return rows


def find_all(wanted: DataFrame, path: str) -> DataFrame:
    """The rows of many keys (a table of the index's columns, each key once or more): only files in whose range a key falls are opened."""
    spark = wanted.sparkSession
    held = version(spark, path)
    files = spark.read.parquet(f"{path}/files/{held}")
    names = [f.name for f in files.schema["first"].dataType.fields]
    keys = wanted.select(*names).distinct()
    span = keys.agg(F.min(F.struct(*names)).alias("a"), F.max(F.struct(*names)).alias("b"))
    near = files.crossJoin(F.broadcast(span)).filter("last >= a and first <= b").select("file")  # a row a file
    opened = [r["file"] for r in near.collect()]
    rows = spark.read.parquet(*opened) if opened else spark.read.parquet(f"{path}/rows/{held}").limit(0)
    return rows.join(keys, names)


def tracks_index(tracks: DataFrame, path: str, files: int | None = None) -> None:
    """People's rows of tracks (frame_id, track_id, class_name, row_id, ...) by frame and track, the last row of each."""
    write(tracks.filter(F.col("class_name") == "person"), path, ("frame_id", "track_id"), "row_id", files)
