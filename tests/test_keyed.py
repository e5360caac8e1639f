"""A lookup in the indexed table opens one file and reads a part of it; versions, merges, last rows."""

import pytest
from pyspark.sql import functions as F

from trackweave.sources import keyed


def scanned(df) -> int:
    """Rows that came out of the files."""
    df.collect()
    plan, total = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        node = plan.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            plan.append(node.executedPlan())
            continue
        if node.nodeName().startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        plan += [children.apply(k) for k in range(children.size())]
    return total


def test_lookup_reads_one_group(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    n = 200_000
    d = spark.range(n).select((F.col("id") % 2000).cast("int").alias("frame_id"), F.floor(F.col("id") / 2000).cast("long").alias("track_id"), F.lit("person").alias("class_name"), F.col("id").alias("row_id"), F.sha2(F.col("id").cast("string"), 512).alias("v"))
    keyed.tracks_index(d.unionByName(d.limit(50).withColumn("class_name", F.lit("car"))), path, files=8)
    assert keyed.read(spark, path).count() == n
    hit = keyed.find(spark, path, frame_id=1234, track_id=56)
    assert [r["row_id"] for r in hit.collect()] == [56 * 2000 + 1234]
    assert len(hit.inputFiles()) == 1 and scanned(hit) <= 5 * keyed.PAGE_ROWS
    assert keyed.find(spark, path, frame_id=1234, track_id=5600).collect() == [] and keyed.find(spark, path, frame_id=-1, track_id=0).collect() == []
    with pytest.raises(ValueError, match="frame_id"):
        keyed.find(spark, path, frame_id=1)
    many = spark.createDataFrame([(3, 4), (5, 99), (3, 4), (9, 1000)], "frame_id int, track_id long")
    got = keyed.find_all(many, path)
    assert sorted(r["row_id"] for r in got.collect()) == [4 * 2000 + 3, 99 * 2000 + 5] and len(got.inputFiles()) < 8


def test_last_row_and_merge(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    row = "frame_id int, track_id long, row_id long, v string"
    keyed.write(spark.createDataFrame([(1, 1, 5, "late"), (1, 1, 3, "early"), (2, 1, 1, "b"), (None, 1, 1, "x")], row), path, ("frame_id", "track_id"), "row_id")
    before = keyed.read(spark, path)
    assert {(r["frame_id"], r["v"]) for r in before.collect()} == {(1, "late"), (2, "b")}
    keyed.merge(spark.createDataFrame([(1, 1, 5, "same order"), (2, 1, 0, "older"), (7, 7, 7, "new")], row), path, ("frame_id", "track_id"), "row_id")
    assert {(r["frame_id"], r["v"]) for r in keyed.read(spark, path).collect()} == {(1, "same order"), (2, "b"), (7, "new")}
    assert before.count() == 2  # what was read goes on
    keyed.write(spark.createDataFrame([], row), f"{path}2", ("frame_id", "track_id"), "row_id")
    assert keyed.read(spark, f"{path}2").count() == 0 and keyed.find(spark, f"{path}2", frame_id=1, track_id=1).count() == 0
