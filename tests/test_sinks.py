"""Arrays and objects as files: round trips, order, and that a job that fails leaves nothing."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.sources import files, readers


@pytest.fixture(scope="module", autouse=True)
def sinks(spark):
    files.register(spark)


def test_arrays(spark, tmp_path):
    path = f"file://{tmp_path}/d"
    maps = spark.range(12).repartition(3).select(F.col("id").alias("frame"), F.lit(2).alias("h"), F.lit(3).alias("w"), F.transform(F.sequence(F.lit(1), F.lit(6)), lambda k: (k * F.col("id")).cast("float")).alias("depth"))
    maps.write.format("npy").mode("append").save(path)
    assert sorted(os.listdir(tmp_path / "d")) == [f"depth_{k:04d}.npy" for k in range(12)]
    assert np.load(tmp_path / "d/depth_0002.npy").tolist() == [[2, 4, 6], [8, 10, 12]]
    back = readers.read_depth(spark, path)
    assert sorted((r["frame"], r["h"], r["w"], r["depth"]) for r in back.collect()) == sorted((r["frame"], r["h"], r["w"], r["depth"]) for r in maps.collect())
    maps.filter("frame = 3").write.format("npy").mode("overwrite").option("name", "frame_{:04d}_depth.npy").save(path)
    assert os.listdir(tmp_path / "d") == ["frame_0003_depth.npy"]
    points = spark.createDataFrame([(7, 1, 2, 3, [float(k) for k in range(6)])], "frame long, h int, w int, c int, xyz array<double>")
    points.write.format("npy").mode("append").options(name="points_{:04d}.npy", array="xyz", shape="h,w,c").save(path)
    assert np.load(tmp_path / "d/points_0007.npy").shape == (1, 2, 3)


def test_failed_job_leaves_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/d"
    good = spark.range(8).repartition(4).select(F.col("id").alias("frame"), F.lit(1).alias("h"), F.lit(1).alias("w"), F.array(F.lit(1.0)).alias("depth"))
    good.filter("frame < 2").write.format("npy").mode("append").save(path)
    bad = good.withColumn("w", F.when(F.col("frame") == 5, 7).otherwise(1))
    with pytest.raises(Exception, match="reshape"):
        bad.write.format("npy").mode("overwrite").save(path)
    assert sorted(os.listdir(tmp_path / "d")) == ["depth_0000.npy", "depth_0001.npy"]
    with pytest.raises(Exception, match="no"):
        good.withColumn("h", F.when(F.col("frame") == 5, F.raise_error(F.lit("no"))).otherwise(1)).write.format("json_object").mode("append").save(f"file://{tmp_path}/o")
    assert not (tmp_path / "o").exists() or os.listdir(tmp_path / "o") == []


def test_one_object(spark, tmp_path):
    rows = spark.range(1000).repartitionByRange(4, "id").sortWithinPartitions("id").select("id", F.when(F.col("id") == 1, float("nan")).otherwise(F.col("id") / 2).alias("v"), F.array(F.lit('a "é"')).alias("s"), F.struct(F.lit(True).alias("ok")).alias("n"))
    rows.write.format("json_object").option("metadata", '{"fps": 24, "name": "é"}').option("file", "tracks.json").mode("append").save(f"file://{tmp_path}/o")
    got = json.loads((tmp_path / "o/tracks.json").read_text())
    assert os.listdir(tmp_path / "o") == ["tracks.json"]
    assert got["metadata"] == {"fps": 24, "name": "é"} and [r["id"] for r in got["tracks"]] == list(range(1000))
    assert got["tracks"][1] == {"id": 1, "v": None, "s": ['a "é"'], "n": {"ok": True}} and got["tracks"][3]["v"] == 1.5
    rows.filter("id < 0").write.format("json_object").mode("append").option("file", "none.json").save(f"{tmp_path}/o")
    assert json.loads((tmp_path / "o/none.json").read_text()) == []
