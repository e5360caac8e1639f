"""Depths of boxes against a plain construction."""

import numpy as np
from pyspark.sql import functions as F

from trackweave.operators import chain
from trackweave.plans import flight
from trackweave.sources.adapters import view


def test_equal_boxes_are_cut_once(spark):
    """Thousands of boxes over a few pixels each get their depth, and pixels are taken for each kind of box, not for each box."""
    depth = np.arange(1.0, 17.0)
    maps = spark.createDataFrame([(0, 4, 4, depth.tolist()), (1, 4, 4, [0.0] * 16)], "frame long, h int, w int, depth array<float>")
    kinds = [(0, (0, 0, 20, 20)), (0, (10, 10, 40, 30)), (0, (5, 5, 5, 9)), (1, (0, 0, 40, 40)), (2, (0, 0, 40, 40))]
    boxes = spark.createDataFrame([(k, *(kinds[k % 5][0],), list(map(float, kinds[k % 5][1]))) for k in range(2000)], "key long, frame long, bbox array<double>")
    found = chain.box_depths(boxes, maps, 40.0, 40.0)
    got = {r["key"]: r["depth_m"] for r in found.collect()}
    for k in range(5):
        frame, (x1, y1, x2, y2) = kinds[k]
        held = np.sort(depth.reshape(4, 4)[round(y1 / 10) : round(y2 / 10), round(x1 / 10) : round(x2 / 10)].ravel()) if frame == 0 else np.zeros(0)
        want = np.median(held[held <= np.percentile(held, 70)]) if len(held) else None
        assert {got.get(j) for j in range(k, 2000, 5)} == {want}
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(k for k, line in enumerate(plan) if "Generate explode(sequence(y1" in line)
    assert "Aggregate [" in plan[at + 1] and "key" not in plan[at + 1] and "y2" in plan[at + 1]


def test_long_records_keep_their_time(spark):
    """Half seconds of millions of rows pass 2^31 milliseconds."""
    data = "/root/testdata/sf0.001"
    late = F.col("seq") * 40_000
    t = view(spark, data, "telemetry").withColumn("seq", late.cast("int"))
    d, p = view(spark, data, "detections").limit(5), view(spark, data, "depth_pixels").filter("frame_id < 3")
    telemetry, _ = flight._read_back(d, t, p)[1:3]
    want = {1_704_067_200_000 + r["seq"] * 500 for r in t.filter("upper(is_video) = 'TRUE'").select("seq").collect()}
    assert max(want) - 1_704_067_200_000 > 2**31
    assert {r[0] for r in telemetry.select(F.unix_millis("timestamp")).collect()} == want
