"""Windows and sessions of a stream against plain counts."""

import datetime
import time

from trackweave.streaming import live

SCHEMA = "ts timestamp, video_id int, track_id long, crowd_id int"


def test_windows_and_sessions(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, 0) + datetime.timedelta(seconds=s)
    rows = [(at(1), 0, 1, 5), (at(20), 0, 1, None), (at(61), 0, 1, 5), (at(100), 1, 2, 6), (at(2000), 1, 2, 6)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    for name, f in (("counts", live.crowd_counts), ("sessions", live.track_sessions)):
        stream = spark.readStream.schema(SCHEMA).parquet(f"file://{tmp_path}/in")
        q = f(stream).writeStream.format("memory").queryName(name).outputMode("complete" if name == "counts" else "append").option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    assert {(r["start"].minute, r["video_id"], r["rows"], r["known"]) for r in spark.table("counts").collect()} == {(0, 0, 2, 1), (1, 0, 1, 1), (1, 1, 1, 1), (33, 1, 1, 1)}
    assert {(r["track_id"], r["rows"]) for r in spark.table("sessions").collect()} == {(1, 2), (1, 1), (2, 1)}


def test_filter_over_a_restart(spark, tmp_path):
    """The stream's filter in two runs equals the batch filter on all rows; a late row is left out."""
    import random

    from trackweave.operators import states

    r = random.Random(4)
    schema = "row_id long, track_id long, frame_id int, pos_n double, pos_e double, pos_d double"
    rows = [(k, k % 7, k // 7 * (1 + k % 7) // 2, r.uniform(0, 9), r.uniform(0, 9), r.uniform(-9, 0)) for k in range(210)]
    for run, part in enumerate((rows[:98], [*rows[98:], (999, 3, -1, 0.0, 0.0, 0.0)])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")
        q = live.kalman_stream(stream).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/check").trigger(processingTime="1 second").start()
        until = time.time() + 90  # batches go on for the sake of timeouts, so there is no end to wait for
        while time.time() < until and sum(p["numInputRows"] for p in q.recentProgress) < len(part) and q.isActive:
            time.sleep(0.5)
        q.stop()
        assert q.exception() is None, run
    got = {x["row_id"]: tuple(x)[2:] for x in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    late = got.pop(999)
    assert all(v is None or v != v for v in late)
    want = {x["row_id"]: tuple(x)[2:] for x in states.kalman_tracks(spark.createDataFrame(rows, schema)).collect()}
    assert got.keys() == want.keys() and all(abs(a - b) < 1e-9 for k in got for a, b in zip(got[k], want[k], strict=True))
