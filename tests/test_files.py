"""Readers and writers on files made here."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.sources import readers, writers


def uri(path):
    return f"file://{path}"


def test_tracks(spark, tmp_path):
    rows = [{"frame_id": 3, "track_id": 7, "bbox": [1, 2, 3, 4.5], "confidence": 0.5, "class_name": "person"}, {"frame_id": 4, "id": 9, "bbox": None, "class_name": "car"}]
    want = [(0, 3, 7, [1.0, 2.0, 3.0, 4.5], 0.5, "person"), (1, 4, 9, None, None, "car")]
    for name, root in (("list", rows), ("object", {"metadata": {}, "tracks": rows})):
        (tmp_path / f"{name}.json").write_text(json.dumps(root, indent=1))
        assert [tuple(r) for r in readers.read_tracks(spark, uri(tmp_path / f"{name}.json")).orderBy("row_id").collect()] == want
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rows)))
    assert [tuple(r)[1:] for r in readers.read_tracks(spark, uri(tmp_path / "lines.json"), True).orderBy("frame_id").collect()] == [w[1:] for w in want]
    (tmp_path / "empty.json").write_text("[]")
    assert readers.read_tracks(spark, uri(tmp_path / "empty.json")).collect() == []
    (tmp_path / "other.json").write_text("3")
    with pytest.raises(Exception, match="list of rows"):
        readers.read_tracks(spark, uri(tmp_path / "other.json")).collect()


FLIGHT = """OSD.latitude,OSD.longitude,OSD.height [m],GIMBAL.pitch,GIMBAL.yaw [deg],GIMBAL.roll,OSD.yaw,GIMBAL.mode,CAMERA.isVideo,OSD.flyTime,HOME.latitude,HOME.longitude,HOME.height [m],OSD.xSpeed [m/s],CUSTOM.date [local],CUSTOM.updateTime [local]
51.1,-3.1,40,-30,5,0,10,FPV,FALSE,0m 1.0s,,,,1,1/20/2026,11:36:09.73 AM
51.2,-3.2,41,-31,6,,11,,TRUE,9m 15.0s,51,-3,7,x,1/20/2026,11:36:10.1 AM
51.3,,42,-32,7,0,12,Free,true,3,,,,2,1/20/2026,11:36:11.00 AM
51.4,-3.4,nan,-33,8,0,13,Free,1,4.5,52,-4,8,3,1/20/2026,1:36:12 PM
"""


def test_flight(spark, tmp_path):
    (tmp_path / "f.csv").write_text(FLIGHT)
    t, home = readers.read_flight(spark, uri(tmp_path / "f.csv"), "America/New_York")
    assert tuple(home.first()) == (51.0, -3.0, 7.0)
    rows = t.orderBy("seq").collect()
    assert [(r["latitude"], r["gimbal_roll"], r["gimbal_mode"], r["time"], r["vel_north"], r["vel_east"]) for r in rows] == [(51.2, 0.0, "Follow Yaw", 555.0, 0.0, 0.0)]
    assert [str(r["timestamp"]) for r in t.orderBy("seq").select(F.col("timestamp").cast("string").alias("timestamp")).collect()] == ["2026-01-20 16:36:10.1"]
    with pytest.raises(ValueError, match="gimbal_roll"):
        readers.resolved(["OSD.latitude", "OSD.longitude", "OSD.altitude", "GIMBAL.pitch", "GIMBAL.yaw"])
    frames = readers.read_telemetry(spark, uri(tmp_path / "f.csv"), 3).orderBy("frame").collect()
    assert [(r["frame"], r["altitude"], r["below"]) for r in frames] == [(0, 41.0, 31.0), (1, 42.0, 32.0), (2, 41.5, 33.0)]
    (tmp_path / "zero.csv").write_text(FLIGHT.replace("-31,", "0,").replace("-32,", "0,").replace("-33,", "0,"))
    assert readers.read_telemetry(spark, uri(tmp_path / "zero.csv"), 3).count() == 0
    assert readers.read_telemetry(spark, uri(tmp_path / "zero.csv"), 3, override=-90.0).filter("pitch = -90 and below = 90").count() == 3


def test_first_session(spark):
    rows = [(k, v, 51 + k / 1e5, -3.0, 40.0 + k, 350.0 + k * 10) for k, v in enumerate(["FALSE", "true", "1", "0", "TRUE"])]
    got = readers.session_trajectory(spark.createDataFrame(rows, "seq int, is_video string, latitude double, longitude double, altitude double, drone_yaw double")).orderBy("seq").collect()
    assert [(r["seq"], round(r["north"], 2), r["up"], round(r["yaw"], 6)) for r in got] == [(1, 0.0, 0.0, 0.0), (2, 1.11, 1.0, 10.0)]


def test_arrays(spark, tmp_path):
    turn = np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1.0]])
    m = np.concatenate([turn, [[1], [2], [3.0]]], 1)[None]
    np.savez(tmp_path / "a.npz", poses=np.concatenate([m, [[[0, 0, 0, 1.0]]]], 1))
    np.savez(tmp_path / "b.npz", extrinsics=m)
    a, b = (readers.read_poses(spark, uri(tmp_path / f"{n}.npz")).first() for n in "ab")
    assert (a["r"], a["t"]) == (turn.ravel().tolist(), [1, 2, 3]) and (b["r"], b["t"]) == (turn.T.ravel().tolist(), (-turn.T @ [1, 2, 3]).tolist())
    (tmp_path / "d").mkdir()
    for name, v in (("depth_metric_0001", 1), ("depth_0001", 2), ("depth_0002", 3), ("depth_3", 4), ("other", 9), ("frame_0007_depth", 5), ("0007", 6), ("0008", 7), ("depth_8", 9), ("frame_9_depth", 9), ("depth_metric_12345", 8)):
        np.save(tmp_path / "d" / name, np.full((2, 3), v, np.float32))
    maps = readers.read_depth(spark, uri(tmp_path / "d"))
    assert [(r["frame"], r["h"], r["w"], r["depth"][0]) for r in maps.orderBy("frame").collect()] == [(1, 2, 3, 1.0), (2, 2, 3, 3.0), (3, 2, 3, 4.0), (7, 2, 3, 5.0), (8, 2, 3, 7.0), (12345, 2, 3, 8.0)]
    assert readers.depth_pixels(maps).filter("u = 2 and v = 1").count() == 6
    np.save(tmp_path / "k.npy", np.array([[5, 0, 1], [0, 6, 2], [0, 0, 1.0]]))
    assert tuple(readers.read_intrinsics(spark, uri(tmp_path / "k.npy")).first()) == (0, 5.0, 6.0, 1.0, 2.0)


def test_many_maps_are_read_by_few_tasks(spark, tmp_path):
    """Neither the driver's listing nor the tasks follow the number of files."""
    (tmp_path / "d").mkdir()
    for k in range(300):
        np.save(tmp_path / "d" / f"depth_{k:04d}.npy", np.full((1, 2), k, np.float32))
    maps = readers.read_depth(spark, uri(tmp_path / "d"))
    sc = spark.sparkContext
    sc.setJobGroup("maps", "maps")
    assert sorted((r["frame"], *r["depth"]) for r in maps.collect()) == [(k, float(k), float(k)) for k in range(300)]
    tracker = sc.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("maps") for s in tracker.getJobInfo(j).stageIds]
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert max(s.numTasks for s in stages if s) <= 8
    assert "Scan binaryFile" not in maps._jdf.queryExecution().executedPlan().toString()
    (tmp_path / "empty").mkdir()
    assert readers.read_depth(spark, uri(tmp_path / "empty")).count() == 0


def test_texts(spark, tmp_path):
    frame = {"filepath": "x.jpg", "extri": [[1.0]], "intri": [[2.0]]}
    (tmp_path / "s.jgz").write_bytes(b"")
    with gzip.open(tmp_path / "s.json.gz", "wt") as f:
        json.dump({"long": [frame] * 3, "short": [frame]}, f)
    got = readers.read_annotations(spark, uri(tmp_path / "s.json.gz"), 2).orderBy("idx").collect()
    assert [(r["seq"], r["idx"], r["filepath"], r["extri"]) for r in got] == [("long", k, "x.jpg", [[1.0]]) for k in range(3)]
    (tmp_path / "c.txt").write_text("frame cameraID k[0,0]\n0 0 1.5 2\n0 1 3 4\n1 0 5 6\n2 7 " + " ".join(str(k) for k in range(150)) + "\n")
    assert readers.read_camera_text(spark, uri(tmp_path / "c.txt"), 7).first()["numbers"] == [float(k) for k in range(150)]
    assert [tuple(r) for r in readers.read_camera_text(spark, uri(tmp_path / "c.txt"), 0).orderBy("frame").collect()] == [(0, [1.5, 2.0]), (1, [5.0, 6.0])]
    (tmp_path / "p.json").write_text(json.dumps({"One": [11, 12, 13], "Two": [[21, 22, 23], [], [24, 25, 99]], "Way": {"from_osm_name": "High Street", "buffer_m": 4}, "None": [], "Null": None}))
    rings, buffers = readers.read_user_polygons(spark, uri(tmp_path / "p.json"))
    nodes = spark.createDataFrame([(i, float(i), 0.0) for i in (11, 12, 13, 21, 22, 23, 24, 25)], "node long, n double, e double")
    vertices, missing = readers.ring_vertices(rings, nodes)
    assert [tuple(r) for r in vertices.select("name", "ring_id", "n").orderBy("name", "ring_id", "seq").collect()] == [("One", 0, 11.0), ("One", 0, 12.0), ("One", 0, 13.0), ("Two", 0, 21.0), ("Two", 0, 22.0), ("Two", 0, 23.0)]
    assert {tuple(r) for r in missing.collect()} == {("One", 0), ("Two", 1)} and [tuple(r) for r in buffers.collect()] == [("Way", "High Street", 4.0)]
    (tmp_path / "paste.txt").write_text("123456789\n# Wood Street\n 111111 (part of a way)\n222222\n111111\nnot 333333\n\n#Empty\n# Quay \n444444\n")
    assert [tuple(r) for r in readers.read_pasted_ids(spark, uri(tmp_path / "paste.txt")).orderBy("street", "k").collect()] == [("Quay", 0, 444444), ("Wood Street", 0, 111111), ("Wood Street", 1, 222222)]
    named = readers.named_polygons(spark.createDataFrame([("a", "Polygon"), ("", "Polygon"), (None, "Polygon"), ("b", "Point"), ("c", "MultiPolygon")], "name string, kind string"))
    assert {r["name"] for r in named.collect()} == {"a", "c"}
    assert len(spark.range(1).select(readers.graph_key(51.47, -3.18, 51.48, -3.17)).first()[0]) == 16


STATE = "frame_id int, track_id long, row_id long, class_name string, lat double, lon double, alt double, depth_m double, heading_deg double, speed_mph double, pos_ned array<double>, crowd_id int, crowd_density double, vn double, ve double, street_index int"


def states(spark):
    return spark.createDataFrame([(2, 1, 5, "person", 51.123456789, -3.0, 40.0, float("nan"), None, 1.23456, [1.0, 2.5], 4, 0.123456, 0.5, None, 1), (0, 0, 1, "UAV", 51.0, -3.5, 40.126, None, 12.34, 2.26, None, None, None, None, None, None), (2, 9, 3, 'a "b"', 51.0, -3.0, 1.0, 2.0, 3.0, 4.0, [], None, float("inf"), 1.0, 1.0, None)], STATE)


def test_states_and_frames(spark, tmp_path):
    d = states(spark)
    writers.write_states(d, uri(tmp_path / "states"))
    lines = sorted(r["value"] for r in spark.read.text(uri(tmp_path / "states")).collect())
    assert '"lat": 51.1234567890, "lon": -3.0000000000, "alt": 40.00, "depth_m": null, "heading_deg": null, "speed_mph": 1.2346, "pos_ned": [1.000000, 2.500000], "crowd_id": 4' in lines[1] and json.loads(lines[2])["class_name"] == 'a "b"'
    back = readers.read_tracks(spark, uri(tmp_path / "states"), True)
    assert {(r["frame_id"], r["track_id"]) for r in back.collect()} == {(2, 1), (0, 0), (2, 9)}
    writers.write_frames(d, {"fps": "24"}, uri(tmp_path / "frames"))
    rows = {r["frame_id"]: r for r in spark.read.json(uri(tmp_path / "frames/frames")).collect()}
    assert sorted(rows) == [0, 1, 2] and rows[0]["uav"]["alt"] == 40.13 and rows[1]["persons"] == [] and [p["tid"] for p in rows[2]["persons"]] == [9, 1]
    assert rows[2]["persons"][1]["si"] == 1 and rows[2]["persons"][1]["ve"] == 0.0 and spark.read.json(uri(tmp_path / "frames/metadata")).first()["fps"] == "24"
    writers.write_with_metadata(d, {"a": "b"}, uri(tmp_path / "both"))
    assert spark.read.parquet(uri(tmp_path / "both/tracks")).count() == 3
    assert readers.lookup(d, 2, 1).count() == 1 and readers.lookup(d, 7, 1).count() == 0


def test_lines_and_batches(spark, tmp_path):
    hops = spark.createDataFrame([(1, 1, -3.0, 51.0), (1, 0, -3.5, 51.5), (2, 0, 0.0, 0.0)], "k int, hop int, lon double, lat double")
    got = {r["k"]: r["geojson"] for r in writers.line_string(hops, "k").collect()}
    assert json.loads(got[1]) == {"type": "LineString", "coordinates": [[-3.5, 51.5], [-3.0, 51.0]]} and got[2] is None
    d = spark.createDataFrame([(1, "old"), (2, "old")], "video_id int, v string")
    writers.write_batch(d, uri(tmp_path / "batch"))
    writers.write_batch(d.filter("video_id = 2").withColumn("v", F.lit("new")), uri(tmp_path / "batch"))
    assert {tuple(r) for r in spark.read.parquet(uri(tmp_path / "batch")).select("video_id", "v").collect()} == {(1, "old"), (2, "new")}
    videos = spark.createDataFrame([(k,) for k in range(5)], "video_id int")
    assert {r["video_id"] for r in writers.pending(videos, videos.filter("video_id < 2"), videos.filter("video_id <> 3")).collect()} == {2, 4}


def test_graph(spark, tmp_path):
    spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 0.0)], "id long, x double, y double").write.parquet(uri(tmp_path / "g/nodes"))
    spark.createDataFrame([(1, 2, 3.0)], "src long, dst long, length double").write.parquet(uri(tmp_path / "g/edges"))
    _, edges = readers.read_graph(spark, uri(tmp_path / "g"))
    assert edges.first()["bearing"] == 90.0
