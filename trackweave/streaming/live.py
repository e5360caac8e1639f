"""Detections as a stream: people and crowds per window of event time, and the filter of tracks. The reference material has no streams; this is an addition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trackweave.operators.states import FILTERED, Kalman


def crowd_counts(detections: DataFrame, size: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """start, video_id, rows and known (rows with a crowd) per window of `ts`; rows that come more than `late` after the newest are left out, and so much state is kept."""
    x = detections.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "video_id")
    return x.agg(F.count("*").alias("rows"), F.count("crowd_id").alias("known")).select(F.col("w.start").alias("start"), "video_id", "rows", "known")


def track_sessions(detections: DataFrame, gap: str = "30 seconds", late: str = "5 minutes") -> DataFrame:
    """track_id, start, stop, rows of stretches of a track without a pause of `gap`."""
    x = detections.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "track_id")
    return x.agg(F.count("*").alias("rows")).select("track_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "rows")


def kalman_stream(detections: DataFrame, kalman: Kalman = Kalman(), keep: int = 600) -> DataFrame:
    """row_id, track_id and the filter's places and velocities of a stream of row_id, track_id, frame_id, pos_n, pos_e, pos_d: those of states.kalman_tracks, if a track's frames come in order.

    A row of an earlier frame than its track has had leaves the state as it is and comes out without places. A track is forgotten `keep` seconds after its last row.
    """
    def run(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        b = pd.concat(list(parts)).sort_values(["frame_id", "row_id"], ignore_index=True)
        frame, z, out = b["frame_id"].to_numpy(), b[["pos_n", "pos_e", "pos_d"]].to_numpy(float), np.full((len(b), 6), np.nan)
        state = np.array(held.get[0]).reshape(1, 6, 3) if held.exists else None
        for k in range(len(b)):
            if state is not None and frame[k] < state[0, 0, 0]:
                continue
            state = kalman.begun(frame[k : k + 1], z[k : k + 1]) if state is None else kalman.advanced(state, frame[k : k + 1], z[k : k + 1])
            out[k] = state[0, 1:3].ravel()
        held.update((state.ravel().tolist(),))
        held.setTimeoutDuration(keep * 1000)
        yield pd.DataFrame({"row_id": b["row_id"], "track_id": b["track_id"], **{c: out[:, i] for i, c in enumerate(FILTERED)}})

    schema = "row_id long, track_id long, " + ", ".join(f"{c} double" for c in FILTERED)
    x = detections.select("row_id", "track_id", "frame_id", "pos_n", "pos_e", "pos_d").groupBy("track_id")
    return x.applyInPandasWithState(run, schema, "state array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)
