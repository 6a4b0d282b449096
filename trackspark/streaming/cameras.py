"""Per-camera streams: the same functions on a batch table and on a stream where semantics allow, and
stateful steps for what depends on its own past.

Event time is ``ts``; state is kept by camera; rows of a micro-batch are sorted by time before a step.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trackspark.operators import tracker


def timed(frames: DataFrame) -> DataFrame:
    """ts as an instant: watermarks need one."""
    return frames.withColumn("ts", F.col("ts").cast("timestamp"))


def gap_sessions(frames: DataFrame, gap_seconds: int, watermark: str | None = None) -> DataFrame:
    """camera, first, last, frames of runs of frames at most ``gap_seconds`` apart; batch or stream."""
    rows = timed(frames)
    if watermark:
        rows = rows.withWatermark("ts", watermark)
    found = rows.groupBy("camera", F.session_window("ts", f"{gap_seconds} seconds")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("frames"))
    return found.select("camera", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"), "frames")


def segments(frames: DataFrame, length: str, watermark: str) -> DataFrame:
    """Continuous segments of a fixed length."""
    rows = timed(frames).withWatermark("ts", watermark)
    return rows.groupBy("camera", F.window("ts", length)).agg(F.count(F.lit(1)).alias("frames")).select("camera", F.col("window.start").cast("timestamp_ntz").alias("start"), "frames")


def stepped(frames: DataFrame, kind: str, watermark: str = "1 hour", keep_hours: int = 6) -> DataFrame:
    """event_id and what the step of a kind (tracker.STEPS) gives, frame by frame.

    The step's state is kept by camera, and goes when the watermark has passed its last frame by ``keep_hours``."""
    names = [c.split()[0] for c in tracker.gives(kind).split(", ")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        step = pickle.loads(bytes(state.get[0])) if state.exists else tracker.STEPS[kind]()
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        found = tracker.stepped(step, rows)
        state.update((pickle.dumps(step),))
        last = int(tracker.seconds(rows["ts"])[-1] * 1000)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + keep_hours * 3_600_000)
        yield pd.DataFrame(found, columns=names)

    keyed = timed(frames).withWatermark("ts", watermark).select(*tracker.needs(kind)).groupBy("camera")
    return keyed.applyInPandasWithState(run, tracker.gives(kind), "state binary", "append", GroupStateTimeout.EventTimeTimeout)


def throttled(frames: DataFrame) -> DataFrame:
    """event_id, flag: whether a frame is recorded, by a token bucket per camera."""
    return stepped(frames, "throttle")


def online_tracks(regions: DataFrame, idle_minutes: int = 10) -> DataFrame:
    """Rows of tracker.ASSIGNED: the tracker's step over a stream of regions; a clip's state goes when it has been idle.

    Frames must come in order, and all regions of a frame in one micro-batch."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = pickle.loads(bytes(state.get[0])) if state.exists else tracker.fresh_state()
        found = tracker.assigned(key[0], pd.concat(list(batches)), now)
        state.update((pickle.dumps(now),))
        state.setTimeoutDuration(idle_minutes * 60_000)
        yield found

    return regions.groupBy("clip_id").applyInPandasWithState(step, tracker.ASSIGNED, "state binary", "append", GroupStateTimeout.ProcessingTimeTimeout)


def recordings(media: DataFrame, sidecars: DataFrame, within: str = "1 hour") -> DataFrame:
    """stem: emitted once both the media file and the sidecar of a recording have come."""
    m = media.withWatermark("ts", within).select("stem", F.col("ts").alias("media_ts"))
    s = sidecars.withWatermark("ts", within).select(F.col("stem").alias("side_stem"), F.col("ts").alias("side_ts"))
    near = f"stem = side_stem and side_ts between media_ts - interval {within} and media_ts + interval {within}"
    return m.join(s, F.expr(near)).select("stem", F.greatest("media_ts", "side_ts").alias("ready"))
