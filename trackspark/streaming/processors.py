"""Per-camera state in streams, typed and with timers: recorders, backgrounds, late rows, followed tracks.

The rules are those of ``operators.recorder`` and ``operators.follower``.  State is kept as columns, so a query goes on
after the code has changed.  ``transformWithStateInPandas`` needs the RocksDB state store; ``state_store`` sets it for a session."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trackspark.operators import follower as f
from trackspark.operators import recorder as r

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


def in_order(rows: Iterator[pd.DataFrame], *columns: str) -> Iterator[tuple]:
    """The rows of a key in a micro-batch, by time: (seconds, columns)."""
    all_ = pd.concat(list(rows)).sort_values(["ts", columns[0]])
    yield from zip(r.seconds(all_["ts"]), *(all_[c].tolist() for c in columns), strict=True)


class RecorderState(StatefulProcessor):
    """A recorder per camera.  Its timer goes off when event time has passed the last frame by ``idle_secs``."""

    def __init__(self, settings: r.Recording) -> None:
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.own = handle.getValueState("recorder", "last double, last_event long, start_event long, frames long, until long")
        self.before = handle.getListState("before", "event_id long")
        self.preview = handle.getListState("preview", "event_id long")

    def _load(self) -> r.Recorder:
        one = r.Recorder(self.settings)
        if self.own.exists():
            one.last, one.last_event, one.start_event, one.frames, one.until = self.own.get()
            one.before = [x[0] for x in self.before.get()] if self.before.exists() else []
            one.preview = [x[0] for x in self.preview.get()] if self.preview.exists() else []
        return one

    def _keep(self, one: r.Recorder) -> None:
        if one.last is None:
            for s in (self.own, self.before, self.preview):
                s.clear()
            return
        self.own.update((one.last, one.last_event, one.start_event, one.frames, one.until))
        for s, events in ((self.before, one.before), (self.preview, one.preview)):
            s.put([(e,) for e in events]) if events else s.clear()

    def _due(self, one: r.Recorder) -> int:
        return int(np.ceil((one.last + self.settings.idle_secs) * 1000)) + 1

    def _out(self, key: tuple, found: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *x) for x in found], columns=names(r.RECORDED))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        one = self._load()
        found = [x for t, e, m, c in in_order(rows, "event_id", "motion", "ffc") for x in one.frame(t, int(e), bool(m), bool(c))]
        self._keep(one)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)
        self.handle.registerTimer(self._due(one))
        yield self._out(key, found)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        one = self._load()
        found = list(one.gone())
        self._keep(one)
        yield self._out(key, found)


def recordings(frames: DataFrame, settings: r.Recording = r.Recording(), watermark: str = "10 seconds") -> DataFrame:
    """RECORDED, as recordings end: those that end with a frame in its micro-batch, those of silent cameras by timer."""
    state_store(frames.sparkSession)
    rows = frames.select("camera", F.col("ts").cast("timestamp").alias("ts"), "event_id", "motion", "ffc").withWatermark("ts", watermark)
    return rows.groupBy("camera").transformWithStateInPandas(RecorderState(settings), r.RECORDED, "append", "EventTime")


class BackgroundState(StatefulProcessor):
    """The background of each camera as two arrays: values with edges, weights without."""

    def __init__(self, width: int, edge: int, step: float) -> None:
        self.width, self.edge, self.step = width, edge, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.own = handle.getValueState("background", "background array<double>, weights array<double>, average double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        one = r.Background(self.width, self.edge, self.step)
        if self.own.exists():
            values, weights, one.average = self.own.get()
            one.values = np.array(values, np.float64)
            one.weights = np.array(weights, np.float64).reshape(-1, self.width - 2 * self.edge)
        found = []
        for _, number, pixels in in_order(rows, "frame_number", "pixels"):
            changed = one.frame(pixels)
            found.append((key[0], int(number), one.average, changed, one.values.tolist()))
        self.own.update((one.values.tolist(), one.weights.ravel().tolist(), one.average))
        yield pd.DataFrame(found, columns=names(r.BACKGROUND))


def backgrounds(frames: DataFrame, width: int, edge: int = 1, step: float = 0.1) -> DataFrame:
    """BACKGROUND after each frame (camera, ts, frame_number, pixels row by row) of a stream."""
    state_store(frames.sparkSession)
    rows = frames.select("camera", F.col("ts").cast("timestamp").alias("ts"), "frame_number", "pixels")
    return rows.groupBy("camera").transformWithStateInPandas(BackgroundState(width, edge, step), r.BACKGROUND, "append", "None")


# --- late rows ------------------------------------------------------------------------------------

FLAGGED = "camera long, event_id long, ts timestamp, late boolean, late_rows long"


class LateState(StatefulProcessor):
    """How far each camera's time has come, and how many of its rows were behind that by more than the delay."""

    def __init__(self, delay_seconds: float) -> None:
        self.delay = delay_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.own = handle.getValueState("high", "high double, late long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        high, late = self.own.get() if self.own.exists() else (-np.inf, 0)
        all_ = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        t = r.seconds(all_["ts"])
        behind = t < high - self.delay  # against earlier micro-batches: order within one is free
        counts = late + np.cumsum(behind)
        self.own.update((float(max(high, t.max())), int(counts[-1])))
        yield pd.DataFrame({"camera": key[0], "event_id": all_["event_id"].to_numpy(), "ts": all_["ts"].to_numpy(), "late": behind, "late_rows": counts}).astype({"late_rows": "int64"})


def flagged(frames: DataFrame, delay_seconds: float = 3600.0) -> DataFrame:
    """FLAGGED: each row of a stream, whether it came behind its camera's watermark, and that camera's late rows so far."""
    state_store(frames.sparkSession)
    rows = frames.select("camera", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return rows.groupBy("camera").transformWithStateInPandas(LateState(delay_seconds), FLAGGED, "append", "None")


def count_late(frames: DataFrame, path: str, checkpoint: str, delay_seconds: float = 3600.0):  # noqa: ANN201
    """Side output: a query that writes the late rows of a stream, by camera, to Parquet at ``path``; each once."""
    late = flagged(frames, delay_seconds).where("late").select("camera", "event_id", "ts")
    return late.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


# --- tracks of a clip -----------------------------------------------------------------------------

_TRACK = "seen long, told boolean, ever_told boolean, last_cheap long, last_full long, n_full long, scores array<double>, last_prediction long, box array<long>"


class FollowerState(StatefulProcessor):
    """Tracks by id in a map, and the open frame.  A clip that is silent for ``idle_seconds`` is over."""

    def __init__(self, cadence: f.Cadence, idle_seconds: float) -> None:
        self.cadence, self.idle = cadence, idle_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.own = handle.getValueState("turns", "next_cheap long, next_full long, open long, closed long")
        self.active = handle.getListState("active", "track_id long, box array<long>, offer array<double>")
        self.answers = handle.getListState("answers", "track_id long, model string, scores array<double>")
        self.tracks = handle.getMapState("tracks", "track_id long", _TRACK)

    def _load(self) -> f.Follower:
        one = f.Follower(self.cadence)
        if self.own.exists():
            one.next_cheap, one.next_full, one.open, one.closed = self.own.get()
            box = lambda b: [*b[:-1], None if b[-1] is None else bool(b[-1])]
            if self.active.exists():
                one.active = {k: (box(b), None if o is None else list(o)) for k, b, o in self.active.get()}
            if self.answers.exists():
                one.answers = [(k, m, list(s)) for k, m, s in self.answers.get()]
            for (k,), (seen, told, ever, cheap, full, n, scores, last, b) in self.tracks.iterator():
                one.tracks[k] = f.Track(seen, told, ever, cheap, full, n, None if scores is None else list(scores), last, box(b))
        return one

    def _keep(self, one: f.Follower, before: set[int]) -> None:
        whole = lambda b: [None if v is None else int(v) for v in b]
        self.own.update((one.next_cheap, one.next_full, one.open, one.closed))
        for state, rows in ((self.active, [(k, whole(b), o) for k, (b, o) in one.active.items()]), (self.answers, one.answers)):
            state.put(rows) if rows else state.clear()
        for k in before - set(one.tracks):
            self.tracks.removeKey((k,))
        for k, t in one.tracks.items():
            self.tracks.updateValue((k,), (t.seen, t.told, t.ever_told, t.last_cheap, t.last_full, t.n_full, t.scores, t.last_prediction, whole(t.box)))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        one, found, last = self._load(), [], None
        before = set(one.tracks)
        for t, *values in in_order(rows, *f.ROWS):
            last = t
            found += [(key[0], *x) for x in one.row(*f.plain_row(*values))]
        self._keep(one, before)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)
        self.handle.registerTimer(int((last + self.idle) * 1000) + 1)
        yield _followed(found)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        found = [(key[0], *x) for x in self._load().gone()]
        for s in (self.own, self.active, self.answers, self.tracks):
            s.clear()
        yield _followed(found)


def _followed(found: list[tuple]) -> pd.DataFrame:
    whole = {c: "Int64" for c in ("track_id", "x", "y", "width", "height", "mass", "last_prediction")}
    return pd.DataFrame(found, columns=names(f.GIVES)).astype(whole | {"label": "Int32", "blank": "boolean"})


def followed(rows: DataFrame, cadence: f.Cadence = f.Cadence(), idle_seconds: float = 60.0, watermark: str = "10 seconds") -> DataFrame:
    """GIVES for a stream of rows (camera, ts and the follower's ROWS): requests for models, whose answers come back as rows, and events of tracks."""
    state_store(rows.sparkSession)
    timed = rows.select("camera", F.col("ts").cast("timestamp").alias("ts"), *f.ROWS).withWatermark("ts", watermark)
    return timed.groupBy("camera").transformWithStateInPandas(FollowerState(cadence, idle_seconds), f.GIVES, "append", "EventTime")
