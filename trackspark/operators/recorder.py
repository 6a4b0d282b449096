"""What a camera does by itself, frame by frame: it records, and it keeps a background.

The rules are steps over plain values; ``streaming.processors`` keeps the same values as state of a
stream, and the functions here fold a table of frames, camera by camera, without holding one."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Recording:
    """Settings of a recorder; frames are counted, so seconds turn into frames by ``fps``."""

    fps: int = 9
    preview_secs: int = 5
    min_secs: int = 5
    max_secs: int = 600
    idle_secs: float = 60.0

    @property
    def preview(self) -> int:
        return self.preview_secs * self.fps

    @property
    def least(self) -> int:
        return self.min_secs * self.fps

    @property
    def most(self) -> int:
        return self.max_secs * self.fps


RECORDED = "camera long, start_event long, end_event long, frames long, preview array<long>, reason string, kept boolean"


@dataclass
class Recorder:
    """One camera's recorder.

    Motion starts a recording, unless the camera calibrates; the frames before it, up to the pre-roll, go with it.  Each frame
    with motion moves its end to ``least`` frames later; it stops when that is reached in quiet (``quiet``) or at ``most`` frames
    (``full``).  When no frame comes for ``idle_secs`` the camera is gone: the recording is stopped by force (``idle``), and kept
    only if it has more frames than pre-roll and minimum."""

    settings: Recording = Recording()
    before: list[int] = field(default_factory=list)  # the last frames, at most the pre-roll
    last: float | None = None
    last_event: int | None = None
    start_event: int | None = None  # None: not recording
    frames: int = 0
    until: int = 0
    preview: list[int] = field(default_factory=list)

    def _closed(self, end: int, reason: str) -> tuple:
        s = self.settings
        kept = reason != "idle" or self.frames > s.preview + s.least
        out = (self.start_event, end, self.frames, self.preview, reason, kept)
        self.start_event, self.frames, self.until, self.preview = None, 0, 0, []
        return out

    def gone(self) -> Iterator[tuple]:
        """The camera sends nothing any more."""
        if self.start_event is not None:
            yield self._closed(self.last_event, "idle")
        self.before, self.last, self.last_event = [], None, None

    def frame(self, t: float, event: int, motion: bool, ffc: bool) -> Iterator[tuple]:
        """What ends with a frame: start_event, end_event, frames, preview, reason, kept."""
        s = self.settings
        if self.last is not None and t - self.last > s.idle_secs:
            yield from self.gone()
        self.last, self.last_event = t, event
        if self.start_event is None and motion and not ffc:
            self.start_event, self.until, self.preview = event, s.least, list(self.before)
        if self.start_event is not None:
            self.frames += 1
            if motion:
                self.until = self.frames + s.least
            if not motion and self.frames >= self.until:
                yield self._closed(event, "quiet")
            elif self.frames == s.most:
                yield self._closed(event, "full")
        self.before = [*self.before, event][-s.preview :] if s.preview else []


def seconds(ts: pd.Series) -> np.ndarray:
    return ts.astype("datetime64[us]").astype("int64").to_numpy() / 1e6


def folded(frames: DataFrame, columns: list[str], gives: str, make: Callable[[], object], step: Callable, end: Callable | None = None) -> DataFrame:
    """Fold each camera's frames in order of time: ``step(state, seconds, *columns)`` gives rows, ``end(state)`` the last ones.

    Frames go through a task as a sorted stream; a state at a time is held."""
    names = [c.split()[0] for c in gives.split(", ")]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        camera, state, found = None, None, []
        for rows in batches:
            cameras = rows["camera"].astype(object).where(rows["camera"].notna(), None).tolist()
            for c, t, *values in zip(cameras, seconds(rows["ts"]), *(rows[k].tolist() for k in columns), strict=True):
                if state is None or c != camera:
                    if state is not None and end:
                        found += [(camera, *r) for r in end(state)]
                    camera, state = c, make()
                found += [(c, *r) for r in step(state, t, *values)]
            yield pd.DataFrame(found, columns=names)
            found = []
        if state is not None and end:
            yield pd.DataFrame([(camera, *r) for r in end(state)], columns=names)

    rows = frames.select(*[F.col(c).cast("timestamp").alias(c) if c == "ts" else c for c in dict.fromkeys(["camera", "ts", *columns])])
    return rows.repartition("camera").sortWithinPartitions("camera", "ts", columns[0]).mapInPandas(fold, gives)


def recordings(frames: DataFrame, settings: Recording = Recording()) -> DataFrame:
    """RECORDED: the recordings of frames (camera, ts, event_id, motion, ffc); behind the last frame of a camera it is gone."""
    return folded(frames, ["event_id", "motion", "ffc"], RECORDED, lambda: Recorder(settings), lambda r, t, e, m, f: r.frame(t, int(e), bool(m), bool(f)), lambda r: r.gone())


# --- background -----------------------------------------------------------------------------------

BACKGROUND = "camera long, frame_number long, average double, changed boolean, background array<double>"


@dataclass
class Background:
    """A camera's background, pixel by pixel: a colder value is taken at once, a warmer one only when the weight makes up for it.

    The weight of a pixel grows by ``step`` on each frame that is warmer than background and weight, and is 0 again
    when the background takes a value.  ``edge`` pixels at the borders are not measured: they are copies of the next inside."""

    width: int
    edge: int = 1
    step: float = 0.1
    values: np.ndarray | None = None
    weights: np.ndarray | None = None
    average: float = 0.0

    def frame(self, pixels: list[float]) -> bool:
        """Take a frame in, row by row; whether the background has changed."""
        e = self.edge
        whole = np.asarray(pixels, np.float64).reshape(-1, self.width)
        inner = whole[e : whole.shape[0] - e, e : self.width - e]
        if self.values is None:
            self.weights, self.average, new = np.zeros_like(inner), float(inner.mean()), inner
            changed = True
        else:
            old = self.values.reshape(whole.shape)[e : whole.shape[0] - e, e : self.width - e]
            warmer = old < inner - self.weights
            new = np.where(warmer, old, inner)
            self.weights = np.where(warmer, self.weights + self.step, 0.0)
            changed = bool((new != old).any())
            if changed:
                self.average = float(round(new.mean()))
        if changed:
            self.values = np.pad(new, e, mode="edge").ravel()
        return changed


def backgrounds(frames: DataFrame, width: int, edge: int = 1, step: float = 0.1, last_only: bool = False) -> DataFrame:
    """BACKGROUND after each frame (camera, ts, frame_number, pixels row by row), or after the last of each camera."""

    def one(b: Background, _: float, number: int, pixels: list[float]) -> Iterator[tuple]:
        changed = b.frame(pixels)
        b.at = (number, b.average, changed, b.values.tolist() if last_only else b.values)
        if not last_only:
            yield b.at

    return folded(frames, ["frame_number", "pixels"], BACKGROUND, lambda: Background(width, edge, step), one, (lambda b: [b.at]) if last_only else None)
