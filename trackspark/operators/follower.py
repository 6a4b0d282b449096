"""What is asked of the models about the tracks of a clip, and what subscribers hear of them.

Rows come frame by frame: the tracks that are active, with their boxes, and answers of models.  A frame is closed by the first row of a
later one, so its rows may come in any order and in several micro-batches.

Questions: every ``cheap_every`` frames the cheap model is asked about active tracks that the full model has not
answered on, of each at most once in ``cheap_again`` frames.  Every ``full_every`` frames the full model is asked about
one track: not one that is false-positive with a confidence of ``sure`` or more, not one asked about in the last
``full_soon`` frames (``full_again`` once it has been answered on twice); the least likely false-positive first.  If none is
left, the least sure of the false-positives takes the turn.

Events: a track that is predicted as something else than false-positive starts, goes on frame by frame with its scores, box and last
prediction, and ends when it is gone or becomes a false-positive; a track that is gone after fewer than ``least_frames`` frames, and was never told of, is filtered."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .recorder import folded

BOX = ("x", "y", "width", "height", "mass", "blank")
#: Columns of the rows that come in; ``offer``: what the models would say of a track in this frame, where that is known.
ROWS = ("frame_number", "track_id", *BOX, "offer", "model", "scores")
ROWS_DDL = "frame_number long, track_id long, x long, y long, width long, height long, mass long, blank boolean, offer array<double>, model string, scores array<double>"
GIVES = "camera long, frame_number long, track_id long, event string, model string, label int, confidence double, scores array<double>, x long, y long, width long, height long, mass long, blank boolean, last_prediction long"


@dataclass(frozen=True)
class Cadence:
    cheap_every: int = 10
    cheap_again: int = 30
    full_every: int = 25
    full_soon: int = 20
    full_again: int = 40
    sure: float = 0.7
    false_positive: int = 0
    least_frames: int = 3


@dataclass
class Track:
    seen: int = 0
    told: bool = False
    ever_told: bool = False
    last_cheap: int | None = None
    last_full: int | None = None
    n_full: int = 0
    scores: list[float] | None = None
    last_prediction: int | None = None
    box: list = field(default_factory=lambda: [None] * len(BOX))

    def share(self, k: int) -> float:
        return self.scores[k] / sum(self.scores)

    @property
    def label(self) -> int | None:
        return None if self.scores is None else int(np.argmax(self.scores))


@dataclass
class Follower:
    cadence: Cadence = Cadence()
    next_cheap: int = 0
    next_full: int = 0
    open: int | None = None
    closed: int = -1
    active: dict[int, tuple] = field(default_factory=dict)  # of the open frame: track -> (box, offer)
    answers: list[tuple] = field(default_factory=list)  # to the open frame: (track, model, scores)
    tracks: dict[int, Track] = field(default_factory=dict)

    def row(self, frame: int, track: int | None, *rest: object) -> Iterator[tuple]:
        """What the row brings about: rows of GIVES without the camera."""
        *box, offer, model, scores = rest
        if self.open is not None and frame > self.open:
            yield from self.close()
        if frame <= self.closed:  # only an answer can still be of use
            if model is not None:
                self._answer(frame, track, model, scores)
            return
        self.open = frame
        if model is not None:
            self.answers.append((track, model, list(scores)))
        elif track is not None:
            self.active[track] = (list(box), None if offer is None else list(offer))

    def _answer(self, frame: int, track: int, model: str, scores: list[float]) -> None:
        t = self.tracks.get(track)
        if t is None or (model == "cheap" and t.n_full):
            return  # gone, or the full model knows better
        t.n_full += model == "full"
        t.scores, t.last_prediction = list(scores), frame

    def _asked(self, frame: int) -> Iterator[tuple[int, str]]:
        c = self.cadence
        if self.next_cheap >= frame and self.next_full >= frame:
            return
        self.next_cheap += c.cheap_every
        if not self.active:
            return
        for k in sorted(self.active):
            t = self.tracks[k]
            if not t.n_full and (t.last_cheap is None or frame - t.last_cheap >= c.cheap_again):
                t.last_cheap = frame
                yield k, "cheap"
        if self.next_full > frame:
            return
        self.next_full += c.full_every
        ready, unlikely = [], []
        for k in sorted(self.active):
            t = self.tracks[k]
            if t.label == c.false_positive and t.share(c.false_positive) >= c.sure:
                unlikely.append((t.share(c.false_positive), k))
            elif t.last_full is None or frame - t.last_full >= (c.full_soon if t.n_full < 2 else c.full_again):
                ready.append((t.share(c.false_positive) - 1 if t.scores else 0.0, k))
        if ready or unlikely:
            k = min(ready or unlikely)[1]
            self.tracks[k].last_full = frame
            yield k, "full"

    def _told(self, frame: int, k: int, event: str, model: str | None = None) -> tuple:
        t = self.tracks[k]
        known = t.scores is not None
        return frame, k, event, model, t.label, float(t.share(t.label)) if known else None, [float(s / sum(t.scores)) for s in t.scores] if known else None, *t.box, t.last_prediction

    def _drop(self, frame: int, k: int) -> Iterator[tuple]:
        t = self.tracks[k]
        if t.told:
            yield self._told(frame, k, "end")
        elif not t.ever_told and t.seen < self.cadence.least_frames:
            yield self._told(frame, k, "filtered")
        del self.tracks[k]

    def close(self) -> Iterator[tuple]:
        """The open frame is whole."""
        frame, c = self.open, self.cadence
        for k in sorted(set(self.tracks) - set(self.active)):
            yield from self._drop(frame, k)
        for k in sorted(self.active):
            t = self.tracks.setdefault(k, Track())
            t.seen, t.box = t.seen + 1, self.active[k][0]
        for k, model in self._asked(frame):
            yield self._told(frame, k, "request", model)
            if self.active[k][1] is not None:
                self._answer(frame, k, model, self.active[k][1])
        for k in sorted(self.active):
            t = self.tracks[k]
            if t.scores is None:
                continue
            if t.label != c.false_positive:
                yield self._told(frame, k, "ongoing" if t.told else "start")
                t.told = t.ever_told = True
            elif t.told:
                yield self._told(frame, k, "end")
                t.told = False
        for track, model, scores in self.answers:
            self._answer(frame, track, model, scores)
        self.active, self.answers, self.open, self.closed = {}, [], None, frame

    def gone(self) -> Iterator[tuple]:
        """The clip is over."""
        if self.open is not None:
            last = self.open
            yield from self.close()
            for k in sorted(self.tracks):
                yield from self._drop(last, k)


def _whole(v: object) -> int | None:
    return None if v is None or v != v else int(v)


def plain_row(frame: object, track: object, *rest: object) -> tuple:
    """A row's values without what pandas makes of nulls."""
    *box, blank, offer, model, scores = rest
    return int(frame), _whole(track), *map(_whole, box), None if blank is None else bool(blank), offer, model if isinstance(model, str) else None, scores


def followed(rows: DataFrame, cadence: Cadence = Cadence()) -> DataFrame:
    """GIVES for rows (camera, ts and ROWS) of clips that are over; the camera's id tells clips apart."""

    def step(f: Follower, _: float, *values: object) -> Iterator[tuple]:
        return f.row(*plain_row(*values))

    return folded(rows, list(ROWS), GIVES, lambda: Follower(cadence), step, lambda f: f.gone())


def regions_as_rows(regions: DataFrame, offer: F.Column) -> DataFrame:
    """Regions (clip_id, track_id, frame_number and the box) as rows of active tracks, with what the models would say."""
    none = F.lit(None)
    box = [F.col(c).cast("boolean" if c == "blank" else "long").alias(c) for c in BOX]
    return regions.select(F.col("clip_id").alias("camera"), F.timestamp_seconds("frame_number").alias("ts"), "frame_number", "track_id", *box, offer.alias("offer"), none.cast("string").alias("model"), none.cast("array<double>").alias("scores"))
