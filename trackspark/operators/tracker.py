"""Steps that depend on their own past, as small pure functions used by grouped maps and by streams.

A group is one clip.  A camera's history has no bound: it is folded in order of time, batch by batch, and only
the small state of the step is kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby, islice
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGNED = "clip_id long, frame_number long, region_id long, online_track long, created boolean, blank boolean, x long, y long, width long, height long, mass long"
#: What a region of a frame must tell, besides clip_id and frame_number.
REGION = ("region_id", "x", "y", "width", "height", "mass", "pixel_variance", "along_border")


@dataclass(frozen=True)
class Settings:
    """Limits of the tracker.  Distances are squared pixels, as boxes are compared by squared distance."""

    base_distance: float = 450.0
    base_velocity: float = 2.0
    velocity_multiplier: float = 2.0
    mass_share: float = 0.55
    least_mass_change: float = 20.0
    mass_after_frames: float = 13.5  # a second and a half of nine frames
    predict_after: int = 18  # frames with a region before the prediction is heeded
    max_blanks: int = 18
    least_variance: float = 2.0
    least_mass: float = 4.0
    max_overlap: float = 0.25


def distance(a: tuple, b: tuple) -> float:
    """Mean of the squared distances of the top left and the bottom right corners of two boxes (x, y, w, h)."""
    return ((b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2 + (b[0] + b[2] - a[0] - a[2]) ** 2 + (b[1] + b[3] - a[1] - a[3]) ** 2) / 2


def overlap_share(a: tuple, b: tuple) -> float:
    wide = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
    tall = max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    return wide * tall / max(1, a[2] * a[3])


def greedy(pairs: list[tuple]) -> list[tuple]:
    """One-to-one choice from (score, age, left, right), lowest score first, then age and ids."""
    used_left, used_right, out = set(), set(), []
    for score, age, left, right in sorted(pairs):
        if left not in used_left and right not in used_right:
            used_left.add(left)
            used_right.add(right)
            out.append((left, right))
    return out


class Motion:
    """Constant-velocity filter of a box's middle.  Both axes have one covariance: of position, both, and velocity."""

    def __init__(self, x: float, y: float, noise: float = 0.03) -> None:
        self.x, self.y, self.vx, self.vy = float(x), float(y), 0.0, 0.0
        self.noise, self.cov = noise, (1.0, 0.0, 1.0)

    def predict(self) -> tuple[float, float]:
        self.x, self.y = self.x + self.vx, self.y + self.vy
        p, c, v = self.cov
        self.cov = (p + 2 * c + v + self.noise, c + v, v + self.noise)
        return self.x, self.y

    def correct(self, x: float, y: float) -> None:
        p, c, v = self.cov
        at, speed = p / (p + 1), c / (p + 1)
        dx, dy = x - self.x, y - self.y
        self.x, self.y, self.vx, self.vy = self.x + at * dx, self.y + at * dy, self.vx + speed * dx, self.vy + speed * dy
        self.cov = (p - at * p, c - at * c, v - speed * c)


class Track:
    """An active track: its last box, how long it has been unseen, its recent sizes, and where it should go next."""

    def __init__(self, number: int, region: tuple) -> None:
        _, x, y, w, h = region[:5]
        self.number, self.frames, self.blanks, self.unseen = number, 0, 0, 0
        self.velocity, self.sizes = (0.0, 0.0), []
        self.motion = Motion(x + w / 2, y + h / 2)
        self.box = None
        self.add(region)

    def _move(self, box: tuple, middle: tuple[float, float]) -> None:
        if self.box is not None:
            self.velocity = (middle[0] - self.middle[0], middle[1] - self.middle[1])
        self.box, self.middle = box, middle
        self.frames += 1

    def add(self, region: tuple) -> None:
        _, x, y, w, h, mass, _, border = region
        self._move((x, y, w, h), (x + w / 2, y + h / 2))
        self.unseen, self.border, self.mass = 0, border, mass
        self.sizes = [*self.sizes[-4:], (w * h, mass)]
        self.motion.correct(*self.middle)
        self.predicted = self.motion.predict()

    def blank(self, settings: Settings) -> bool:
        """A frame without a region: a blank one where the track should be; whether the track goes on."""
        _, _, w, h = self.box
        if self.frames - settings.predict_after - 2 * self.unseen > 0:
            self._move((int(self.predicted[0] - w / 2), int(self.predicted[1] - h / 2), w, h), self.predicted)
        else:
            self._move(self.box, self.middle)
        self.blanks, self.unseen, self.mass = self.blanks + 1, self.unseen + 1, 0
        self.predicted = self.motion.predict()
        return self.unseen < min(2 * (self.frames - self.unseen), settings.max_blanks)

    def reach(self, settings: Settings) -> float:
        """How far the next region may be."""
        vx, vy = (settings.base_velocity,) * 2 if self.frames == 1 else self.velocity
        by_velocity = (vx * vx + vy * vy) * settings.velocity_multiplier**2
        ahead = 0.0
        if self.frames - self.blanks > settings.predict_after:
            ahead = (self.predicted[0] - self.middle[0]) ** 2 + (self.predicted[1] - self.middle[1]) ** 2
        return settings.base_distance + max(by_velocity, ahead)

    def fits(self, region: tuple, settings: Settings) -> bool:
        """Whether mass and area of a region are near enough to the means of the last five."""
        _, _, _, w, h, mass, _, border = region
        area, mean = (sum(s[k] for s in self.sizes) / len(self.sizes) for k in (0, 1))
        speed = abs(self.velocity[0]) + abs(self.velocity[1])
        if self.frames > settings.mass_after_frames:
            share = settings.mass_share + (0.1 if speed > 5 else 0.0)
            if abs(mean - mass) > max(settings.least_mass_change, mean * share):
                return False
        if border != self.border:
            limit = 6.0 if speed > 10 else 2.0
        else:
            limit = (2.0 if self.frames < 5 else 1.5) * (2 if speed > 10 else 1)
        return abs(w * h - area) / (area + 50) <= limit


def track_step(state: dict, regions: list[tuple], settings: Settings = Settings()) -> list[tuple]:
    """Advance the tracks of a clip by one frame; gives (region id or None, track, created, blank, x, y, w, h, mass).

    state: next number and active tracks; regions: tuples of REGION.  The nearest pairs within reach are
    matched first.  A matched region that is only noise blanks its track and is used up.  Unmatched
    tracks get a blank and retire after too many; unmatched regions start a track unless they lie over an active one."""
    active: dict[int, Track] = state["active"]
    of = {r[0]: r for r in regions}
    pairs = []
    for number, t in active.items():
        limit = t.reach(settings)
        for i, r in of.items():
            if (d := distance(t.box, r[1:5])) <= limit and t.fits(r, settings):
                pairs.append((d, t.unseen, number, i))
    out, matched = [], set()
    noise = lambda r: r[6] < settings.least_variance or r[5] < settings.least_mass
    for number, i in greedy(pairs):
        r = of.pop(i)
        if not noise(r):
            active[number].add(r)
            matched.add(number)
            out.append((i, number, False, False, *r[1:6]))
    for number in [n for n in active if n not in matched]:
        t = active[number]
        goes_on = t.blank(settings)
        out.append((None, number, False, True, *t.box, 0))
        if not goes_on:
            del active[number]
    for i, r in sorted(of.items()):
        if all(overlap_share(r[1:5], t.box) <= settings.max_overlap for t in active.values()):
            number = state["next"]
            state["next"] += 1
            active[number] = Track(number, r)
            out.append((i, number, True, False, *r[1:6]))
    return out


def fresh_state() -> dict:
    return {"next": 1, "active": {}}


def track_frames(state: dict, rows: pd.DataFrame, settings: Settings = Settings()) -> Iterator[tuple]:
    """Rows of ASSIGNED without the clip, for the frames of ``rows`` in order.  A calibrating frame ends all tracks."""
    rows = rows.sort_values(["frame_number", "region_id"])
    frames = rows["frame_number"].to_numpy()
    columns = [rows[c].tolist() for c in REGION]
    calibrating = rows["calibrating"].tolist() if "calibrating" in rows else [False] * len(rows)
    regions = list(zip(*columns, strict=True))
    bounds = np.flatnonzero(np.diff(frames, prepend=frames[0] - 1, append=frames[-1] + 1)) if len(frames) else []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if any(calibrating[a:b]):
            state["active"].clear()
            continue
        for region, *rest in track_step(state, regions[a:b], settings):
            yield (int(frames[a]), region, *rest)


def assigned(clip, rows: pd.DataFrame, state: dict | None = None) -> pd.DataFrame:
    found = list(track_frames(fresh_state() if state is None else state, rows))
    columns = [c.split()[0] for c in ASSIGNED.split(", ")][1:]
    out = pd.DataFrame(found, columns=columns)
    out["region_id"] = out["region_id"].astype("Int64")
    out.insert(0, "clip_id", clip)
    return out


def assign(regions: DataFrame) -> DataFrame:
    """Online tracks of each clip's regions, frame by frame, with the blank frames of tracks (region_id null).

    regions: clip_id, frame_number, REGION, and calibrating where frames may end all tracks."""
    return regions.groupBy("clip_id").applyInPandas(lambda rows: assigned(rows["clip_id"].iloc[0], rows), ASSIGNED)


def match_expected(candidates: DataFrame) -> DataFrame:
    """One-to-one matches from clip_id, expected_id, track_id, start_s, score: each expected track, in
    order of its start, takes the best generated track left."""

    def clip(rows: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for e, part in rows.sort_values(["start_s", "expected_id", "score", "track_id"]).groupby(["start_s", "expected_id"], sort=True):
            free = part[~part["track_id"].isin(taken)]
            if len(free):
                best = free.iloc[0]
                taken.add(best["track_id"])
                out.append((best["clip_id"], best["expected_id"], best["track_id"]))
        return pd.DataFrame(out, columns=["clip_id", "expected_id", "track_id"])

    return candidates.groupBy("clip_id").applyInPandas(clip, "clip_id long, expected_id long, track_id long")


def heaviest_windows(windows: DataFrame, width: int) -> DataFrame:
    """track_id, frame_number, total of the windows that stay when the heaviest are taken first and starts
    within two thirds of the width of one taken are dropped."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        kept: list[int] = []
        for f in rows.sort_values(["total", "frame_number"], ascending=[False, True])["frame_number"]:
            if all(abs(f - k) >= width * 2 / 3 for k in kept):
                kept.append(f)
        return rows[rows["frame_number"].isin(kept)][["track_id", "frame_number", "total"]]

    return windows.groupBy("track_id").applyInPandas(one, "track_id long, frame_number long, total long")


def masked_segments(frames: DataFrame, width: int, seed: int) -> DataFrame:
    """Segments of ``width`` frames of a track; each hides one stretch of frames and draws from the rest
    without repeating a frame of an earlier segment.  Tracks of under 40 frames hide nothing."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, int(rows["track_id"].iloc[0])])
        left, out, s = np.sort(rows["frame_number"].to_numpy()), [], 0
        hide = len(left) // 4 if len(left) >= 40 else 0
        while len(left) >= max(1, width // 2) or not s:
            shown = left
            if hide and len(left) > hide + width // 2:
                at = int(rng.integers(0, len(left) - hide + 1))
                shown = np.delete(left, np.arange(at, at + hide))
            chosen = np.sort(rng.choice(shown, min(width, len(shown)), replace=False))
            out += [(int(rows["track_id"].iloc[0]), s, int(f)) for f in chosen]
            left = np.setdiff1d(left, chosen)
            s += 1
        return pd.DataFrame(out, columns=["track_id", "segment", "frame_number"])

    return frames.groupBy("track_id").applyInPandas(one, "track_id long, segment long, frame_number long")


BOXES = "clip_id long, frame_number long, x long, y long, width long, height long, mass long"


def united(boxes: Iterable[tuple], max_gap: float) -> list[tuple]:
    """Boxes (x, y, width, height, mass) that overlap or lie within a gap, united until nothing changes; masses are summed.

    A box without a place or a size stays by itself; a mass that is not known adds nothing."""
    whole, out = [], []
    for b in boxes:
        (out if None in b[:4] else whole).append(b)
    changed = len(whole) > 1
    while changed:
        changed = False
        for i in range(len(whole)):
            for j in range(len(whole) - 1, i, -1):
                a, b = whole[i], whole[j]
                dx = max(0, max(a[0], b[0]) - min(a[0] + a[2], b[0] + b[2]))
                dy = max(0, max(a[1], b[1]) - min(a[1] + a[3], b[1] + b[3]))
                if (dx * dx + dy * dy) ** 0.5 <= max_gap:
                    x, y = min(a[0], b[0]), min(a[1], b[1])
                    whole[i] = (x, y, max(a[0] + a[2], b[0] + b[2]) - x, max(a[1] + a[3], b[1] + b[3]) - y, (a[4] or 0) + (b[4] or 0))
                    del whole[j]
                    changed = True
    return whole + out


def merge_boxes(boxes: pd.DataFrame, max_gap: float) -> pd.DataFrame:
    """The united boxes of one frame."""
    items = boxes[["x", "y", "width", "height", "mass"]].itertuples(index=False, name=None)
    key = boxes[["clip_id", "frame_number"]].iloc[0]
    return pd.DataFrame([(int(key.iloc[0]), int(key.iloc[1]), *map(int, i)) for i in united(items, max_gap)], columns=[c.split()[0] for c in BOXES.split(", ")])


def merge_components(regions: DataFrame, max_gap: float = 10.0) -> DataFrame:
    """The united boxes of every frame.  Frames hold few boxes, so they come as a sorted stream, many to a batch."""
    names = [c.split()[0] for c in BOXES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        found = ((*key, *b) for key, part in groupby(rows, itemgetter(0, 1)) for b in united(map(itemgetter(2, 3, 4, 5, 6), part), max_gap))
        while some := list(islice(found, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*some, strict=True)], names)

    rows = regions.select(*[F.col(c).cast("long").alias(c) for c in names])
    return rows.repartition("clip_id", "frame_number").sortWithinPartitions("clip_id", "frame_number").mapInArrow(run, BOXES)


class Bucket:
    """Token bucket of a recorder: frames cost tokens, quiet seconds earn them back.

    Recording needs tokens; without any it is throttled until ``no_motion`` quiet seconds have passed.
    After ``max_throttle`` seconds of throttling, ``free`` tokens are given."""

    def __init__(self, tokens: float = 60.0, fps: float = 9.0, no_motion: float = 10.0, max_throttle: float = 100.0, free: float = 20.0) -> None:
        self.size, self.fps, self.no_motion, self.max_throttle, self.free = tokens, fps, no_motion, max_throttle, free
        self.tokens, self.throttled_at, self.last_motion = tokens, None, None

    def step(self, t: float, motion: bool) -> bool:
        """Whether the frame at ``t`` seconds is recorded."""
        if not motion:
            return False
        quiet = 0.0 if self.last_motion is None else t - self.last_motion
        self.last_motion = t
        if quiet > 1:
            self.tokens = min(self.size, self.tokens + quiet * self.fps)
        if self.throttled_at is not None:
            if quiet >= self.no_motion and self.tokens > 0:
                self.throttled_at = None
            elif t - self.throttled_at >= self.max_throttle:
                self.throttled_at, self.tokens = None, self.tokens + self.free
            else:
                return False
        if self.tokens <= 0:
            self.throttled_at = t
            return False
        self.tokens -= 1
        return True


class Hysteresis:
    """A counter up to ``high``: on from ``on`` upwards, off when it is back at 0."""

    def __init__(self, high: int = 30, on: int = 2) -> None:
        self.high, self.on, self.n, self.moving = high, on, 0, False

    def step(self, hit: bool) -> bool:
        self.n = min(self.high, self.n + 1) if hit else max(0, self.n - 1)
        self.moving = self.n >= self.on or (self.moving and self.n > 0)
        return self.moving


def hysteresis(hits: Iterator[bool], high: int = 30, on: int = 2) -> Iterator[bool]:
    counter = Hysteresis(high, on)
    for hit in hits:
        yield counter.step(hit)


# --- steps of a camera: called with the seconds and the fields of each frame in order of time -------------


class Throttle(Bucket):
    columns = ("motion",)
    gives = "flag boolean"

    def __call__(self, t: float, motion: bool) -> tuple:
        return (self.step(t, bool(motion)),)


class Moving(Hysteresis):
    """Motion with hysteresis; the background is that of the last frame without motion, frozen while there is some."""

    columns = ("event_id", "motion")
    gives = "flag boolean, background long"

    def __init__(self, high: int = 30, on: int = 2) -> None:
        super().__init__(high, on)
        self.background = None

    def __call__(self, _: float, event_id: int, motion: bool) -> tuple:
        moving = self.step(bool(motion))
        if not moving:
            self.background = event_id
        return moving, self.background


class RingBuffer:
    """The last frames: the oldest, once there are enough, and the oldest since the last calibration."""

    columns = ("event_id", "ffc")
    gives = "oldest long, oldest_since_ffc long"

    def __init__(self, size: int = 10) -> None:
        self.size, self.frames, self.since = size, [], []

    def __call__(self, _: float, event_id: int, ffc: bool) -> tuple:
        self.frames = [*self.frames, event_id][-self.size :]
        self.since = [event_id] if ffc else [*self.since, event_id][-self.size :]
        return self.frames[0] if len(self.frames) == self.size else None, self.since[0]


class Detector:
    """Motion: the changed pixels exceed the mean of the frames before by a margin, twice running, after a warm-up."""

    columns = ("changed", "ffc")
    gives = "detected boolean"

    def __init__(self, window: int = 10, margin: float = 5.0, warm_up: int = 20) -> None:
        self.window, self.margin, self.warm_up, self.recent, self.n, self.run = window, margin, warm_up, [], 0, 0

    def __call__(self, _: float, changed: int, ffc: bool) -> tuple:
        self.n += 1
        hit = bool(self.recent) and changed > sum(self.recent) / len(self.recent) + self.margin and not ffc and self.n > self.warm_up
        self.run = self.run + 1 if hit else 0
        self.recent = [*self.recent, changed][-self.window :]
        return (self.run >= 2,)


class Cadence:
    """Which model a frame is sent to: the full one every 25 frames, the cheap one every 10, else none."""

    columns = ()
    gives = "model string"

    def __init__(self, full: int = 25, cheap: int = 10) -> None:
        self.full, self.cheap, self.n = full, cheap, 0

    def __call__(self, _: float) -> tuple | None:
        self.n += 1
        return ("full",) if self.n % self.full == 0 else ("cheap",) if self.n % self.cheap == 0 else None


#: kind -> what makes the step's state at the start.
STEPS = {"throttle": Throttle, "ir": lambda: Moving(30, 2), "simple": lambda: Moving(2, 1), "ring": RingBuffer, "detector": Detector, "cadence": Cadence}


def seconds(ts: pd.Series) -> np.ndarray:
    return ts.astype("datetime64[us]").astype("int64").to_numpy() / 1e6


def needs(kind: str) -> list[str]:
    return list(dict.fromkeys(["camera", "ts", "event_id", *STEPS[kind]().columns]))


def gives(kind: str) -> str:
    return f"event_id long, {STEPS[kind]().gives}"


def stepped(step, rows: pd.DataFrame) -> list[tuple]:
    """(event_id, what the step gives) of rows of one camera, in order."""
    fields = [rows[c].tolist() for c in step.columns]
    out = [(e, step(t, *f)) for e, t, *f in zip(rows["event_id"].tolist(), seconds(rows["ts"]), *fields, strict=True)]
    return [(e, *f) for e, f in out if f is not None]


def per_camera(frames: DataFrame, kind: str) -> DataFrame:
    """Batch twin of the stream steps: event_id and the step's result, camera by camera in order of time.

    A camera's history is folded batch by batch; only the small state of the step is kept."""
    names = [c.split()[0] for c in gives(kind).split(", ")]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        camera, step = object(), None
        for rows in batches:
            found = []
            keys = rows["camera"].astype(object).where(rows["camera"].notna(), None)
            for _, part in rows.groupby((keys != keys.shift()).cumsum(), sort=False):
                c = keys.loc[part.index[0]]
                if c != camera:
                    camera, step = c, STEPS[kind]()
                found += stepped(step, part)
            yield pd.DataFrame(found, columns=names)

    rows = frames.select(*[F.col(c).cast("timestamp").alias(c) if c == "ts" else c for c in needs(kind)])
    ordered = rows.repartition("camera").sortWithinPartitions("camera", F.asc_nulls_last("ts"), F.asc_nulls_last("event_id"))
    return ordered.mapInPandas(fold, gives(kind))
