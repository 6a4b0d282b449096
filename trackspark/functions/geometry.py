"""Boxes as Column expressions: four columns in, columns out, no Python on the executors."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    """Left, top, width and height."""

    x: Column
    y: Column
    w: Column
    h: Column

    @property
    def right(self) -> Column:
        return self.x + self.w

    @property
    def bottom(self) -> Column:
        return self.y + self.h

    @property
    def mid_x(self) -> Column:
        return self.x + self.w / 2

    @property
    def mid_y(self) -> Column:
        return self.y + self.h / 2

    @property
    def area(self) -> Column:
        return self.w.cast("long") * self.h


def box(prefix: str = "") -> Box:
    return Box(*(F.col(prefix + c) for c in ("x", "y", "width", "height")))


def fixed(x: float, y: float, w: float, h: float) -> Box:
    return Box(F.lit(x), F.lit(y), F.lit(w), F.lit(h))


def from_edges(left: Column, top: Column, right: Column, bottom: Column) -> Box:
    return Box(left, top, right - left, bottom - top)


def columns(b: Box, prefix: str = "") -> list[Column]:
    return [c.alias(prefix + n) for c, n in zip(b, ("x", "y", "width", "height"), strict=True)]


def clamp(c: Column, low, high) -> Column:
    return F.greatest(F.least(c, high if isinstance(high, Column) else F.lit(high)), low if isinstance(low, Column) else F.lit(low))


def decoded(left: Column, top: Column, right: Column, bottom: Column) -> Box:
    """From stored edges; sizes are never negative."""
    return Box(left, top, F.greatest(F.lit(0), right - left), F.greatest(F.lit(0), bottom - top))


def elongation(b: Box) -> Column:
    return F.greatest(b.w, b.h) / F.least(b.w, b.h)


def overlap_area(a: Box, b: Box) -> Column:
    wide = F.greatest(F.lit(0), F.least(a.right, b.right) - F.greatest(a.x, b.x))
    tall = F.greatest(F.lit(0), F.least(a.bottom, b.bottom) - F.greatest(a.y, b.y))
    return wide * tall


def crop(b: Box, bounds: Box) -> Box:
    """Cut to bounds.  A box wholly outside keeps zero or the far edge, edge by edge."""
    left = F.least(bounds.right, F.greatest(b.x, bounds.x))
    top = F.least(bounds.bottom, F.greatest(b.y, bounds.y))
    right = F.greatest(bounds.x, F.least(b.right, bounds.right))
    bottom = F.greatest(bounds.y, F.least(b.bottom, bounds.bottom))
    return from_edges(left, top, right, bottom)


def grown(b: Box, dx, dy) -> Box:
    return Box(b.x - dx, b.y - dy, b.w + 2 * dx, b.h + 2 * dy)


def enlarge(b: Box, border: int, bounds: Box) -> Box:
    return crop(grown(b, border, border), bounds)


def enlarge_even(b: Box, dx, dy, bounds: Box) -> Box:
    """Grow both sides alike; what spills over one edge of bounds comes off both."""
    g = grown(b, dx, dy)
    spill_x = F.greatest(clamp(bounds.x - g.x, 0, bounds.w), clamp(g.right - bounds.right, 0, bounds.w))
    spill_y = F.greatest(clamp(bounds.y - g.y, 0, bounds.h), clamp(g.bottom - bounds.bottom, 0, bounds.h))
    return Box(g.x + spill_x, g.y + spill_y, g.w - 2 * spill_x, g.h - 2 * spill_y)


def enlarge_for_rotation(b: Box, bounds: Box, final: int = 32, extra: int = 13) -> Box:
    """Grow to a square with room for turning, for a picture of ``final`` pixels."""
    more = extra / F.least(final / b.w, final / b.h)
    longer = F.abs(b.w - b.h)
    dx = F.when(b.w > b.h, F.ceil(more / 2)).otherwise(F.ceil((more + longer) / 2))
    dy = F.when(b.w > b.h, F.ceil((more + longer) / 2)).otherwise(F.ceil(more / 2))
    return enlarge_even(b, dx, dy, bounds)


def holds_point(b: Box, x: Column, y: Column) -> Column:
    """Point in a box on a map, whose top is the larger latitude."""
    return (b.x <= x) & (b.right >= x) & (b.y >= y) & (b.bottom <= y)


def moved(now: Box, before: Box) -> Column:
    """Shifted, not only grown, along an axis."""
    return ((now.x != before.x) & (now.right != before.right)) | ((now.y != before.y) & (now.bottom != before.bottom))


def along_border(b: Box, bounds: Box, edge: int = 0, was_cropped: Column | None = None) -> Column:
    """Right and bottom compare with the width and height of bounds, as the stored data were made."""
    near = (b.x <= bounds.x + edge) | (b.y <= bounds.y + edge) | (b.right >= bounds.w - edge) | (b.bottom >= bounds.h - edge)
    return near if was_cropped is None else was_cropped | near


def corner_distances(a: Box, b: Box) -> tuple[Column, Column, Column]:
    """Squared distances of top left corners, middles (the other one truncated) and bottom right corners."""
    sq = lambda dx, dy: dx * dx + dy * dy
    whole = lambda c: c.cast("long")
    return (
        sq(whole(b.x) - a.x, whole(b.y) - a.y),
        sq(whole(b.mid_x) - a.mid_x, whole(b.mid_y) - a.mid_y),
        sq(b.right - a.right, b.bottom - a.bottom),
    )


def rescaled(b: Box, factor: float) -> Box:
    return Box(*((c * factor).cast("long") for c in b))


def cropped_share(b: Box, width: int, height: int) -> Column:
    """Share of the square around a box that lies outside the picture."""
    side = F.greatest(b.w, b.h)
    square = Box(b.mid_x - side / 2, b.mid_y - side / 2, side, side)
    return 1 - overlap_area(fixed(0, 0, width - 1, height - 1), square) / square.area


def gap(a: Box, b: Box) -> Column:
    """Distance between two boxes; an axis on which they overlap counts nothing."""

    def axis(p, lp, q, lq):
        overlap = lp + lq > F.greatest(p + lp, q + lq) - F.least(p, q)
        return F.when(overlap, F.lit(0)).when(p < q, q - p - lp).otherwise(p - q - lq)

    dx, dy = axis(a.x, a.w, b.x, b.w), axis(a.y, a.h, b.y, b.h)
    return F.sqrt((dx * dx + dy * dy).cast("double"))


class Line(NamedTuple):
    """y = slope * x + offset."""

    slope: float
    offset: float

    def above(self, x: Column, y: Column) -> Column:
        return y > x * self.slope + self.offset

    def below(self, x: Column, y: Column) -> Column:
        return ~self.above(x, y)

    def left(self, x: Column, y: Column) -> Column:
        return x < (y - self.offset) / self.slope

    def right(self, x: Column, y: Column) -> Column:
        return ~self.left(x, y)


def size_change(area: Column, current: Column, padding: int = 50) -> Column:
    return F.abs(area - current) / (current + padding)


def fit_inside(b: Box, bounds: Box) -> Box:
    """Shift a box, keeping its size, so that it lies inside bounds (the far edge wins)."""
    x = F.greatest(b.x, bounds.x)
    y = F.greatest(b.y, bounds.y)
    return Box(F.when(x + b.w > bounds.right, bounds.right - b.w).otherwise(x), F.when(y + b.h > bounds.bottom, bounds.bottom - b.h).otherwise(y), b.w, b.h)
