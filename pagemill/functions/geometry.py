"""Column functions on boxes, which are four double columns x, y, w, h (or a name prefix for each)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-9


@dataclass(frozen=True)
class Box:
    x: Column
    y: Column
    w: Column
    h: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*(F.col(f"{prefix}{c}") for c in "xywh"))

    @property
    def right(self) -> Column:
        return self.x + self.w

    @property
    def bottom(self) -> Column:
        return self.y + self.h

    @property
    def middle_x(self) -> Column:
        return self.x + self.w / 2

    @property
    def middle_y(self) -> Column:
        return self.y + self.h / 2

    @property
    def area(self) -> Column:
        return self.w * self.h

    @property
    def empty(self) -> Column:
        return (self.w <= 0) | (self.h <= 0)

    def contains(self, px: Column, py: Column) -> Column:
        """Edges count as inside."""
        return px.between(self.x, self.right) & py.between(self.y, self.bottom)

    def inflated(self, by: Column | float) -> Box:
        by = by if isinstance(by, Column) else F.lit(by)
        return Box(self.x - by, self.y - by, self.w + 2 * by, self.h + 2 * by)

    def distance(self, px: Column, py: Column) -> Column:
        """Of a point to the box; 0 inside."""
        dx = F.greatest(self.x - px, px - self.right, F.lit(0.0))
        dy = F.greatest(self.y - py, py - self.bottom, F.lit(0.0))
        return F.sqrt(dx * dx + dy * dy)

    def overlap(self, other: Box) -> Column:
        """Shared area over the smaller area, the latter at least 1."""
        w = F.greatest(F.least(self.right, other.right) - F.greatest(self.x, other.x), F.lit(0.0))
        h = F.greatest(F.least(self.bottom, other.bottom) - F.greatest(self.y, other.y), F.lit(0.0))
        return w * h / F.greatest(F.least(self.area, other.area), F.lit(1.0))

    def union(self, other: Box) -> Box:
        x, y = F.least(self.x, other.x), F.least(self.y, other.y)
        return Box(x, y, F.greatest(self.right, other.right) - x, F.greatest(self.bottom, other.bottom) - y)

    def scaled(self, sx: Column, sy: Column, dx: Column | float = 0.0, dy: Column | float = 0.0) -> Box:
        """Divided by a scale (never by zero), after a shift: pixels to device-independent units."""
        sx, sy = F.greatest(sx, F.lit(EPSILON)), F.greatest(sy, F.lit(EPSILON))
        return Box((self.x - dx) / sx, (self.y - dy) / sy, self.w / sx, self.h / sy)

    def columns(self, prefix: str = "") -> list[Column]:
        return [c.alias(f"{prefix}{n}") for n, c in zip("xywh", (self.x, self.y, self.w, self.h), strict=True)]


def pixel_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, sx: Column, sy: Column) -> list[Column]:
    """Two corners in device-independent units as a whole-pixel box inside a container: outer edges, clamped."""
    clamp = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), top)
    left, top = F.floor(clamp(F.least(x1, x2), width) * sx), F.floor(clamp(F.least(y1, y2), height) * sy)
    right, bottom = F.ceil(clamp(F.greatest(x1, x2), width) * sx), F.ceil(clamp(F.greatest(y1, y2), height) * sy)
    return [left.cast("int").alias("px"), top.cast("int").alias("py"), (right - left).cast("int").alias("pw"), (bottom - top).cast("int").alias("ph")]


def fit_zoom(view_w: Column, view_h: Column, image_w: Column, image_h: Column) -> Column:
    """The zoom at which an image just fits; 1 for empty images or views."""
    usable = (view_w > 0) & (view_h > 0) & (image_w > 0) & (image_h > 0)
    return F.when(usable, F.least(view_w / image_w, view_h / image_h)).otherwise(F.lit(1.0))


def to_view(px: Column, zoom: Column, pan: Column) -> Column:
    return px * zoom + pan


def to_image(vx: Column, zoom: Column, pan: Column) -> Column:
    return (vx - pan) / F.greatest(zoom, F.lit(EPSILON))


def zoomed_pan(anchor: Column, zoom: Column, pan: Column, factor: Column, least: float = 0.05, most: float = 20.0) -> tuple[Column, Column]:
    """(zoom, pan) after zooming by ``factor`` with the image point under ``anchor`` kept in place."""
    after = F.least(F.greatest(zoom * factor, F.lit(least)), F.lit(most))
    return after, anchor - to_image(anchor, zoom, pan) * after


def drag_intent(dx: Column, dy: Column, over_text: Column, panning: Column, threshold: float = 4.0) -> Column:
    """click below the threshold; beyond it pan with the pan key or off text, else select."""
    return F.when(F.sqrt(dx * dx + dy * dy) < threshold, "click").when(panning | ~over_text, "pan").otherwise("select")


def large_enough(w: Column, h: Column, least: int = 8) -> Column:
    """Whether a selected region is no slip of the hand."""
    return (w >= least) & (h >= least)
