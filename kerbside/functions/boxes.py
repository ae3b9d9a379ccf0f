"""Box algebra on columns; boxes are x1, y1, x2, y2 in pixels unless said otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGES = ("x1", "y1", "x2", "y2")


def columns(prefix: str = "") -> list[Column]:
    return [F.col(prefix + e) for e in EDGES]


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.least(F.greatest(x, as_col(low)), as_col(high))


def finite(x: Column) -> Column:
    """The number, or null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def from_xywh(x: Column, y: Column, w: Column, h: Column) -> list[Column]:
    return [x, y, x + w, y + h]


def to_xywh(box: Sequence[Column]) -> list[Column]:
    return [box[0], box[1], box[2] - box[0], box[3] - box[1]]


def to_normalised(box: Sequence[Column], width: Column | float, height: Column | float) -> list[Column]:
    """Centre and size as fractions of the image."""
    return [(box[0] + box[2]) / 2 / width, (box[1] + box[3]) / 2 / height, (box[2] - box[0]) / width, (box[3] - box[1]) / height]


def from_normalised(c: Sequence[Column], width: Column | float, height: Column | float) -> list[Column]:
    return [(c[0] - c[2] / 2) * width, (c[1] - c[3] / 2) * height, (c[0] + c[2] / 2) * width, (c[1] + c[3] / 2) * height]


def scaled(box: Sequence[Column], s: Column | float) -> list[Column]:
    return [e * s for e in box]


def clipped(box: Sequence[Column], width: Column | float, height: Column | float) -> list[Column]:
    """Every edge into the pixels of the image."""
    return [clamp(box[0], 0.0, width - 1), clamp(box[1], 0.0, height - 1), clamp(box[2], 0.0, width - 1), clamp(box[3], 0.0, height - 1)]


def shrink_factor(width: Column, height: Column, max_side: float) -> Column:
    """Factor by which an image has to shrink to fit; never above 1."""
    return F.least(F.lit(1.0), F.lit(float(max_side)) / F.greatest(width, height))


def at_least(box: Sequence[Column], side: float) -> Column:
    return (box[2] - box[0] >= side) & (box[3] - box[1] >= side)


def centre(box: Sequence[Column]) -> tuple[Column, Column]:
    return (box[0] + box[2]) / 2, (box[1] + box[3]) / 2


def area(box: Sequence[Column]) -> Column:
    return (box[2] - box[0]) * (box[3] - box[1])


def intersection(a: Sequence[Column], b: Sequence[Column]) -> Column:
    wide = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    high = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))


def iou(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Intersection over union, 0 where the union has no area."""
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def iou_floored(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Intersection over a union of 1e-6 at least, in single precision."""
    both = intersection(a, b)
    return (both / F.greatest(area(a) + area(b) - both, F.lit(1e-6))).cast("float")


def overlaps(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return ~((a[2] < b[0]) | (b[2] < a[0]) | (a[3] < b[1]) | (b[3] < a[1]))


def size_band(pixels: Column) -> Column:
    """small, medium or large by area, cut at 32 and 96 pixels square."""
    return F.when(pixels < 32.0**2, "small").when(pixels < 96.0**2, "medium").otherwise("large")


def letterbox(width: Column, height: Column, side: int = 640) -> tuple[Column, Column, Column]:
    """Scale, left and top padding that put an image into a square."""
    r = F.least(F.lit(float(side)) / height, F.lit(float(side)) / width)
    pad = lambda n: F.bround((F.lit(side) - F.bround(n * r, 0)) / 2 - 0.1, 0)
    return r, pad(width), pad(height)


def undo_letterbox(box: Sequence[Column], r: Column, left: Column, top: Column, width: Column, height: Column) -> list[Column]:
    back = [(box[0] - left) / r, (box[1] - top) / r, (box[2] - left) / r, (box[3] - top) / r]
    return clipped(back, width, height)
