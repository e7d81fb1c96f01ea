"""Boxes as columns: every function maps columns to a column, so all of it stays in generated code.

Boxes are four integer columns x0, y0, x1, y1; ratios are compared by cross-multiplication, so thresholds are exact.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{prefix}{k}") for k in ("x0", "y0", "x1", "y1"))


def aabb(xs: list[Column], ys: list[Column]) -> tuple[Column, Column, Column, Column]:
    """The smallest box around corners."""
    return F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)


def clamped_crop(b, width, height) -> tuple[Column, Column, Column, Column]:
    """(x, y, w, h) of the box cut to the page, one pixel wide and high at least."""
    x, y = (F.greatest(F.lit(0), F.least(v, F.lit(n) - 1)) for v, n in ((b[0], width), (b[1], height)))
    return x, y, F.greatest(F.lit(1), F.least(b[2], F.lit(width)) - x), F.greatest(F.lit(1), F.least(b[3], F.lit(height)) - y)


def area(b) -> Column:
    """Of the box without its far edges; 0 if it is turned inside out."""
    return F.greatest(F.lit(0), b[2] - b[0]).cast("long") * F.greatest(F.lit(0), b[3] - b[1])


def intersection(a, b) -> Column:
    """Area that two boxes share, far edges excluded."""
    return F.greatest(F.lit(0), F.least(a[2], b[2]) - F.greatest(a[0], b[0])).cast("long") * F.greatest(F.lit(0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))


def area_inclusive(b) -> Column:
    return F.greatest(F.lit(0), b[2] - b[0] + 1).cast("long") * F.greatest(F.lit(0), b[3] - b[1] + 1)


def intersection_inclusive(a, b) -> Column:
    """The same with far edges included."""
    return F.greatest(F.lit(0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]) + 1).cast("long") * F.greatest(F.lit(0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]) + 1)


def iou_at_least(shared: Column, area_a: Column, area_b: Column, percent) -> Column:
    return shared * 100 >= (area_a + area_b - shared) * percent


def centre_inside(line, region) -> Column:
    """P5: the centre in the closed box; sums in place of halves keep it in integers."""
    x, y = line[0] + line[2], line[1] + line[3]
    return (x >= 2 * region[0]) & (x <= 2 * region[2]) & (y >= 2 * region[1]) & (y <= 2 * region[3])


def is_vertical(b) -> Column:
    """At least half as high again as wide."""
    w, h = (b[2] - b[0]).cast("long"), (b[3] - b[1]).cast("long")
    return h * h >= F.floor(w * w * 225 / 100)


def is_horizontal(b) -> Column:
    """A4: three halves of the width make up the height."""
    return 3 * (b[2] - b[0]) >= 2 * (b[3] - b[1])


def overlap_small(a0, a1, b0, b1) -> tuple[Column, Column]:
    """P10: (shared length, shorter length) of two intervals."""
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0)), F.least(F.greatest(F.lit(0), a1 - a0), F.greatest(F.lit(0), b1 - b0))


def edge_distance(a, b) -> Column:
    """Squared distance of the nearest edges; 0 if boxes overlap on both axes."""
    dx = F.greatest(F.lit(0), a[0] - b[2], b[0] - a[2]).cast("long")
    dy = F.greatest(F.lit(0), a[1] - b[3], b[1] - a[3]).cast("long")
    return dx * dx + dy * dy


def manhattan(a, b) -> Column:
    """Of the near corners."""
    return F.abs(a[0] - b[0]) + F.abs(a[1] - b[1])


def points_to_pixels(value: Column, dpi: int) -> Column:
    """Halves round away from zero."""
    return F.round(value * dpi / 72).cast("int")


def snap(width: Column, buckets: tuple[int, ...]) -> Column:
    """The least bucket that holds the width, or the last one."""
    found = F.lit(buckets[-1])
    for limit in reversed(buckets):
        found = F.when(width <= limit, F.lit(limit)).otherwise(found)
    return found


def detector_side(value: Column, scale: Column) -> Column:
    """Scaled side in whole 32s, 32 at least."""
    return F.greatest(F.lit(32), (F.round(value * scale / 32) * 32).cast("int"))
