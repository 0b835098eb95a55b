"""Boxes as (top, left, bottom, right) on a 0..1000 grid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Margin that halves the area of the box.
TIGHT = -(1 - 2**-0.5) / 2


def clamp(x: Column, top: int = 1000) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(top), x))


def valid_box(t: Column, left: Column, b: Column, r: Column) -> Column:
    """The clamped box as a struct, null where it is degenerate."""
    t, left, b, r = map(clamp, (t, left, b, r))
    box = F.struct(t.alias("top"), left.alias("left"), b.alias("bottom"), r.alias("right"))
    return F.when((b > t) & (r > left), box)


def crop(box: Column, width: Column, height: Column, margin: float) -> Column:
    """Pixel rectangle of a box with a margin on each side, a share of the box's own size, cut at the picture's edges."""
    h, w = box.bottom - box.top, box.right - box.left
    place = lambda v, size: F.greatest(F.lit(0), F.least(size, F.bround(v * size / F.lit(1000.0)).cast("int")))
    return F.struct(
        place(box.left - w * margin, width).alias("x0"),
        place(box.top - h * margin, height).alias("y0"),
        place(box.right + w * margin, width).alias("x1"),
        place(box.bottom + h * margin, height).alias("y1"),
    )


def iou(a: Column, b: Column) -> Column:
    """Intersection over union, 0 where they don't meet."""
    h = F.greatest(F.lit(0), F.least(a.bottom, b.bottom) - F.greatest(a.top, b.top))
    w = F.greatest(F.lit(0), F.least(a.right, b.right) - F.greatest(a.left, b.left))
    area = lambda x: (x.bottom - x.top) * (x.right - x.left)
    return F.when(h * w == 0, 0.0).otherwise(h * w / (area(a) + area(b) - h * w))
