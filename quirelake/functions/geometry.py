"""Expressions on boxes and lines. A transform is an array of nine numbers, the rows of a 3 x 3 matrix."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

CROP_H, STRIDE = 40, 2


def _project(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    at = lambda i: F.get(m, F.lit(i))
    w = at(6) * x + at(7) * y + at(8)
    return (at(0) * x + at(1) * y + at(2)) / w, (at(3) * x + at(4) * y + at(5)) / w


def bbox_from_quad(x1: Column, y1: Column, x2: Column, y2: Column, m: Column) -> Column:
    """The upright box (x, y, w, h) around a projected rectangle: floors of the least, ceilings of the greatest."""
    corners = [_project(m, x, y) for x in (x1, x2) for y in (y1, y2)]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    x, y = F.floor(F.least(*xs)), F.floor(F.least(*ys))
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), (F.ceil(F.greatest(*xs)) - x).cast("int").alias("w"), (F.ceil(F.greatest(*ys)) - y).cast("int").alias("h"))


def word_box(t0: Column, t1: Column, crop_w: Column, m: Column) -> Column:
    """The box of time steps t0 to t1 of a line's crop."""
    return bbox_from_quad((STRIDE * t0).cast("double"), F.lit(0.0), F.least(STRIDE * (t1 + 1), crop_w).cast("double"), F.lit(float(CROP_H)), m)


def line_direction(cov: Column, var_x: Column, var_y: Column) -> Column:
    """The angle of the principal axis, from population moments; it looks to the right."""
    return F.lit(0.5) * F.atan2(2 * cov, var_x - var_y)


def fold_angle(dx: Column, dy: Column) -> Column:
    """The angle of a segment's normal."""
    return F.lit(math.pi / 2) + F.atan2(dy, dx)
