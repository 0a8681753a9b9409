"""Boxes as struct<x0,y0,x1,y1> with x0 <= x1, y0 <= y1, and affine maps as six numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0, y0, x1, y1) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def valid_box(b: Column) -> Column:
    finite = [~F.isnan(b[c]) & (F.abs(b[c]) < 1e300) for c in ("x0", "y0", "x1", "y1")]
    return F.coalesce(finite[0] & finite[1] & finite[2] & finite[3] & (b["x0"] <= b["x1"]) & (b["y0"] <= b["y1"]), F.lit(False))


def inside(b: Column, page: Column, slack: float = 0.0) -> Column:
    return (b["x0"] >= page["x0"] - slack) & (b["y0"] >= page["y0"] - slack) & (b["x1"] <= page["x1"] + slack) & (b["y1"] <= page["y1"] + slack)


def union_boxes(boxes: Column) -> Column:
    """The least box around an array of boxes; null for none."""
    side = lambda f, c: f(F.transform(boxes, lambda b: b[c]))
    return F.when(F.size(boxes) > 0, box(side(F.array_min, "x0"), side(F.array_min, "y0"), side(F.array_max, "x1"), side(F.array_max, "y1")))


def mapped_box(b: Column, m: Column) -> Column:
    """The upright box around the four mapped corners: x' = m1 x + m3 y + m5, y' = m2 x + m4 y + m6."""
    e = lambda i: F.element_at(m, i)
    corners = [(b[x], b[y]) for x in ("x0", "x1") for y in ("y0", "y1")]
    xs = [e(1) * x + e(3) * y + e(5) for x, y in corners]
    ys = [e(2) * x + e(4) * y + e(6) for x, y in corners]
    return box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def regular_matrix(m: Column) -> Column:
    """Six finite numbers with a determinant that isn't zero."""
    det = F.element_at(m, 1) * F.element_at(m, 4) - F.element_at(m, 2) * F.element_at(m, 3)
    return F.when(F.size(m) == 6, F.forall(m, lambda x: ~F.isnan(x) & (F.abs(x) < 1e300)) & (F.abs(det) > 1e-12)).otherwise(False)
