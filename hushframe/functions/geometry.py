"""Box arithmetic. Boxes are four Columns x, y, w, h; the coordinate space is part of the caller's column names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def columns(prefix: str = "") -> Box:
    return tuple(F.col(prefix + c) for c in "xywh")


def is_finite(*values: Column) -> Column:
    """False for null, NaN and infinite values."""
    inside = [F.abs(v.cast("double")) < float("inf") for v in values]  # NaN is above all numbers
    return F.coalesce(reduce(Column.__and__, inside), F.lit(False))


def translate(box: Box, dx: Column, dy: Column) -> Box:
    """The box moved by an offset; null where the box or the offset is not finite, which callers reject."""
    fine = is_finite(*box, dx, dy)
    return F.when(fine, box[0] + dx), F.when(fine, box[1] + dy), F.when(fine, box[2]), F.when(fine, box[3])


def scale(box: Box, factor: Column) -> Box:
    """The box in screenshot pixels; null where the factor is not finite and positive, which callers reject."""
    fine = is_finite(*box, factor) & (factor > 0)
    return tuple(F.when(fine, v * factor) for v in box)


def from_corners(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Box:
    """Detector corners, in either order, as a box; null if one is not finite."""
    fine = is_finite(xmin, ymin, xmax, ymax)
    return tuple(F.when(fine, v) for v in (F.least(xmin, xmax), F.least(ymin, ymax), F.abs(xmax - xmin), F.abs(ymax - ymin)))


def intersection(a: Box, b: Box) -> Column:
    width = F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0])
    height = F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1])
    return F.greatest(width, F.lit(0.0)) * F.greatest(height, F.lit(0.0))


def overlap_ratio(region: Box, node: Box) -> Column:
    """Share of the node that the region covers; 0 for a node without area."""
    return F.when((node[2] <= 0) | (node[3] <= 0), 0.0).otherwise(intersection(region, node) / (node[2] * node[3]))


def iou(a: Box, b: Box) -> Column:
    inter = intersection(a, b)
    return inter / (a[2] * a[3] + b[2] * b[3] - inter + 1e-9)


def unletterbox(value: Column, pad: Column, ratio: Column) -> Column:
    return (value - pad) / ratio


def js_round(value: Column, digits: int = 0) -> Column:
    """Half up, also below zero."""
    p = 10.0**digits
    return F.floor(value * p + 0.5) / p
