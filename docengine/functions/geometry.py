"""Boxes as four Columns x0, y0, x1, y1."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x0: Column
    y0: Column
    x1: Column
    y1: Column


def box(prefix: str = "") -> Box:
    """The box in the columns x0 .. y1, or with a prefix such as ``a.``."""
    return Box(*(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")))


def area(b: Box) -> Column:
    return (b.x1 - b.x0) * (b.y1 - b.y0)


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)
    h = F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 for disjoint or empty boxes."""
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when((area(a) > 0) & (area(b) > 0) & (union > 0), both / union).otherwise(0.0)


def overlap_ratio(a: Box, b: Box) -> Column:
    """Intersection over the smaller area."""
    least = F.least(area(a), area(b))
    return F.when(least > 0, intersection(a, b) / least).otherwise(0.0)


def distance(a: Box, b: Box) -> Column:
    """Distance of the nearest points; 0 for boxes that touch."""
    dx = F.greatest(F.lit(0.0), a.x0 - b.x1, b.x0 - a.x1)
    dy = F.greatest(F.lit(0.0), a.y0 - b.y1, b.y0 - a.y1)
    return F.sqrt(dx * dx + dy * dy)


def overlaps(a: Box, b: Box) -> Column:
    """Whether boxes share a point; touching counts."""
    return (a.x0 <= b.x1) & (b.x0 <= a.x1) & (a.y0 <= b.y1) & (b.y0 <= a.y1)


def contains(a: Box, b: Box) -> Column:
    """Whether a holds all of b."""
    return (a.x0 <= b.x0) & (a.y0 <= b.y0) & (a.x1 >= b.x1) & (a.y1 >= b.y1)


def normalized(b: Box, width: Column, height: Column) -> Box:
    """Pixels to shares of the page; 0 where the page has no size."""
    share = lambda v, of: F.when(of > 0, v / of).otherwise(0.0)
    return Box(share(b.x0, width), share(b.y0, height), share(b.x1, width), share(b.y1, height))


def pixels(b: Box, width: Column, height: Column) -> Box:
    """Shares of the page to whole pixels, truncated."""
    return Box((b.x0 * width).cast("int"), (b.y0 * height).cast("int"), (b.x1 * width).cast("int"), (b.y1 * height).cast("int"))
