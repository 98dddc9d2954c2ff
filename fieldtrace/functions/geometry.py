"""Column helpers for boxes, points and polygons; all are built-in expressions inside whole-stage code."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def center(b: Box) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def foot(b: Box) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, b[3]


def height(b: Box) -> Column:
    return F.greatest(F.lit(1.0), b[3] - b[1])


def area(b: Box) -> Column:
    return F.greatest(F.lit(0.0), b[2] - b[0]) * F.greatest(F.lit(0.0), b[3] - b[1])


def overlap(a: Box, b: Box) -> Column:
    return F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))


def iou(a: Box, b: Box) -> Column:
    both = overlap(a, b)
    return F.coalesce(F.try_divide(both, area(a) + area(b) - both), F.lit(0.0))


def overlap_of_smaller(a: Box, b: Box) -> Column:
    return F.coalesce(F.try_divide(overlap(a, b), F.least(area(a), area(b))), F.lit(0.0))


def box_distance(x: Column, y: Column, b: Box) -> Column:
    """Distance of a point from a box, in heights of the box."""
    return F.hypot(F.greatest(b[0] - x, F.lit(0.0), x - b[2]), F.greatest(b[1] - y, F.lit(0.0), y - b[3])) / height(b)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def signed_distance(x: Column, y: Column, polygon: Sequence[tuple[float, float]]) -> Column:
    """Distance from the outline of a polygon, negative outside. The polygon is a parameter, so its edges unroll into one expression."""
    edges = list(zip(polygon, [*polygon[1:], polygon[0]], strict=True))
    near, crossings = [], F.lit(0)
    for (ax, ay), (bx, by) in edges:
        dx, dy = float(bx - ax), float(by - ay)
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy)))
        near.append(distance(x, y, ax + t * dx, ay + t * dy))
        if dy:
            crossings = crossings + F.when((F.lit(float(ay)) > y) != (F.lit(float(by)) > y), (x < dx * (y - ay) / dy + ax).cast("int")).otherwise(0)
    return F.when(crossings % 2 == 1, F.least(*near)).otherwise(-F.least(*near))


def homography(image: Sequence[tuple[float, float]], pitch: Sequence[tuple[float, float]]) -> list[float]:
    """Nine coefficients that take image points to the pitch, from four or more pairs; one small solve per camera."""
    if len(image) < 4 or len(image) != len(pitch):
        raise ValueError("a homography takes four or more pairs of points")
    rows, right = [], []
    for (x, y), (u, v) in zip(image, pitch, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return [*np.linalg.lstsq(np.array(rows, float), np.array(right, float), rcond=None)[0].tolist(), 1.0]


def projected(x: Column, y: Column, h: Sequence[float]) -> tuple[Column, Column]:
    below = h[6] * x + h[7] * y + h[8]
    return (h[0] * x + h[1] * y + h[2]) / below, (h[3] * x + h[4] * y + h[5]) / below
