"""Goal faces calibrated camera by camera: a homography of four corners, and how unsure it is (L1, L2)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldtrace.operators.shots import face

#: The goal and the pitch in metres, the error of a clicked corner in pixels, the margin of depth in metres, and how far from the goal line a post may stand in pixels.
GOAL_WIDTH, BAR, PITCH_LENGTH, PITCH_WIDTH, CLICK, DEPTH, OFF_LINE = 7.32, 2.44, 105.0, 68.0, 4.0, 0.25, 15.0
LOW, HIGH = (PITCH_WIDTH - GOAL_WIDTH) / 2, (PITCH_WIDTH + GOAL_WIDTH) / 2


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def along(p: np.ndarray, line: np.ndarray) -> tuple[float, float]:
    """Distance of a point from a polyline, and how far from its upper end along it; the first of segments that are equally near."""
    line = line if line[0, 1] <= line[-1, 1] else line[::-1]
    step = np.diff(line, axis=0)
    long = np.hypot(*step.T)
    t = np.clip(((p - line[:-1]) * step).sum(axis=1) / np.where(long > 0, long**2, 1.0), 0.0, 1.0)
    away = np.hypot(*(p - line[:-1] - t[:, None] * step).T)
    k = int(np.argmin(away))
    return float(away[k]), float(long[:k].sum() + t[k] * long[k])


def homographies(images: np.ndarray) -> np.ndarray:
    """The matrices that take images' four points (an axis of stacks) to the goal's corners, all in one solve; NaN where they span none."""
    u, v = np.array([LOW, HIGH, HIGH, LOW]), np.array([0.0, 0.0, BAR, BAR])
    x, y = images[..., 0], images[..., 1]
    zero, one = np.zeros_like(x), np.ones_like(x)
    rows = np.concatenate([np.stack([x, y, one, zero, zero, zero, -u * x, -u * y], axis=-1), np.stack([zero, zero, zero, x, y, one, -v * x, -v * y], axis=-1)], axis=-2)
    out = np.full((*images.shape[:-2], 9), np.nan)
    good = np.abs(np.linalg.det(rows)) > 1e-6
    right = np.broadcast_to(np.concatenate([u, v]), rows.shape[:-1])
    out[good, :8], out[good, 8] = np.linalg.solve(rows[good], right[good][..., None])[..., 0], 1.0
    return out.reshape(*images.shape[:-2], 3, 3)


def seen_in_plane(m: np.ndarray, points: np.ndarray) -> np.ndarray:
    w = np.concatenate([points, np.ones((*points.shape[:-1], 1))], axis=-1) @ np.swapaxes(m, -1, -2)
    return w[..., :2] / w[..., 2:]


def calibrated(polygon: np.ndarray, line: np.ndarray) -> tuple[str | None, np.ndarray, np.ndarray, float]:
    """Why there is no face (None if there is), its corners, the matrix, and the uncertainty in metres."""
    nothing = np.zeros((4, 2)), np.zeros((3, 3)), 0.0
    if len(polygon) != 4:
        return "goal mouth needs four corners", *nothing
    if len(line) < 2:
        return "no goal line", *nothing
    on = np.array([along(p, line) for p in polygon])
    order = np.argsort(on[:, 0], kind="stable")
    bases = order[:2][np.argsort(on[order[:2], 1], kind="stable")]
    if on[bases, 0].max() > OFF_LINE:
        return "post base is off the goal line", *nothing
    bars = [min(order[2:], key=lambda k: np.hypot(*(polygon[k] - polygon[b]))) for b in bases]
    if bars[0] == bars[1]:
        return "crossbar ends cannot be paired to posts", *nothing
    if (polygon[bars, 1] >= polygon[bases, 1]).any():
        return "crossbar corner is below its post base", *nothing
    corners = polygon[[*bases, bars[1], bars[0]]]
    moved = np.repeat(corners[None], 17, axis=0)
    for n, (k, move) in enumerate((k, m) for k in range(4) for m in ((CLICK, 0), (-CLICK, 0), (0, CLICK), (0, -CLICK))):
        moved[n + 1, k] += move
    matrices = homographies(moved)
    if np.isnan(matrices).any():
        return "corners do not form a homography", *nothing
    shown = seen_in_plane(matrices, np.concatenate([corners, corners.mean(axis=0, keepdims=True)]))
    return None, corners, matrices[0], float(np.hypot(*np.moveaxis(shown[1:] - shown[:1], -1, 0)).max()) + DEPTH


def project(m: Column, p: Column) -> Column:
    """L2: a point of the image in the goal's plane: x across the pitch (y in metres), y the height."""
    at = lambda k: F.element_at(m, k + 1)
    w = at(6) * p["x"] + at(7) * p["y"] + at(8)
    return point((at(0) * p["x"] + at(1) * p["y"] + at(2)) / w, (at(3) * p["x"] + at(4) * p["y"] + at(5)) / w)


def goal_faces(cameras: DataFrame) -> DataFrame:
    """L1: cameras (side, polygon: the goal's four corners in the image, goal_line: points along it) with goal_line_x, post_low, post_high, corners (posts' bases from the far touchline, then the crossbar's ends over the second and the first),
    matrix (image to goal's plane, row by row), uncertainty in metres, and rejected_as: why there is no face, null if there is.

    The two corners nearest to the goal line are the posts' bases, each paired with the nearest crossbar corner. The uncertainty is the largest move of a corner or of their middle when one corner is off by four pixels in
    any direction, plus a margin of depth: sixteen more homographies, solved at once. Cameras are rows, calibrated batch by batch where they are.
    """
    xy = "array<struct<x:double,y:double>>"
    schema = StructType([*cameras.schema, *StructType.fromDDL(f"goal_line_x double, post_low double, post_high double, corners {xy}, matrix array<double>, uncertainty double, rejected_as string")])
    places = lambda value: np.array([(p["x"], p["y"]) for p in ([] if value is None else value)], float).reshape(-1, 2)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            made = [calibrated(places(p), places(g)) for p, g in zip(pdf["polygon"], pdf["goal_line"], strict=True)]
            ok = [m[0] is None for m in made]
            pick = lambda values: [v if k else None for v, k in zip(values, ok, strict=True)]  # noqa: B023, E731
            yield pdf.assign(
                goal_line_x=pick([0.0 if s == "left" else PITCH_LENGTH for s in pdf["side"]]), post_low=pick([round(LOW, 3)] * len(pdf)), post_high=pick([round(HIGH, 3)] * len(pdf)), corners=pick([[{"x": x, "y": y} for x, y in m[1].tolist()] for m in made]),
                matrix=pick([m[2].ravel().tolist() for m in made]), uncertainty=pick([m[3] for m in made]), rejected_as=[m[0] for m in made],
            )[schema.names]

    return cameras.mapInPandas(run, schema)


def segment_distance(p: Column, a: Column, b: Column) -> Column:
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))))
    return F.hypot(p["x"] - a["x"] - t * dx, p["y"] - a["y"] - t * dy)


def image_distance(p: Column, corners: Column) -> Column:
    """L2: signed distance in pixels of a point from the goal in the image, negative inside."""
    edges = F.zip_with(corners, F.concat(F.slice(corners, 2, F.size(corners) - 1), F.slice(corners, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    over = lambda e: (e["a"]["y"] > p["y"]) != (e["b"]["y"] > p["y"])
    crossed = F.filter(edges, lambda e: over(e) & (p["x"] < (e["b"]["x"] - e["a"]["x"]) * F.try_divide(p["y"] - e["a"]["y"], e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]))
    away = F.array_min(F.transform(edges, lambda e: segment_distance(p, e["a"], e["b"])))
    return F.when(F.size(crossed) % 2 == 1, -away).otherwise(away)


def on_faces(points: DataFrame, faces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """L2, L3: points (keys, x, y in the image) of cameras with a face: where they lie in the goal's plane (goal_y, goal_z), how far from the goal in the image, and whether inside it beyond doubt."""
    rows = points.join(faces.where("rejected_as IS NULL").select(*keys, "corners", "matrix", "uncertainty", "post_low", "post_high"), list(keys)).withColumn("at_", point(F.col("x"), F.col("y")))
    p = F.col("at_")
    rows = rows.withColumn("in_plane_", project(F.col("matrix"), p)).withColumns({"goal_y": F.col("in_plane_.x"), "goal_z": F.col("in_plane_.y"), "image_distance": image_distance(p, F.col("corners"))})
    low, high, unsure = (F.col(c) for c in ("post_low", "post_high", "uncertainty"))
    return rows.select(*points.columns, "goal_y", "goal_z", "image_distance", face(F.col("goal_y"), F.col("goal_z"), low, high, BAR, unsure).alias("face"))
