"""Projections and filters over detections and points (2B)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrace.functions import geometry as g


def with_box_geometry(boxes: DataFrame) -> DataFrame:
    """B1: centre, foot point, height (at least 1) and diagonal of each box."""
    b = g.box()
    (cx, cy), (fx, fy) = g.center(b), g.foot(b)
    diagonal = F.sqrt((b[2] - b[0]) * (b[2] - b[0]) + (b[3] - b[1]) * (b[3] - b[1]))
    return boxes.withColumns({"center_x": cx, "center_y": cy, "foot_x": fx, "foot_y": fy, "height": g.height(b), "diagonal": diagonal})


def confident(boxes: DataFrame, person: float, ball: float) -> DataFrame:
    """B2: persons and balls of at least a confidence."""
    return boxes.where(((F.col("class_name") == "person") & (F.col("confidence") >= person)) | ((F.col("class_name") == "sports ball") & (F.col("confidence") >= ball)))


def normalized_class(boxes: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Class names in lower case with single underscores; only wanted ones stay."""
    name = F.trim(F.regexp_replace(F.lower("class_name"), "[^a-z0-9]+", "_"), F.lit("_"))
    return boxes.withColumn("class_name", name).where(F.col("class_name").isin(*wanted))


def on_pitch_mask(boxes: DataFrame, width: float, top: Sequence[float], bottom: Sequence[float]) -> DataFrame:
    """Feet between two parabolas in x scaled to -1..1; top and bottom are (level, curvature)."""
    x, y = g.foot(g.box())
    n = x / (width / 2) - 1
    return boxes.where((y >= top[0] + top[1] * n * n) & (y <= bottom[0] + bottom[1] * n * n))


def near_ball(boxes: DataFrame, keys: Sequence[str], reach: float = 1.5) -> DataFrame:
    """Persons whose foot is within `reach` of their heights of a ball in the same frame."""
    frame = [*keys, "source_frame"]
    x, y = g.center(g.box())
    balls = boxes.where("class_name = 'sports ball'").select(*frame, x.alias("ball_x"), y.alias("ball_y"))
    people = boxes.where("class_name = 'person'")
    fx, fy = g.foot(g.box())
    close = g.distance(fx, fy, F.col("ball_x"), F.col("ball_y")) <= reach * g.height(g.box())
    same = [people[c] == balls[c] for c in frame]
    return people.join(balls, [*same, close], "left_semi")


def in_pitch(points: DataFrame, h: Sequence[float], length: float, width: float) -> DataFrame:
    """Points in metres, those inside the pitch only."""
    x, y = g.projected(F.col("x"), F.col("y"), h)
    return points.withColumn("x_metres", x).withColumn("y_metres", y).where(F.col("x_metres").between(0, length) & F.col("y_metres").between(0, width))


def analysis_window(points: DataFrame, start: float, end: float) -> DataFrame:
    """Start <= t < end."""
    return points.where((F.col("clip_seconds") >= start) & (F.col("clip_seconds") < end))


def sampled(points: DataFrame, stride: int, first: int = 0) -> DataFrame:
    """Every stride-th frame from the first."""
    return points.where((F.col("source_frame") >= first) & ((F.col("source_frame") - first) % stride == 0))


def clip_clock(points: DataFrame, fps: float, first: int = 0) -> DataFrame:
    """Seconds since the first frame, to three decimals."""
    return points.withColumn("clip_seconds", F.round((F.col("source_frame") - first) / F.lit(fps), 3))


def tiles(frames: DataFrame, tile: int, overlap: float) -> DataFrame:
    """Tiles that cover frames (clip_id, width, height); the last one of each direction is flush with the edge."""
    step = max(1, int(tile * (1 - overlap)))

    def starts(size):
        last = F.greatest(F.lit(0), size - tile)
        return F.array_distinct(F.concat(F.filter(F.sequence(F.lit(0), last, F.lit(step)), lambda s: s < last), F.array(last)))

    out = frames.withColumn("tile_x", F.explode(starts(F.col("width")))).withColumn("tile_y", F.explode(starts(F.col("height"))))
    return out.withColumn("tile_width", F.least(F.lit(tile), F.col("width"))).withColumn("tile_height", F.least(F.lit(tile), F.col("height")))


def nearest_color(tracks: DataFrame, palette: dict[str, tuple[int, int, int]]) -> DataFrame:
    """The palette name with the least Euclidean distance; the palette is a parameter, so no join is needed."""
    squares = [F.struct(sum((F.col(c) - v) * (F.col(c) - v) for c, v in zip(("b", "g", "r"), bgr, strict=True)).alias("d"), F.lit(name).alias("name")) for name, bgr in sorted(palette.items())]
    return tracks.withColumn("color", F.array_min(F.array(*squares))["name"])


def suppressed(boxes: DataFrame, keys: Sequence[str], order: Sequence, limit: float = 0.5) -> DataFrame:
    """Of each frame and class, boxes by falling confidence that overlap no kept one by IoU >= limit.

    A frame's boxes are few; they are folded in order inside the aggregate, so the only shuffle is by frame.
    """
    fields = [c for c in boxes.columns if c not in (*keys, "source_frame", "class_name")]
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("rank_"), *[F.col(c).alias(f"tie{k}_") for k, c in enumerate(order)], *fields)))
    as_box = lambda s: tuple(s[c] for c in ("x1", "y1", "x2", "y2"))
    per = boxes.groupBy(*keys, "source_frame", "class_name").agg(ranked.alias("all_"))
    none = F.slice(F.col("all_"), 1, 0)
    kept = F.aggregate("all_", none, lambda acc, s: F.when(F.exists(acc, lambda k: g.iou(as_box(k), as_box(s)) >= limit), acc).otherwise(F.concat(acc, F.array(s))))
    return per.withColumn("one_", F.explode(kept)).select(*keys, "source_frame", "class_name", *[F.col(f"one_.{c}").alias(c) for c in fields])
