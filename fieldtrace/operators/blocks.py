"""Aggregates: block metrics, coverage, cells, evaluations (2D)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.functions import geometry as g


def block_of(at: str, seconds: float) -> Column:
    return F.floor(F.col(at) / seconds)


def detection_summary(boxes: DataFrame, clips: DataFrame, keys: Sequence[str], stride: int) -> DataFrame:
    """Frames, boxes by class, frames with a person or a ball, coverage, and whether all frames that the clip (frame_count) has at that stride are there. One count a frame first, so no distinct count of frames."""
    person, ball = F.col("class_name") == "person", F.col("class_name") == "sports ball"
    frames = boxes.groupBy(*keys, "source_frame").agg(F.count_if(person).alias("p"), F.count_if(ball).alias("b"))
    out = frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("frames"), F.sum("p").alias("persons"), F.sum("b").alias("balls"), F.count_if(F.col("p") > 0).alias("frames_with_person"), F.count_if(F.col("b") > 0).alias("frames_with_ball"))
    out = out.withColumn("ball_coverage", F.round(F.col("frames_with_ball") / F.col("frames"), 6)).join(clips, list(keys))
    return out.withColumn("expected_frames", F.ceil(F.col("frame_count") / stride)).withColumn("complete", F.col("frames") >= F.col("expected_frames")).drop("frame_count")


def micro_average(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts, precision and recall of each part and, with nulls for the keys, of all of them."""
    out = parts.rollup(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    ratio = lambda of: F.round(F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col(of)), F.lit(0.0)), 6)
    return out.withColumn("precision", ratio("fp")).withColumn("recall", ratio("fn"))


def error_bands(distances: DataFrame, distance: str, limits: Sequence[float]) -> DataFrame:
    """Number of distances in each band, those without any as 'not_visible'; bands without rows are 0."""
    names = [f"to_{limit:g}" for limit in limits] + ["above", "not_visible"]
    band = F.when(F.col(distance).isNull(), "not_visible")
    for limit, name in zip(limits, names, strict=False):
        band = band.when(F.col(distance) <= limit, name)
    counts = distances.groupBy(band.otherwise("above").alias("band")).agg(F.count(F.lit(1)).alias("n"))
    grid = distances.sparkSession.createDataFrame([(n,) for n in names], "band string")
    return grid.join(counts, "band", "left").fillna(0, ["n"])


def possession_share(observations: DataFrame, keys: Sequence[str], seconds: float) -> DataFrame:
    """Observations of each known team in each block, and their share in percent."""
    counts = observations.where("team != 'unknown'").groupBy(*keys, block_of("clip_seconds", seconds).alias("block"), "team").agg(F.count(F.lit(1)).alias("controlled_samples"))
    total = F.sum("controlled_samples").over(Window.partitionBy(*keys, "block"))
    return counts.withColumn("possession_percent", F.round(100 * F.col("controlled_samples") / total, 1))


def event_counts(events: DataFrame, keys: Sequence[str], seconds: float) -> DataFrame:
    """Passes and turnovers of each block and team, at completion, or at the start where completion is missing or 0."""
    at = F.coalesce(F.nullif(F.col("completion_seconds"), F.lit(0.0)), F.col("clip_seconds"))
    rows = events.where("team IS NOT NULL").withColumn("at_", at)
    count = lambda kind: F.count_if(F.col("event_type") == kind)
    return rows.groupBy(*keys, block_of("at_", seconds).alias("block"), "team").agg(count("pass_candidate").alias("pass_candidates"), count("turnover_candidate").alias("turnovers_lost"))


def player_metrics(points: DataFrame, keys: Sequence[str], seconds: float, most_gap: float) -> DataFrame:
    """Distance and top speed of each track in each block, over steps within the block of at most most_gap seconds."""
    points = points.withColumn("block", block_of("clip_seconds", seconds))
    w = Window.partitionBy(*keys, "track_id", "block").orderBy("clip_seconds")
    dt = F.col("clip_seconds") - F.lag("clip_seconds").over(w)
    moved = g.distance(F.col("x_metres"), F.col("y_metres"), F.lag("x_metres").over(w), F.lag("y_metres").over(w))
    rows = points.withColumns({"dt_": dt, "moved_": moved}).withColumn("usable_", (F.col("dt_") > 0) & (F.col("dt_") <= most_gap))
    return rows.groupBy(*keys, "block", "track_id").agg(
        F.round(F.coalesce(F.sum(F.when(F.col("usable_"), F.col("moved_"))), F.lit(0.0)), 2).alias("distance_metres"),
        F.round(F.coalesce(F.max(F.when(F.col("usable_"), F.col("moved_") / F.col("dt_"))), F.lit(0.0)), 2).alias("maximum_speed"),
        F.count(F.lit(1)).alias("sample_count"),
    )


def heatmap(points: DataFrame, keys: Sequence[str], seconds: float, length: float, width: float, columns: int, rows: int) -> DataFrame:
    """Points of each team in each cell of each block, cells without points too (the grid is joined to the block-team rows, not to the points)."""
    cell = lambda c, size, n: F.least(F.lit(n - 1), F.floor(F.col(c) / size * n)).cast("int")
    counted = points.groupBy(*keys, block_of("clip_seconds", seconds).alias("block"), "team", cell("y_metres", width, rows).alias("row"), cell("x_metres", length, columns).alias("column")).agg(F.count(F.lit(1)).alias("n"))
    grid = counted.select(*keys, "block", "team").distinct().withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    return grid.join(counted, [*keys, "block", "team", "row", "column"], "left").fillna(0, ["n"])


def block_report(observations: DataFrame, events: DataFrame, keys: Sequence[str], seconds: float) -> DataFrame:
    """A row for each block from 0 to the last one of the clip and each team seen in it, with shares and counts; blocks without any have a null team."""
    ends = observations.select(*keys, "clip_seconds").unionByName(events.select(*keys, "clip_seconds")).groupBy(*keys).agg(F.max("clip_seconds").alias("last"))
    grid = ends.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / seconds)))).drop("last")
    both = possession_share(observations, keys, seconds).join(event_counts(events, keys, seconds), [*keys, "block", "team"], "full_outer")
    out = grid.join(both, [*keys, "block"], "left").fillna(0, ["controlled_samples", "pass_candidates", "turnovers_lost"]).fillna(0.0, ["possession_percent"])
    return out.withColumn("start_seconds", F.col("block") * seconds)


def static_cells(points: DataFrame, keys: Sequence[str], size: float, occupancy: float) -> DataFrame:
    """Cells (half-even rounded) that hold points in at least `occupancy` of the clip's frames."""
    frames = points.groupBy(*keys).agg(F.count_distinct("source_frame").alias("frames"))
    cells = points.groupBy(*keys, F.bround(F.col("x") / size).alias("cell_x"), F.bround(F.col("y") / size).alias("cell_y")).agg(F.count_distinct("source_frame").alias("n"))
    return cells.join(frames, [*keys]).where(F.col("n") >= occupancy * F.col("frames"))


def track_quality(points: DataFrame, keys: Sequence[str], least: float) -> DataFrame:
    """Mean confidence times the root of the number of points, to six decimals (halves up), and the frames and seconds a track spans."""
    out = points.groupBy(*keys, "track_id").agg(F.avg("confidence").alias("m"), F.count(F.lit(1)).alias("points"), F.min("source_frame").alias("first_frame"), F.max("source_frame").alias("last_frame"), (F.max("clip_seconds") - F.min("clip_seconds")).alias("duration_seconds"))
    six = lambda c: F.floor(c * 1e6 + 0.5) / 1e6
    return out.where(F.col("m") >= least).withColumn("quality", six(F.col("m") * F.sqrt("points"))).withColumn("mean_confidence", six(F.col("m"))).drop("m")


def median_colors(tracks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Exact medians of the channels."""
    return tracks.groupBy(*by).agg(*[F.percentile(c, 0.5).alias(f"median_{c}") for c in ("b", "g", "r")], F.count(F.lit(1)).alias("samples"))


def zero_filled(counts: DataFrame, rows: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Counts by (team, event_type) with the missing ones as 0."""
    kinds = counts.groupBy("team", "event_type").agg(F.count(F.lit(1)).alias("n"))
    grid = counts.sparkSession.createDataFrame([(t, c) for t in rows for c in columns], "team string, event_type string")
    return grid.join(kinds, ["team", "event_type"], "left").fillna(0, ["n"])


def fingerprint(rows: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """A hash of each group's rows that does not depend on their order: the sum of 52 bits of each row's SHA-256 (so that it combines before the shuffle), and the count."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(columns)])
    bits = F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("decimal(20,0)")
    return rows.groupBy(*by).agg(F.sum(bits).cast("string").alias("fingerprint"), F.count(F.lit(1)).alias("n"))
