"""Trailing and leading windows, track filters, gates and integrity checks (2D, 2E, 2G, 2I, 2O)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.functions import geometry as g
from fieldtrace.operators.tracks import ordered, steps


def trailing(keys: Sequence[str], seconds: float):
    """The last `seconds` up to a point, in whole milliseconds."""
    return Window.partitionBy(*keys).orderBy(F.round(F.col("clip_seconds") * 1000).cast("long")).rangeBetween(-round(1000 * seconds), 0)


def motion_state(points: DataFrame, keys: Sequence[str], seconds: float = 1.0, still: float = 0.12, walk: float = 1.5) -> DataFrame:
    """State of a player (x, y, height) over the last `seconds`: speed in heights a second from the first to the last point; one point alone is unknown."""
    w = trailing(keys, seconds)
    first = {c: F.first(c).over(w) for c in ("x", "y", "clip_seconds", "height")}
    moved = g.distance(F.col("x"), F.col("y"), first["x"], first["y"])
    speed = moved / (F.col("clip_seconds") - first["clip_seconds"]) / ((F.col("height") + first["height"]) / 2)
    points = points.withColumn("samples", F.count(F.lit(1)).over(w)).withColumn("heights_per_second", F.when(F.col("clip_seconds") > first["clip_seconds"], speed))
    state = F.when(F.col("heights_per_second").isNull(), "unknown").when(F.col("heights_per_second") < still, "stationary").when(F.col("heights_per_second") < walk, "walking")
    return points.withColumn("motion_state", state.otherwise("running"))


def sustained(points: DataFrame, keys: Sequence[str], least: float, of: int = 3, times: int = 2) -> DataFrame:
    """Points from which at least `times` of the next `of` steps reach a speed."""
    w = ordered(keys).rowsBetween(1, of)
    return steps(points, keys, float("inf")).withColumn("fast_", F.count_if(F.coalesce(F.col("speed") >= least, F.lit(False))).over(w)).where(F.col("fast_") >= times).drop("fast_")


def peaks(points: DataFrame, keys: Sequence[str], seconds: float, drop: float) -> DataFrame:
    """The top speed of the last `seconds` at each point, and whether the point itself is slow: at most `drop` of that. (E16 with its look ahead is shots.arrests.)"""
    w = trailing(keys, seconds)
    return steps(points, keys, float("inf")).withColumn("peak", F.max("speed").over(w)).withColumn("arrest", F.col("speed") <= drop * F.col("peak"))


def approaching(points: DataFrame, keys: Sequence[str], x: float, y: float, slack: float) -> DataFrame:
    """Whether a track's distance from a target never grows by more than `slack` from point to point."""
    points = points.withColumn("far_", g.distance(F.col("x"), F.col("y"), F.lit(x), F.lit(y)))
    points = points.withColumn("grown_", F.col("far_") - F.lag("far_").over(ordered(keys)))
    return points.groupBy(*keys).agg(F.coalesce(F.bool_and(F.col("grown_") <= slack), F.lit(True)).alias("monotone"), F.count(F.lit(1)).alias("points"))


def evenly_sampled(points: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """At most `most` points of each track, evenly spread over its order, the first and last among them."""
    points = points.withColumn("place_", F.row_number().over(ordered(keys)) - 1).withColumn("all_", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    k = F.round(F.col("place_") * (most - 1) / (F.col("all_") - 1))
    chosen = F.bround(k * (F.col("all_") - 1) / (most - 1)) == F.col("place_")
    return points.where((F.col("all_") <= most) | chosen).drop("place_", "all_")


def long_tracks(points: DataFrame, keys: Sequence[str], least: int) -> DataFrame:
    """I4: points of tracks with at least `least` points, by one window over the track."""
    return points.withColumn("all_", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where(F.col("all_") >= least).drop("all_")


def static_fragments(points: DataFrame, keys: Sequence[str], least: float) -> DataFrame:
    """Length of each track's path and the median of its positive box diagonals (box_diagonal); static: three points or more, none near a player's feet (near_feet), and a path of
    at most `least` such diagonals. Tracks without a positive diagonal are not static."""
    usable = F.when(F.col("box_diagonal") > 0, F.col("box_diagonal"))
    rows = steps(points, keys, float("inf")).groupBy(*keys).agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("path"), F.percentile(usable, 0.5).alias("median_diagonal"), F.count(F.lit(1)).alias("points"), F.bool_or("near_feet").alias("near_"))
    return rows.withColumn("static", F.coalesce((F.col("points") >= 3) & ~F.col("near_") & (F.col("path") <= least * F.col("median_diagonal")), F.lit(False))).drop("near_")


def confirmed_runs(points: DataFrame, keys: Sequence[str], stride: int) -> DataFrame:
    """Points with the next two samples one stride and two strides later."""
    w = ordered(keys)
    return points.withColumn("one_", F.lead("source_frame", 1).over(w)).withColumn("two_", F.lead("source_frame", 2).over(w)).where((F.col("one_") == F.col("source_frame") + stride) & (F.col("two_") == F.col("source_frame") + 2 * stride)).drop("one_", "two_")


def provenance_gate(states: DataFrame, keys: Sequence[str], eligible: str, least: float = 0.9, blocking: bool = True) -> DataFrame:
    """Share of states that may be evidence, whether the clip passes or needs a review, what the pipeline does (a report alone never blocks), and states of each kind (state)."""
    out = states.groupBy(*keys).agg(F.count(F.lit(1)).alias("states"), F.count_if(F.expr(eligible)).alias("eligible"))
    kinds = states.groupBy(*keys, "state").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "state", "n"))), ",").alias("by_state"))
    passed = F.col("eligible") >= least * F.col("states")
    out = out.withColumn("share", F.round(F.col("eligible") / F.col("states"), 6)).withColumn("status", F.when(passed, "passed").otherwise("review_required"))
    return out.withColumn("action", F.when(passed | F.lit(not blocking), "continue").otherwise("blocked")).join(kinds, list(keys))


def supported_tracks(points: DataFrame, keys: Sequence[str], least: int, fastest: float, sure: float = 0.2, sure_at_feet: float = 0.1, part: float = 0.075) -> DataFrame:
    """Tracks of at least `least` points; if that is 3, also pairs of points whose speed is at least `part` of the fastest and whose mean confidence is `sure` (sure_at_feet
    if one is near a player's feet)."""
    rows = steps(points, keys, float("inf"))
    per = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("points"), F.avg("confidence").alias("mean_"), F.max("speed").alias("speed_"), F.bool_or("near_feet").alias("feet_"))
    pair = (F.col("points") == 2) & (F.col("speed_") >= part * fastest) & ((F.col("mean_") >= sure) | (F.col("feet_") & (F.col("mean_") >= sure_at_feet)))
    return per.where((F.col("points") >= least) | (F.lit(least == 3) & F.coalesce(pair, F.lit(False)))).select(*keys, "points")


def label_counts(rows: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Rows of each label."""
    return rows.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))


def missing_frames(points: DataFrame, clips: DataFrame, keys: Sequence[str], stride: int) -> DataFrame:
    """Expected frames of clips (first_frame, last_frame) that have no point."""
    grid = clips.withColumn("source_frame", F.explode(F.sequence("first_frame", "last_frame", F.lit(stride).cast("long")))).select(*keys, "source_frame")
    return grid.join(points.select(*keys, "source_frame"), [*keys, "source_frame"], "left_anti")


def membership_faults(members: DataFrame, by: Sequence[str], ordinal: str, tie: str) -> DataFrame:
    """Members whose ordinal is not their place from 0 on (in order of ordinal, then of tie), or that repeat an ordinal."""
    w = Window.partitionBy(*by).orderBy(ordinal, tie)
    members = members.withColumn("place", (F.row_number().over(w) - 1).cast("long")).withColumn("repeats", F.count(F.lit(1)).over(Window.partitionBy(*by, ordinal)))
    return members.where((F.col("place") != F.col(ordinal)) | (F.col("repeats") > 1))


def audit_sequence(log: DataFrame, by: Sequence[str], bucket: Column, order: Sequence[str]) -> DataFrame:
    """A sequence number for each entry of a workflow. Entries are numbered within a bucket, which must follow the order, and the buckets' counts are summed
    up, so that no task orders a whole workflow."""
    rows = log.withColumn("bucket_", bucket)
    counts = rows.groupBy(*by, "bucket_").agg(F.count(F.lit(1)).alias("n_"))
    before = Window.partitionBy(*by).orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, "bucket_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"))
    own = F.row_number().over(Window.partitionBy(*by, "bucket_").orderBy(*order))
    return rows.withColumn("own_", own).join(starts, [*by, "bucket_"]).withColumn("sequence", (F.col("start_") + F.col("own_")).cast("long")).drop("start_", "own_", "bucket_")


def active_leases(beats: DataFrame, by: Sequence[str], at: str, lasts_days: int) -> DataFrame:
    """The last heartbeat of each key by an instant, if it has not expired then."""
    instant = F.lit(at).cast("date")
    last = beats.where(F.to_date("created_at") <= instant).groupBy(*by).agg(F.max(F.to_date("created_at")).alias("renewed"), F.count(F.lit(1)).alias("heartbeats"))
    return last.where(F.date_add("renewed", lasts_days) > instant)
