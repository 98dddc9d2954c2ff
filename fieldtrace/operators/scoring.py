"""Predictions against references: events, coordinates and raw detections (2D, 2M)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrace.functions import geometry as g
from fieldtrace.operators import joins

BANDS = (("borderline", 50.0), ("review", 100.0), ("unreliable", 250.0))


def share(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole, 0 where there is nothing to share."""
    return F.round(F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0)), digits)


def event_scores(predicted: DataFrame, truth: DataFrame, keys: Sequence[str], tolerance: float) -> DataFrame:
    """Predicted and true events (event_type, seconds, event_no) of each type: counts, matches, precision, recall. Predictions in order of time each take the nearest
    free true event of their type within the tolerance, ties to the smaller event_no."""
    by = [*keys, "event_type"]
    a = predicted.select(*by, F.col("seconds").alias("at"), F.col("event_no").alias("predicted_no"))
    b = truth.select(*by, F.col("seconds").alias("true_at"), F.col("event_no").alias("true_no"))
    pairs = joins.within_band(a, b, by, "at", "true_at", tolerance).withColumn("error", F.abs(F.col("at") - F.col("true_at")))
    pairs = pairs.withColumn("place", F.struct("at", "predicted_no"))
    matched = joins.greedy_matches(pairs.select(*by, "place", "true_no", "error"), by, "place", "true_no", "error")
    counts = [df.groupBy(*by).agg(F.count(F.lit(1)).alias(n)) for df, n in ((predicted, "predicted"), (truth, "truth"), (matched, "tp"))]
    both = counts[0].join(counts[1], by, "full_outer").join(counts[2], by, "left").fillna(0, ["predicted", "truth", "tp"])
    tp, p, t = F.col("tp"), F.col("predicted"), F.col("truth")
    return both.withColumns({"fp": p - tp, "fn": t - tp, "precision": share(tp, p), "recall": share(tp, t)})


def nearest(reference: DataFrame, points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Reference frames (ref_x, ref_y) with the number of points (x, y, source) in the frame, and of the nearest its distance and source."""
    frame = [*keys, "source_frame"]
    both = reference.join(points.select(*frame, "x", "y", "source"), frame, "left")
    far = g.distance(F.col("x"), F.col("y"), F.col("ref_x"), F.col("ref_y"))
    best = both.groupBy(*frame, "ref_x", "ref_y").agg(F.count("x").alias("n"), F.min(F.when(F.col("x").isNotNull(), F.struct(far.alias("far"), "source"))).alias("best"))
    return best.select(*frame, "ref_x", "ref_y", "n", F.col("best.far").alias("far"), F.col("best.source").alias("source"))


def coordinate_scores(reference: DataFrame, points: DataFrame, detected: DataFrame, keys: Sequence[str], stride: int, farthest: float) -> DataFrame:
    """Points and detections against a reference of one point a frame, at frames of the stride.

    A frame matches if its nearest point is within `farthest`; all other points are false. Distances are summed up by exact interpolated percentiles, and put in
    bands; frames that the detector matches are split by what the points made of them.
    """
    frame = [*keys, "source_frame"]
    asked = reference.where(F.col("source_frame") % stride == 0)
    a = nearest(asked, points, keys)
    b = nearest(asked, detected.withColumn("source", F.lit("detector")), keys).select(*frame, F.col("n").alias("detected"), F.col("far").alias("detected_far"))
    rows = a.join(b, frame)
    hit, det = F.coalesce(F.col("far") <= farthest, F.lit(False)), F.coalesce(F.col("detected_far") <= farthest, F.lit(False))
    rows = rows.withColumn("hit", hit).withColumn("det", det).withColumn("false_points", F.col("n") - F.col("hit").cast("long"))
    far = F.col("far")
    limits = [("matched_band", far <= farthest)] + [(f"{name}_frames", (far > low) & (far <= high)) for (name, high), low in zip(BANDS, (farthest, BANDS[0][1], BANDS[1][1]), strict=True)] + [("wrong_object_frames", far > BANDS[-1][1])]
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("evaluated"), F.count_if(F.col("n") > 0).alias("tracked"), F.count_if("hit").alias("matched"), F.count_if(F.col("n") == 0).alias("missing"), F.count_if((F.col("n") > 0) & ~F.col("hit")).alias("wrong"),
        F.sum("false_points").alias("false_points"), F.round(F.coalesce(F.avg(F.when(F.col("hit"), far)), F.lit(0.0)), 3).alias("mean_far"),
        *[F.round(F.coalesce(F.percentile(F.when(F.col("hit"), far), p), F.lit(0.0)), 3).alias(n) for n, p in (("median_far", 0.5), ("p90_far", 0.9))], *[F.count_if(c).alias(n) for n, c in limits],
        F.count_if("det").alias("detector_frames"), F.count_if(F.col("det") & F.col("hit")).alias("kept_frames"), F.count_if(F.col("det") & ~F.col("hit") & (F.col("n") > 0)).alias("lost_to_wrong"), F.count_if(F.col("det") & (F.col("n") == 0)).alias("lost_to_none"), F.count_if(~F.col("det") & F.col("hit")).alias("recovered"),
    )
    return out.withColumns({"coverage": share(F.col("tracked"), F.col("evaluated")), "recall": share(F.col("matched"), F.col("evaluated")), "precision": share(F.col("matched"), F.col("matched") + F.col("false_points"))})


def detection_scores(reference: DataFrame, detected: DataFrame, keys: Sequence[str], farthest: float) -> DataFrame:
    """Raw detections (x, y) against the reference: one match a frame, all others are false positives."""
    rows = nearest(reference, detected.withColumn("source", F.lit("detector")), keys).withColumn("hit", F.coalesce(F.col("far") <= farthest, F.lit(False)))
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("evaluated"), F.count_if("hit").alias("matched"), F.sum(F.col("n") - F.col("hit").cast("long")).alias("false_positives"), F.coalesce(F.avg(F.when(F.col("hit"), F.col("far"))), F.lit(0.0)).alias("mean_far"))
    return out.select(*keys, "evaluated", "matched", (F.col("evaluated") - F.col("matched")).alias("missed"), "false_positives", share(F.col("matched"), F.col("evaluated"), 6).alias("recall"), share(F.col("matched"), F.col("matched") + F.col("false_positives"), 6).alias("precision"), F.round("mean_far", 6).alias("mean_far"))


def run_performance(runs: DataFrame) -> DataFrame:
    """Of runs (wall_seconds, media_seconds, frames, deadline_seconds): real-time factor, frames a second, time left before the deadline and the speed-up that it needs; null where a run tells too little."""
    wall, media = F.col("wall_seconds"), F.col("media_seconds")
    return runs.withColumns({
        "realtime_factor": F.round(F.try_divide(wall, media), 6), "frames_per_second": F.round(F.try_divide(F.col("frames").cast("double"), wall), 6),
        "headroom_seconds": F.round(F.col("deadline_seconds") - wall, 6), "needed_speedup": F.round(F.greatest(F.lit(1.0), F.try_divide(wall, F.col("deadline_seconds"))), 6),
    })


def best_windows(actions: DataFrame, keys: Sequence[str], seconds: float, required: Sequence[str], passes: Sequence[str], fps: float) -> DataFrame:
    """of windows of so many seconds centred at actions of a required label (and cut at 0) that with the most required actions, then passes, then actions, then the earliest; with its
    bounds in seconds and frames. Each window meets the actions of its buckets."""
    if seconds <= 0:
        raise ValueError("the duration is positive")
    anchors = actions.where(F.col("label").isin(*required)).select(*keys, F.greatest(F.lit(0.0), F.col("clip_seconds") - seconds / 2).alias("start_")).distinct().withColumn("end_", F.col("start_") + seconds)
    pairs = joins.in_interval(actions.select(*keys, "clip_seconds", "label"), anchors, keys, "clip_seconds", "start_", "end_", seconds)
    counts = pairs.groupBy(*keys, "start_").agg(F.count_if(F.col("label").isin(*required)).alias("required"), F.count_if(F.col("label").isin(*passes)).alias("passes"), F.count(F.lit(1)).alias("actions"))
    best = counts.groupBy(*keys).agg(F.max(F.struct("required", "passes", "actions", (-F.col("start_")).alias("early"))).alias("b"))
    start = -F.col("b.early")
    frame = lambda t: F.bround(t * fps).cast("long")
    return best.select(*keys, F.round(start, 3).alias("start_seconds"), F.round(start + seconds, 3).alias("end_seconds"), frame(start).alias("start_frame"), frame(start + seconds).alias("end_frame"), "b.required", "b.passes", "b.actions")


def clip_plans(asked: DataFrame, segment: float, longest: float) -> DataFrame:
    """for clips (start_seconds, duration_seconds) of sources (source_seconds) cut into segments: the segments that cover them, and where the clip starts in them. A clip that starts
    before 0 or after its source, or lasts 0 or more than `longest`, has no plan."""
    start, length = F.col("start_seconds"), F.col("duration_seconds")
    rows = asked.where((start >= 0) & (length > 0) & (length <= longest) & (start < F.col("source_seconds")))
    first = F.floor(start / segment)
    taken = F.least(length, F.col("source_seconds") - start)
    plan = {"first_segment": first, "segment_count": F.ceil((start - first * segment + taken) / segment), "source_start_seconds": F.round(first * segment, 3), "clip_start_seconds": F.round(start - first * segment, 3), "duration_seconds": F.round(taken, 3)}
    return rows.select(*[c for c in asked.columns if c != "duration_seconds"], *[c.alias(n) for n, c in plan.items()])


def detection_changes(before: DataFrame, after: DataFrame, keys: Sequence[str], tolerance: float) -> DataFrame:
    """M2: boxes (box_no, x, y) of each frame before and after: GAINED, MISSING, MATCH or CHANGED, and how many match one to one, each of before its nearest free one."""
    frame = [*keys, "source_frame"]
    a, b = (df.select(*frame, F.col("box_no").alias(f"{n}_no"), F.col("x").alias(f"{n}_x"), F.col("y").alias(f"{n}_y")) for df, n in ((before, "before"), (after, "after")))
    pairs = a.join(b, frame).withColumn("far", g.distance(F.col("before_x"), F.col("before_y"), F.col("after_x"), F.col("after_y"))).where(F.col("far") <= tolerance)
    matched = joins.greedy_matches(pairs.select(*frame, "before_no", "after_no", "far"), frame, "before_no", "after_no", "far").groupBy(*frame).agg(F.count(F.lit(1)).alias("matched"))
    counts = [df.groupBy(*frame).agg(F.count(F.lit(1)).alias(n)) for df, n in ((before, "before"), (after, "after"))]
    rows = counts[0].join(counts[1], frame, "full_outer").join(matched, frame, "left").fillna(0, ["before", "after", "matched"])
    same = (F.col("matched") == F.col("before")) & (F.col("matched") == F.col("after"))
    status = F.when(F.col("before") == 0, "GAINED").when(F.col("after") == 0, "MISSING").when(same, "MATCH").otherwise("CHANGED")
    return rows.withColumn("status", status)
