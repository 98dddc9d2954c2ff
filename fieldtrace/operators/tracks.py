"""Windows and folds over ordered points of a track (2E, 2I, 2J). A window's partition is a track of a clip, which a clip's length bounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.functions import geometry as g


def ordered(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("source_frame")


def steps(points: DataFrame, keys: Sequence[str], most_seconds: float) -> DataFrame:
    """Speed between consecutive points of a track; steps of no time or more than most_seconds have none."""
    w = ordered(keys)
    x, y, t = (F.lag(c).over(w) for c in ("x", "y", "clip_seconds"))
    points = points.withColumn("step_seconds", F.col("clip_seconds") - t).withColumn("step", g.distance(F.col("x"), F.col("y"), x, y))
    usable = (F.col("step_seconds") > 0) & (F.col("step_seconds") <= most_seconds)
    return points.withColumn("speed", F.when(usable, F.col("step") / F.col("step_seconds")))


def motion(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For inner points the larger of the speeds in and out, and the cosine of the turn."""
    w = ordered(keys)
    a = {c: F.lag(c).over(w) for c in ("x", "y", "clip_seconds")}
    b = {c: F.lead(c).over(w) for c in ("x", "y", "clip_seconds")}
    points = points.withColumns({"ix": F.col("x") - a["x"], "iy": F.col("y") - a["y"], "it": F.col("clip_seconds") - a["clip_seconds"], "ox": b["x"] - F.col("x"), "oy": b["y"] - F.col("y"), "ot": b["clip_seconds"] - F.col("clip_seconds")})
    points = points.withColumn("in_length", F.sqrt(F.col("ix") * F.col("ix") + F.col("iy") * F.col("iy"))).withColumn("out_length", F.sqrt(F.col("ox") * F.col("ox") + F.col("oy") * F.col("oy")))
    points = points.where("it > 0 AND ot > 0 AND in_length > 0 AND out_length > 0")
    cosine = (F.col("ix") * F.col("ox") + F.col("iy") * F.col("oy")) / (F.col("in_length") * F.col("out_length"))
    return points.withColumn("motion_speed", F.greatest(F.col("in_length") / F.col("it"), F.col("out_length") / F.col("ot"))).withColumn("turn_cosine", cosine).drop("ix", "iy", "it", "ox", "oy", "ot", "in_length", "out_length")


def islands(points: DataFrame, keys: Sequence[str], inside: Column) -> DataFrame:
    """E5: runs of consecutive points for which `inside` holds."""
    w = ordered(keys)
    points = points.withColumn("in_", inside)
    starts = F.col("in_") & ~F.coalesce(F.lag("in_").over(w), F.lit(False))
    points = points.withColumn("island", F.sum(starts.cast("int")).over(w)).where("in_")
    return points.groupBy(*keys, "island").agg(
        F.min("source_frame").alias("start_frame"), F.max("source_frame").alias("end_frame"), F.min("clip_seconds").alias("start_seconds"), F.max("clip_seconds").alias("end_seconds"), F.count(F.lit(1)).alias("points")
    )


def boundary_intervals(points: DataFrame, keys: Sequence[str], polygon: Sequence[tuple[float, float]], margin: float = 12.0, least_seconds: float = 0.4) -> DataFrame:
    """Runs of points farther than `margin` outside, of at least least_seconds; the time of the next point inside, and whether the run opens the clip."""
    w = ordered(keys)
    points = points.withColumn("signed", g.signed_distance(F.col("x"), F.col("y"), polygon))
    outside = F.col("signed") < -margin
    # What follows is looked up backwards: a frame up to the end of the clip would be read anew for each row.
    back = Window.partitionBy(*keys).orderBy(F.desc("source_frame")).rowsBetween(Window.unboundedPreceding, 0)
    points = points.withColumn("resumed_", F.last(F.when(~outside, F.col("clip_seconds")), ignorenulls=True).over(back)).withColumn("row_", F.row_number().over(w))
    starts = outside & F.coalesce(F.lag("signed").over(w) >= -margin, F.lit(True))
    points = points.withColumn("run_", F.sum(starts.cast("int")).over(w)).where(outside)
    out = points.groupBy(*keys, "run_").agg(
        F.min("source_frame").alias("start_frame"), F.max("source_frame").alias("end_frame"), F.min("clip_seconds").alias("start_seconds"), F.max("clip_seconds").alias("end_seconds"),
        F.min("signed").alias("minimum_signed_distance"), F.min("resumed_").alias("resumed_seconds"), (F.min("row_") == 1).alias("starts_outside"),
    )
    return out.where(F.col("end_seconds") - F.col("start_seconds") + 1e-9 >= least_seconds).drop("run_")


def interpolated(points: DataFrame, keys: Sequence[str], step: int, fps: float, most_seconds: float) -> DataFrame:
    """Points on the line between neighbours that are more than `step` frames and at most most_seconds apart, unless the ball came from the way that it would go. They are three
    quarters as sure as the less sure of the two."""
    if step < 1 or fps <= 0 or most_seconds <= 0:
        raise ValueError("step, frame rate and gap are positive")
    w = ordered(keys)
    names = ("source_frame", "clip_seconds", "x", "y", "confidence")
    rows = points.withColumns({f"next_{c}": F.lead(c).over(w) for c in names} | {f"last_{c}": F.lag(c).over(w) for c in ("x", "y")})
    onward = (F.col("x") - F.col("last_x")) * (F.col("next_x") - F.col("x")) + (F.col("y") - F.col("last_y")) * (F.col("next_y") - F.col("y"))
    frames = F.col("next_source_frame") - F.col("source_frame")
    gaps = rows.where((frames > step) & (F.col("next_clip_seconds") - F.col("clip_seconds") <= most_seconds + 1e-6) & (F.col("last_x").isNull() | (onward > 0)))
    filled = gaps.withColumn("frame_", F.explode(F.sequence(F.col("source_frame") + step, F.col("next_source_frame") - 1, F.lit(step).cast("long"))))
    passed = F.col("frame_") - F.col("source_frame")
    line = {c: (F.col(c) + (F.col(f"next_{c}") - F.col(c)) * (passed / frames)).alias(c) for c in ("x", "y")}
    sure = F.round(F.least("confidence", "next_confidence") * 0.75, 6).alias("confidence")
    return filled.select(*keys, F.col("frame_").alias("source_frame"), F.round(F.col("clip_seconds") + passed / fps, 3).alias("clip_seconds"), line["x"], line["y"], sure)


def debounced(releases: DataFrame, keys: Sequence[str], gap: float) -> DataFrame:
    """Of releases (clip_seconds, speed) in order, one a group: a release nearer than gap to the kept one replaces it if it is faster, and so moves the anchor."""
    kind = "array<struct<clip_seconds:double,speed:double>>"
    listed = releases.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("clip_seconds", "speed"))).alias("all_"))

    def fold(acc: Column, s: Column) -> Column:
        near = (F.size(acc) > 0) & (s["clip_seconds"] - F.try_element_at(acc, F.lit(-1))["clip_seconds"] < gap)
        swap = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(s))
        return F.when(near & (s["speed"] > F.try_element_at(acc, F.lit(-1))["speed"]), swap).when(near, acc).otherwise(F.concat(acc, F.array(s)))

    return listed.withColumn("one_", F.explode(F.aggregate("all_", F.array().cast(kind), fold))).select(*keys, "one_.*")


def coalesced(intervals: DataFrame, keys: Sequence[str], gap: float) -> DataFrame:
    """Stoppages (start_seconds, end_seconds, resumed_seconds, starts_outside, minimum_signed_distance) merged when the next starts 0..gap after the last one resumed and does
    not open the clip; the farthest distance and the number of parts are kept."""
    kind = "array<struct<start_seconds:double,end_seconds:double,resumed_seconds:double,starts_outside:boolean,minimum_signed_distance:double,merged:int>>"
    listed = intervals.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start_seconds", "end_seconds", "resumed_seconds", "starts_outside", "minimum_signed_distance", F.lit(1).alias("merged")))).alias("all_"))

    def fold(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        wait = s["start_seconds"] - last["resumed_seconds"]
        joins = F.coalesce((wait >= 0) & (wait <= gap) & ~s["starts_outside"], F.lit(False))
        both = F.struct(
            last["start_seconds"].alias("start_seconds"), s["end_seconds"].alias("end_seconds"), s["resumed_seconds"].alias("resumed_seconds"), last["starts_outside"].alias("starts_outside"),
            F.least(last["minimum_signed_distance"], s["minimum_signed_distance"]).alias("minimum_signed_distance"), (last["merged"] + 1).alias("merged"),
        )
        return F.when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(both))).otherwise(F.concat(acc, F.array(s)))

    return listed.withColumn("one_", F.explode(F.aggregate("all_", F.array().cast(kind), fold))).select(*keys, "one_.*")


def spells(observations: DataFrame, keys: Sequence[str], gap: float) -> DataFrame:
    """K3, in its plain form: observations of one team and track with at most `gap` between them are one spell."""
    w = ordered(keys)
    same = (F.lag("team").over(w) == F.col("team")) & (F.lag("track_id").over(w) == F.col("track_id")) & (F.col("clip_seconds") - F.lag("clip_seconds").over(w) <= gap)
    marked = observations.withColumn("spell_no", F.sum((~F.coalesce(same, F.lit(False))).cast("int")).over(w))
    return marked.groupBy(*keys, "spell_no", "team", "track_id").agg(
        F.min("clip_seconds").alias("start_seconds"), F.max("clip_seconds").alias("end_seconds"), F.count(F.lit(1)).alias("observations"), F.min_by("x", "source_frame").alias("start_x"), F.max_by("x", "source_frame").alias("end_x")
    )


def transfers(spell_rows: DataFrame, keys: Sequence[str], longest: float) -> DataFrame:
    """K7, in its plain form: from one spell to the next of another track within `longest` seconds: a pass within a team, else a turnover."""
    w = Window.partitionBy(*keys).orderBy("spell_no")
    rows = spell_rows.withColumns({"to_track": F.lead("track_id").over(w), "to_team": F.lead("team").over(w), "to_start": F.lead("start_seconds").over(w)})
    wait = F.col("to_start") - F.col("end_seconds")
    rows = rows.where((F.col("to_track") != F.col("track_id")) & (wait >= 0) & (wait <= longest))
    kind = F.when(F.col("to_team") == F.col("team"), "pass_candidate").otherwise("turnover_candidate")
    return rows.select(*keys, kind.alias("event_type"), F.col("end_seconds").alias("clip_seconds"), "team", F.col("track_id").alias("from_track"), "to_track", F.col("to_start").alias("completion_seconds"))


def control_changes(observations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """K64, its control part: a control candidate whenever the controller is another than before."""
    w = ordered(keys)
    return observations.withColumn("previous_track", F.lag("track_id").over(w)).where("previous_track IS NULL OR previous_track <> track_id")


def actions(frames: DataFrame, keys: Sequence[str], departure: float) -> DataFrame:
    """Of frames with a ball (controller or null, its proximity, scaled_speed of the ball) in order: ball_control_candidate where the controller is another than in the frame
    before, pass_or_shot_candidate where one loses a ball of at least `departure` heights a second. A loss needs a control before it, so one controller has one for each control."""
    w = ordered(keys)
    before = F.lag("controller").over(w)
    rows = frames.withColumn("before_", before)
    gained = F.col("controller").isNotNull() & ~F.col("controller").eqNullSafe(F.col("before_"))
    lost = F.col("controller").isNull() & F.col("before_").isNotNull() & (F.col("scaled_speed") >= departure)
    kind = F.when(gained, "ball_control_candidate").when(lost, "pass_or_shot_candidate")
    sure = F.when(gained, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("proximity")))).otherwise(F.least(F.lit(1.0), F.col("scaled_speed") / (2 * departure)))
    return rows.where(gained | lost).select(*keys, "source_frame", kind.alias("event_type"), F.coalesce("controller", "before_").alias("actor"), F.round(sure, 6).alias("confidence"))
