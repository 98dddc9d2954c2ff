"""Points of tracks: boxes of tiles, cells, speeds, plausibility, association, and what they tell of events (2B - 2E, 2I)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.functions import geometry as g
from fieldtrace.functions.storage import spread
from fieldtrace.operators import joins
from fieldtrace.operators.tracks import ordered


def offset_boxes(boxes: DataFrame) -> DataFrame:
    """Boxes found in a tile (tile_x, tile_y) in the whole frame's coordinates."""
    return boxes.withColumns({c: F.col(c) + F.col("tile_x" if c[0] == "x" else "tile_y") for c in ("x1", "y1", "x2", "y2")})


def in_upper_body(x: Column, y: Column, b: g.Box, part: float = 0.75) -> Column:
    """A point in the upper part of a box."""
    return x.between(b[0], b[2]) & y.between(b[1], b[1] + (b[3] - b[1]) * part)


def upper_body_points(balls: DataFrame, people: DataFrame, keys: Sequence[str], least: float = 0.25) -> DataFrame:
    """Balls with upper_body: whether they lie in the upper three quarters of a confident person's box of their frame."""
    frame = [*keys, "source_frame"]
    p = people.where(F.col("confidence") >= least).select(*frame, *[F.col(c).alias(f"p_{c}") for c in ("x1", "y1", "x2", "y2")])
    hit = in_upper_body(F.col("x"), F.col("y"), g.box("p_"))
    rows = balls.join(p, frame, "left").groupBy(*balls.columns).agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("upper_body"))
    return rows


def rescaled(points: DataFrame, sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Points from a source size (from_width, from_height) to another (to_width, to_height). Sizes are a row for each clip."""
    rows = points.join(sizes, list(keys))
    return rows.withColumns({"x": F.col("x") * F.col("to_width") / F.col("from_width"), "y": F.col("y") * F.col("to_height") / F.col("from_height")}).select(*points.columns)


def cell(size: float) -> list[Column]:
    return [F.bround(F.col(c) / size).cast("long").alias(f"cell_{c}") for c in ("x", "y")]


def anchored_cells(candidates: DataFrame, keys: Sequence[str], size: float, least: int = 2) -> DataFrame:
    """Cells with a candidate near a player's feet in at least so many frames."""
    near = candidates.where("near_feet").groupBy(*keys, *cell(size)).agg(F.count_distinct("source_frame").alias("frames"))
    return near.where(F.col("frames") >= least)


def near_cells(points: DataFrame, cells: DataFrame, keys: Sequence[str], size: float, negate: bool = False) -> DataFrame:
    """Points within `size` of the centre of one of the cells (or of none): each meets the nine cells around it at most."""
    own = cells.select(*keys, F.col("cell_x").alias("cx_"), F.col("cell_y").alias("cy_")).distinct()
    around = F.array(*[F.struct((F.bround(F.col("x") / size).cast("long") + a).alias("cx_"), (F.bround(F.col("y") / size).cast("long") + b).alias("cy_")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    rows = points.withColumn("row_", F.struct(*points.columns)).withColumn("c_", F.explode(around)).withColumns({"cx_": F.col("c_.cx_"), "cy_": F.col("c_.cy_")})
    hit = rows.join(own, [*keys, "cx_", "cy_"]).where(g.distance(F.col("x"), F.col("y"), F.col("cx_") * size, F.col("cy_") * size) <= size).select("row_").distinct()
    marked = points.withColumn("row_", F.struct(*points.columns))
    return marked.join(hit, "row_", "left_anti" if negate else "left_semi").select(*points.columns)


def unanchored_clusters(candidates: DataFrame, keys: Sequence[str], size: float, gap: float = 0.56, least: int = 3, radius: float = 0.25) -> DataFrame:
    """Centres of cells without near-feet candidates (and not anchored) that hold points of `least` frames, with a pause of more than `gap` seconds, all within `radius` cells of the centre."""
    if gap <= 0:
        raise ValueError("the gap is positive")
    anchored = anchored_cells(candidates, keys, size).drop("frames")
    rows = candidates.where("NOT near_feet").select(*keys, "source_frame", "clip_seconds", "x", "y", *cell(size)).join(anchored, [*keys, "cell_x", "cell_y"], "left_anti")
    by = [*keys, "cell_x", "cell_y"]
    w = Window.partitionBy(*by)
    rows = rows.withColumn("wait_", F.col("clip_seconds") - F.lag("clip_seconds").over(w.orderBy("clip_seconds"))).withColumns({"mx_": F.avg("x").over(w), "my_": F.avg("y").over(w)})
    out = rows.groupBy(*by).agg(F.count_distinct("source_frame").alias("frames"), F.max("wait_").alias("pause"), F.first("mx_").alias("x"), F.first("my_").alias("y"), F.max(g.distance(F.col("x"), F.col("y"), F.col("mx_"), F.col("my_"))).alias("spread"))
    return out.where((F.col("frames") >= least) & (F.col("pause") > gap) & (F.col("spread") <= radius * size)).select(*by, "frames", "x", "y")


def trailing_speed(points: DataFrame, keys: Sequence[str], seconds: float, scale: Column) -> DataFrame:
    """Speed over the last `seconds` from the first to the last point, in units of `scale` (a median player height); 0 where no time has passed."""
    w = Window.partitionBy(*keys).orderBy(F.round(F.col("clip_seconds") * 1000).cast("long")).rangeBetween(-round(seconds * 1000), 0)
    a = {c: F.first(c).over(w) for c in ("x", "y", "clip_seconds")}
    took = F.col("clip_seconds") - a["clip_seconds"]
    return points.withColumn("scaled_speed", F.when(took > 0, g.distance(F.col("x"), F.col("y"), a["x"], a["y"]) / F.greatest(F.lit(1.0), scale) / took).otherwise(0.0))


def recent_velocity(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """At each point the median velocity per frame of the last three steps."""
    w = ordered(keys)
    frames = F.col("source_frame") - F.lag("source_frame").over(w)
    rows = points.withColumns({"vx_": (F.col("x") - F.lag("x").over(w)) / frames, "vy_": (F.col("y") - F.lag("y").over(w)) / frames})
    last = w.rowsBetween(-2, 0)
    return rows.withColumns({n: F.coalesce(median_of(F.collect_list(c).over(last)), F.lit(0.0)) for n, c in (("velocity_x", "vx_"), ("velocity_y", "vy_"))}).drop("vx_", "vy_")


def median_of(values: Column) -> Column:
    """The median of an array; null if it is empty."""
    v, n = F.array_sort(values), F.size(values)
    middle = lambda k: F.try_element_at(v, k.cast("int"))
    return F.when(n > 0, (middle(F.floor((n + 1) / 2)) + middle(F.floor((n + 2) / 2))) / 2)


def plausible(points: DataFrame, keys: Sequence[str], speed: float, acceleration: float = 12000.0) -> DataFrame:
    """I8: points with plausible: the step to them is forward in time, at most `speed` fast, and changes the velocity of the step before by at most `acceleration`."""
    w = ordered(keys)
    t = F.col("clip_seconds")
    took = t - F.lag(t).over(w)
    rows = points.withColumns({"took_": took, "vx_": (F.col("x") - F.lag("x").over(w)) / took, "vy_": (F.col("y") - F.lag("y").over(w)) / took})
    change = F.sqrt(F.pow(F.col("vx_") - F.lag("vx_").over(w), F.lit(2)) + F.pow(F.col("vy_") - F.lag("vy_").over(w), F.lit(2))) / ((F.lag("took_").over(w) + F.col("took_")) / 2)
    first = F.lag(t).over(w).isNull()
    second = F.lag(t, 2).over(w).isNull()
    fast = F.sqrt(F.col("vx_") * F.col("vx_") + F.col("vy_") * F.col("vy_"))
    ok = first | ((F.col("took_") > 0) & (fast <= speed) & (second | ((F.lag("took_").over(w) > 0) & (change <= acceleration))))
    return rows.withColumn("plausible", F.coalesce(ok, F.lit(False))).drop("took_", "vx_", "vy_")


def track_overlaps(points: DataFrame, pairs: DataFrame, keys: Sequence[str], least: float = 0.9) -> DataFrame:
    """Of pairs (from_track, to_track) the frames that both are in, and those where the boxes share `least` of the smaller one."""
    frame = [*keys, "source_frame"]
    side = lambda track, p: points.select(*frame, F.col("track_id").alias(track), *[F.col(c).alias(f"{p}_{c}") for c in ("x1", "y1", "x2", "y2")])
    both = pairs.join(side("from_track", "a"), [*keys, "from_track"]).join(side("to_track", "b"), [*frame, "to_track"])
    return both.groupBy(*keys, "from_track", "to_track").agg(F.count_distinct("source_frame").alias("common_frames"), F.count_if(g.overlap_of_smaller(g.box("a_"), g.box("b_")) >= least).alias("overlaps"))


def nearest_in_time(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, other: str, values: Sequence[str], within: float | None = None) -> DataFrame:
    """To each left row the right row nearest in time, the earlier one of two as near; null beyond `within`. Two windows over one union."""
    before = joins.as_of(left, right, keys, at, other, values)
    renamed = right.select(*keys, F.col(other).alias("after_"), *[F.col(v).alias(f"after_{v}") for v in values])
    both = joins.as_of(before, renamed, keys, at, "after_", [f"after_{v}" for v in values], forward=True)
    back, ahead = F.col(at) - F.col(other), F.col("after_") - F.col(at)
    pick = F.coalesce(back <= ahead, F.col("after_").isNull())
    near = F.lit(True) if within is None else F.coalesce(F.least(back, ahead) <= within, F.lit(False))
    chosen = {c: F.when(near, F.when(pick, F.col(c)).otherwise(F.col(a))) for c, a in ((other, "after_"), *((v, f"after_{v}") for v in values))}
    return both.select(*left.columns, *[c.alias(n) for n, c in chosen.items()])


def identities(events: DataFrame, balls: DataFrame, players: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Events with the teams of their sender and receiver in the ball's frame nearest to release and completion."""
    frames = balls.select(*keys, F.col("clip_seconds").alias("ball_seconds"), F.col("source_frame").alias("ball_frame"))
    teams = players.groupBy(*keys, "source_frame", "track_id").agg(F.min("team").alias("team_"))
    for at, track, frame, name in (("clip_seconds", "from_track", "release_frame", "sender_team"), ("completion_seconds", "to_track", "completion_frame", "receiver_team")):
        events = nearest_in_time(events, frames, keys, at, "ball_seconds", ["ball_frame"]).withColumnRenamed("ball_frame", frame).drop("ball_seconds")
        own = teams.select(*keys, F.col("source_frame").alias(frame), F.col("track_id").alias(track), F.col("team_").alias(name))
        events = events.join(own, [*keys, frame, track], "left")
    return events


def chained(events: DataFrame, keys: Sequence[str], seconds: float) -> DataFrame:
    """Events with prior_completion: when the last event that their sender received completed, at most `seconds` before they start."""
    prior = events.where("to_track IS NOT NULL").select(*keys, F.col("to_track").alias("from_track"), F.col("completion_seconds").alias("prior_completion"), F.col("team").alias("prior_team"))
    return joins.as_of(events, prior, [*keys, "from_track"], "clip_seconds", "prior_completion", ["prior_team"], within=seconds)


def in_precedence(streams: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    """G1: streams of events with one schema as one, each event once: that of the first stream that has it."""
    rows = None
    for k, s in enumerate(streams):
        one = s.withColumn("stream_no", F.lit(k))
        rows = one if rows is None else rows.unionByName(one)
    w = Window.partitionBy(*by).orderBy("stream_no")
    return rows.withColumn("k_", F.row_number().over(w)).where("k_ = 1").drop("k_")


def evidence_summary(balls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Frames with direct and with estimated points, and frames of each state."""
    per = balls.groupBy(*keys).agg(F.count_distinct("source_frame").alias("total_frames"), F.count_distinct(F.when(F.col("eligible"), F.col("source_frame"))).alias("direct_frames"), F.count_distinct(F.when(~F.col("eligible"), F.col("source_frame"))).alias("estimated_frames"))
    states = balls.groupBy(*keys, "state").agg(F.count_distinct("source_frame").alias("frames")).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "state", "frames"))), ",").alias("frames_by_state"))
    return per.join(states, list(keys))


def event_evidence(events: DataFrame, balls: DataFrame, keys: Sequence[str], margin: float = 0.2) -> DataFrame:
    """Events with the evidence of ball points from `margin` before their start to `margin` after their completion: direct, estimated, mixed or unavailable."""
    done = F.coalesce("completion_seconds", "clip_seconds")
    spans = events.withColumn("from_", F.least("clip_seconds", done) - margin).withColumn("until_", F.greatest("clip_seconds", done) + margin + 1e-9).withColumn("event_", F.struct(*events.columns))
    b = balls.select(*keys, F.col("clip_seconds").alias("ball_seconds"), F.col("source_frame").alias("ball_frame"), "eligible", "state", "uncertainty")
    pairs = joins.in_interval(b, spans.select(*keys, "from_", "until_", "event_").distinct(), keys, "ball_seconds", "from_", "until_", 2.0)
    per = pairs.groupBy("event_").agg(F.count_distinct(F.when(F.col("eligible"), F.col("ball_frame"))).alias("direct"), F.count_distinct(F.when(~F.col("eligible"), F.col("ball_frame"))).alias("estimated"), F.array_join(F.array_sort(F.collect_set("state")), ",").alias("evidence_types"), F.round(F.max("uncertainty"), 3).alias("most_uncertain"))
    status = F.when((F.col("direct") > 0) & (F.col("estimated") > 0), "mixed").when(F.col("direct") > 0, "direct").when(F.col("estimated") > 0, "estimated").otherwise("unavailable")
    rows = spans.select("event_").distinct().join(per, "event_", "left").fillna(0, ["direct", "estimated"]).withColumn("status", status)
    return rows.select("event_.*", "status", "direct", "estimated", "evidence_types", "most_uncertain")


def spaced(candidates: DataFrame, keys: Sequence[str], order: Sequence[str], apart: float) -> DataFrame:
    """Of candidates of a frame in order those that are farther than `apart` from all kept before them."""
    kind = "array<struct<k:int,x:double,y:double>>"
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = candidates.withColumn("k_", F.row_number().over(w))
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("k_").alias("k"), "x", "y"))).cast(kind).alias("all_"))

    def step(acc: Column, p: Column) -> Column:
        near = F.exists(acc, lambda q: g.distance(p["x"], p["y"], q["x"], q["y"]) <= apart)
        return F.when(near, acc).otherwise(F.concat(acc, F.array(p)))

    kept = listed.select(*keys, F.explode(F.aggregate("all_", F.array().cast(kind), step)).alias("p")).select(*keys, F.col("p.k").alias("k_"))
    return rows.join(kept, [*keys, "k_"]).drop("k_")


def associated(points: DataFrame, keys: Sequence[str], pause: float, speed: float, least: float = 25.0, heights: float = 0.8, overlap: float = 0.25) -> DataFrame:
    """I2 (and, with heights and overlap 0 and least 35, I3): boxes of frames as tracks. A track goes on where its velocity takes its foot; boxes within a gate (least, or `heights` of
    its height and what `speed` allows) are taken in order of distance over the gate (plain distance if heights is 0) less `overlap` times the IoU; others start tracks; a track ends after `pause` seconds unseen.

    The tracks in use depend on all frames before, so that each clip is one group, frames in order; a frame's pairs are a matrix of numpy, of which those within their gates go on. The order of
    a frame's boxes is that of point_no, then of their corners. Clips are bounded and run in parallel.
    """

    fields = points.columns

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[np.lexsort([pdf[c].to_numpy() for c in ("y2", "x2", "y1", "x1", "point_no", "source_frame")])].reset_index(drop=True)
        x1, y1, x2, y2 = (pdf[c].to_numpy(float) for c in ("x1", "y1", "x2", "y2"))
        seconds, area = pdf["clip_seconds"].to_numpy(float), np.maximum(0, x2 - x1) * np.maximum(0, y2 - y1)
        here = np.stack([(x1 + x2) / 2, y2], axis=1)
        # Of each point as the last one of its track: foot, velocity, seconds and share of the gate. A track is a row that its next point replaces.
        state = np.column_stack([here, np.zeros((len(pdf), 2)), seconds, np.maximum(1.0, y2 - y1) * heights])
        boxes, times = list(zip(x1.tolist(), y1.tolist(), x2.tolist(), y2.tolist(), area.tolist(), strict=True)), seconds.tolist()
        track, last, now, made = [0] * len(pdf), [], state[:0], 0
        cuts = np.flatnonzero(np.diff(pdf["source_frame"].to_numpy(), prepend=-1, append=-1)).tolist()
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            took = times[lo] - now[:, 4]
            found = {}
            if len(last):
                expected = now[:, :2] + now[:, 2:4] * took[:, None]
                gate = np.maximum(least, now[:, 5] + speed * took)
                apart = here[lo:hi] - expected[:, None]
                far = np.hypot(apart[..., 0], apart[..., 1])
                fits = far <= gate[:, None]
                rows, columns = fits.nonzero()
                # Only pairs within their gates are looked at further; they come by track and point, so that ties stay in that order.
                cost = (far / gate[:, None] if heights else far)[fits].tolist()
                pairs = []
                for c, i, j in zip(cost, rows.tolist(), columns.tolist(), strict=True):
                    if overlap:
                        a, b = boxes[last[i]], boxes[lo + j]
                        wide, tall = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
                        both = wide * tall if wide > 0 and tall > 0 else 0.0
                        union = a[4] + b[4] - both
                        c -= overlap * (both / union if union > 0 else 0.0)
                    pairs.append((c, i, j))
                taken = set()
                for _, i, j in sorted(pairs):
                    if i not in taken and j not in found:
                        taken.add(i)
                        found[j] = i
            for j, i in found.items():
                p, q = lo + j, last[i]
                step = times[p] - times[q]
                track[p], last[i] = track[q], p
                if step > 0:
                    state[p, 2:4] = (here[p] - here[q]) / step
            for p in range(lo, hi):
                if p - lo not in found:
                    made += 1
                    track[p] = made
                    last.append(p)
            if hi < len(track):
                last = [p for p in last if times[hi] - times[p] <= pause]
                now = state[last]
        return pdf.assign(track_id=track)[[*fields, "track_id"]]

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields)
    return spread(points, keys).groupBy(*keys).applyInPandas(follow, f"{kinds}, track_id long")


def temporal_neighbours(candidates: DataFrame, keys: Sequence[str], step: int, speed: float, fps: float) -> DataFrame:
    """Candidates with neighbours: on how many sides (0 to 2) the sample `step` frames away holds a point that a ball of that speed reaches."""
    reach = speed * step / fps
    near = candidates.select(*keys, "source_frame", F.col("x").alias("x_"), F.col("y").alias("y_"))
    rows = candidates.withColumn("row_", F.struct(*candidates.columns))
    sides = None
    for k in (-step, step):
        hit = rows.join(near.withColumn("source_frame", F.col("source_frame") - k), [*keys, "source_frame"]).where(g.distance(F.col("x"), F.col("y"), F.col("x_"), F.col("y_")) <= reach).select("row_").distinct()
        sides = hit if sides is None else sides.unionByName(hit)
    counts = sides.groupBy("row_").agg(F.count(F.lit(1)).alias("n_"))
    return rows.join(counts, "row_", "left").select(*keys, "source_frame", F.coalesce("n_", F.lit(0)).cast("int").alias("neighbours"))


def filled(tracked: DataFrame, states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A clip's one ball track (track_id, x, y) with the states of the frames that it lacks, marked as interpolated. States that are eligible as evidence are never filled in, and a clip with
    several tracks gets none."""
    frame = [*keys, "source_frame"]
    single = tracked.groupBy(*keys).agg(F.min("track_id").alias("track_id"), F.max("track_id").alias("high_")).where("track_id = high_").drop("high_")
    missing = states.where("NOT eligible").join(tracked.select(*frame), frame, "left_anti").join(single, list(keys))
    columns = [*frame, "track_id", "x", "y"]
    return tracked.select(*columns, F.lit(False).alias("interpolated")).unionByName(missing.select(*columns, F.lit(True).alias("interpolated")))


#: Fixed values of the motion model: variances of a step's position and velocity, of a measurement, of a first position and velocity; sigmas, least and largest radius of a search.
NOISE = {"position": 4.0, "velocity": 625.0, "measured": 16.0, "first_position": 16.0, "first_velocity": 40000.0}
SIGMAS, LEAST_RADIUS, LARGEST_RADIUS = 2.5, 12.0, 140.0


def predicted(frames: DataFrame, keys: Sequence[str], fps: float) -> DataFrame:
    """Of sampled frames (source_frame; x, y where the ball was trusted, else null) those without a measurement, once there was one: where a constant-velocity Kalman filter expects the ball, and
    the radius to search, 2.5 sigma within 12 to 140. The axes are independent and share one covariance, so the state of the fold is seven numbers."""
    kind = "array<struct<source_frame:bigint,x:double,y:double,radius:double>>"
    listed = frames.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("source_frame", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))).alias("all_"))
    names = ("frame", "x", "vx", "y", "vy", "p", "c", "v")
    none = F.struct(*[F.lit(None).cast("bigint" if n == "frame" else "double").alias(n) for n in names], F.array().cast(kind).alias("out"))

    def step(acc: Column, m: Column) -> Column:
        def now(frame: Column, x: Column, vx: Column, y: Column, vy: Column, p: Column, c: Column, v: Column, out: Column) -> Column:
            return F.struct(*[a.alias(n) for a, n in zip((frame, x, vx, y, vy, p, c, v, out), (*names, "out"), strict=True)])

        zero = F.lit(0.0)
        first = now(m["source_frame"], m["x"], zero, m["y"], zero, F.lit(NOISE["first_position"]), zero, F.lit(NOISE["first_velocity"]), acc["out"])
        dt = (m["source_frame"] - acc["frame"]) / F.lit(fps)
        x, y = acc["x"] + acc["vx"] * dt, acc["y"] + acc["vy"] * dt
        p, c, v = acc["p"] + 2 * dt * acc["c"] + dt * dt * acc["v"] + NOISE["position"], acc["c"] + dt * acc["v"], acc["v"] + NOISE["velocity"]
        gain, turn = p / (p + NOISE["measured"]), c / (p + NOISE["measured"])
        seen = now(m["source_frame"], x + gain * (m["x"] - x), acc["vx"] + turn * (m["x"] - x), y + gain * (m["y"] - y), acc["vy"] + turn * (m["y"] - y), (1 - gain) * p, (1 - gain) * c, v - turn * c, acc["out"])
        radius = F.least(F.lit(LARGEST_RADIUS), F.greatest(F.lit(LEAST_RADIUS), SIGMAS * F.sqrt(p)))
        guess = F.array(F.struct(m["source_frame"].alias("source_frame"), x.alias("x"), y.alias("y"), radius.alias("radius")))
        missed = now(m["source_frame"], x, acc["vx"], y, acc["vy"], p, c, v, F.concat(acc["out"], guess))
        return F.when(acc["frame"].isNull(), F.when(m["x"].isNotNull(), first).otherwise(acc)).when(m["x"].isNull(), missed).otherwise(seen)

    return listed.select(*keys, F.explode(F.aggregate("all_", none, step, lambda acc: acc["out"])).alias("p")).select(*keys, "p.*")
