"""The ball's one trajectory: selection, plausibility, repair, bridges over gaps, consensus of paths, and a state for every frame (2I).

Points are rows (keys, track_id, source_frame, clip_seconds, x, y, confidence, box_diagonal, direct, temporal_score); direct tells those that the detector saw from those that were recovered.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from fieldtrace.functions import geometry as g
from fieldtrace.functions.storage import spread
from fieldtrace.operators.points import median_of

#: Fixed value: the largest change of velocity, in pixels a second and second.
ACCELERATION = 12000.0
#: Fixed values of return excursions: longest span in seconds, radius of what stands still and least excursion, in ball diameters and pixels.
SPAN, STABLE, STABLE_PIXELS, EXCURSION, EXCURSION_PIXELS = 2.0, 3.0, 15.0, 10.0, 100.0
#: Fixed values of estimated states: decay a sample, highest confidence; least vertical move, largest adjustment of a curve in diameters and pixels, largest share by which velocities differ.
DECAY, MOST, RISE, RISE_PIXELS, BEND, BEND_PIXELS, VARIES = 0.8, 0.49, 4.0, 10.0, 0.75, 2.0, 0.5


def hypot(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def single(points: DataFrame, keys: Sequence[str], pause: float, speed: float, least: float = 0.1, acceleration: float = ACCELERATION) -> DataFrame:
    """Of the points of all tracks the one trajectory of each clip, chosen frame by frame: the current track goes on while that is plausible; after more than `pause` seconds a track of
    three points or more starts anew, the best first; else the reachable point with the best quality less distance over reach. A track's quality is its mean confidence times the root of its
    points; tracks below a mean of `least` have no part. Ties go to the larger confidence, then to the smaller track_id.

    A choice depends on the two points chosen before, so each clip is one fold over its frames, in the JVM; a frame's candidates are an array.
    """
    track = Window.partitionBy(*keys, "track_id")
    mean, n = F.avg("confidence").over(track), F.count(F.lit(1)).over(track)
    good = points.withColumns({"mean_": mean, "n_": n}).where(F.col("mean_") >= least).withColumn("quality_", F.col("mean_") * F.sqrt("n_"))
    one = F.struct(F.col("track_id").alias("track"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("confidence").alias("c"), F.col("quality_").alias("q"), F.col("n_").alias("n"))
    frames = good.groupBy(*keys, "source_frame").agg(F.min("clip_seconds").alias("t"), F.array_sort(F.collect_list(one)).alias("options"))
    listed = frames.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("source_frame", "t", "options"))).alias("frames"))
    kind = "array<struct<source_frame:bigint,track_id:bigint>>"
    place = "struct<t:double,x:double,y:double>"
    start = F.struct(F.lit(None).cast(place).alias("last"), F.lit(None).cast(place).alias("before"), F.lit(None).cast("bigint").alias("track"), F.array().cast(kind).alias("out"))

    def step(acc: Column, frame: Column) -> Column:
        last, before = acc["last"], acc["before"]
        took, came = frame["t"] - last["t"], last["t"] - before["t"]

        def plausible(c: Column) -> Column:
            vx, vy = (c["x"] - last["x"]) / took, (c["y"] - last["y"]) / took
            change = hypot(vx - (last["x"] - before["x"]) / came, vy - (last["y"] - before["y"]) / came) / ((came + took) / 2)
            return last.isNull() | ((took > 0) & (hypot(vx, vy) <= speed) & (before.isNull() | ((came > 0) & (change <= acceleration))))

        def best(options: Column, score) -> Column:
            ranked = F.transform(options, lambda c: F.struct(score(c).alias("s"), c["c"].alias("c"), (-c["track"]).alias("k"), c["x"].alias("x"), c["y"].alias("y")))
            return F.array_max(ranked)

        reach = F.greatest(F.lit(35.0), speed * took)
        far = lambda c: hypot(c["x"] - last["x"], c["y"] - last["y"])
        going = F.filter(frame["options"], lambda c: (c["track"] == acc["track"]) & plausible(c))
        anew = F.filter(frame["options"], lambda c: last.isNull() | (c["n"] >= 3))
        near = F.filter(frame["options"], lambda c: (took > 0) & (far(c) <= reach) & plausible(c))
        chosen = F.when(F.size(going) > 0, best(F.slice(going, 1, 1), lambda c: c["q"])).when(last.isNull() | (took > pause), best(anew, lambda c: c["q"])).otherwise(best(near, lambda c: c["q"] - far(c) / reach))

        def go(p: Column) -> Column:
            here = F.struct(frame["t"].alias("t"), p["x"].alias("x"), p["y"].alias("y")).cast(place)
            out = F.concat(acc["out"], F.array(F.struct(frame["source_frame"].alias("source_frame"), (-p["k"]).alias("track_id"))))
            return F.struct(here.alias("last"), last.alias("before"), (-p["k"]).alias("track"), out.alias("out"))

        return F.element_at(F.transform(F.array(chosen), lambda p: F.when(p.isNull(), acc).otherwise(go(p))), 1)

    chosen = listed.select(*keys, F.explode(F.aggregate("frames", start, step, lambda acc: acc["out"])).alias("p")).select(*keys, "p.*")
    return points.join(chosen, [*keys, "source_frame", "track_id"])


def path_plausible(points: DataFrame, trusted: DataFrame, keys: Sequence[str], step: int, fps: float, speed: float, acceleration: float = ACCELERATION) -> DataFrame:
    """Points with plausible: whether a path through the two trusted points before and the two after, within four samples of `step` frames, keeps to the speed and the acceleration;
    false without any. Points and trusted points stand in one window of frames, so there is one shuffle and no join."""
    place = lambda: F.struct(F.col("source_frame").cast("double").alias("f"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    rows = points.select(*keys, "source_frame", place().alias("own_"), F.lit(None).cast("struct<f:double,x:double,y:double>").alias("trust_"), F.struct(*points.columns).alias("row_"))
    rows = rows.unionByName(trusted.select(*keys, "source_frame", place().alias("own_"), place().alias("trust_")), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("source_frame")
    side = lambda lo, hi: F.array_sort(F.collect_list("trust_").over(w.rangeBetween(lo, hi)))
    rows = rows.withColumns({"prev_": side(-4 * step, -1), "next_": side(1, 4 * step)}).where("row_ IS NOT NULL")
    path = F.concat(F.slice("prev_", -2, 2), F.array("own_"), F.slice("next_", 1, 2))
    path = F.when(F.size("prev_") < 2, F.concat("prev_", F.array("own_"), F.slice("next_", 1, 2))).otherwise(path)
    legs = F.zip_with(F.slice("path_", 1, F.size("path_") - 1), F.slice("path_", 2, F.size("path_") - 1), lambda a, b: F.struct(((b["f"] - a["f"]) / fps).alias("t"), (b["x"] - a["x"]).alias("x"), (b["y"] - a["y"]).alias("y")))
    even = F.forall("legs_", lambda v: (v["t"] > 0) & (hypot(v["x"], v["y"]) / v["t"] <= speed))
    turns = F.zip_with(F.slice("legs_", 1, F.size("legs_") - 1), F.slice("legs_", 2, F.size("legs_") - 1), lambda a, b: hypot(b["x"] / b["t"] - a["x"] / a["t"], b["y"] / b["t"] - a["y"] / a["t"]) / ((a["t"] + b["t"]) / 2))
    known = rows.where("size(prev_) + size(next_) > 0").withColumn("path_", path).withColumn("legs_", legs)
    known = known.withColumn("ok_", F.when(~even, False).when(F.size("legs_") < 2, True).otherwise(F.forall(turns, lambda c: c <= acceleration)))
    alone = rows.where("size(prev_) + size(next_) = 0").withColumn("ok_", F.lit(False))
    return known.select("row_.*", F.col("ok_").alias("plausible")).unionByName(alone.select("row_.*", F.col("ok_").alias("plausible")))


def return_excursions(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Points with excursion: recovered ones far from the line between their neighbours, where two points before and two after stand still together."""
    w = Window.partitionBy(*keys).orderBy("source_frame")
    at = lambda c, k: F.col(c) if k == 0 else F.lag(c, -k).over(w)
    sizes = F.filter(F.array(*[at("box_diagonal", k) for k in range(-2, 3)]), lambda d: d > 0)
    diameter = F.coalesce(median_of(sizes), F.lit(1.0))
    still = lambda i, j: g.distance(at("x", i), at("y", i), at("x", j), at("y", j)) <= F.greatest(F.lit(STABLE_PIXELS), diameter * STABLE)
    span = at("source_frame", 1) - at("source_frame", -1)
    share = (F.col("source_frame") - at("source_frame", -1)) / span
    expected = [at(c, -1) + (at(c, 1) - at(c, -1)) * share for c in ("x", "y")]
    far = g.distance(F.col("x"), F.col("y"), *expected) >= F.greatest(F.lit(EXCURSION_PIXELS), diameter * EXCURSION)
    whole = at("x", -2).isNotNull() & at("x", 2).isNotNull() & ~F.col("direct") & (span > 0) & (at("clip_seconds", 1) - at("clip_seconds", -1) <= SPAN)
    return points.withColumn("excursion", F.coalesce(whole & still(-2, -1) & still(-1, 1) & still(1, 2) & far, F.lit(False)))


class Track:
    """The points of one track that are left, as arrays in order of time; conflicts are looked for in all of them at once."""

    def __init__(self, pdf: pd.DataFrame, fps: float, speed: float, acceleration: float) -> None:
        self.fps, self.speed, self.acceleration = fps, speed, acceleration
        self.frame = pdf["source_frame"].to_numpy(float)
        self.seconds, self.size, self.direct = pdf["clip_seconds"].to_numpy(float), pdf["box_diagonal"].to_numpy(float), pdf["direct"].to_numpy(bool)
        self.xy = pdf[["x", "y"]].to_numpy(float)
        self.rank = np.stack([pdf["confidence"].to_numpy(float), np.nan_to_num(pdf["temporal_score"].to_numpy(float))], axis=1)

    def excursion(self, left: np.ndarray) -> int | None:
        if len(left) < 5:
            return None
        windows = np.lib.stride_tricks.sliding_window_view(left, 5)
        xy, frame = self.xy[windows], self.frame[windows]
        sizes = np.where(self.size[windows] > 0, self.size[windows], np.nan)
        some = ~np.isnan(sizes).all(axis=1)
        diameter = np.ones(len(windows))
        diameter[some] = np.nanmedian(sizes[some], axis=1)
        far = lambda a, b: np.hypot(*(xy[:, a] - xy[:, b]).T)
        still = np.max([far(0, 1), far(1, 3), far(3, 4)], axis=0) <= np.maximum(STABLE_PIXELS, diameter * STABLE)
        span = frame[:, 3] - frame[:, 1]
        share = np.divide(frame[:, 2] - frame[:, 1], span, out=np.zeros(len(span)), where=span > 0)[:, None]
        out = np.hypot(*(xy[:, 2] - xy[:, 1] - (xy[:, 3] - xy[:, 1]) * share).T)
        hit = ~self.direct[windows[:, 2]] & (self.seconds[windows[:, 3]] - self.seconds[windows[:, 1]] <= SPAN) & still & (span > 0) & (out >= np.maximum(EXCURSION_PIXELS, diameter * EXCURSION))
        return int(np.argmax(hit)) + 2 if hit.any() else None

    def conflict(self, left: np.ndarray) -> tuple[str, tuple[int, ...]] | None:
        """The first conflict: places among those left."""
        middle = self.excursion(left)
        if middle is not None:
            return "return_excursion", (middle - 1, middle, middle + 1)
        took = np.diff(self.frame[left]) / self.fps
        move = np.diff(self.xy[left], axis=0)
        velocity = np.divide(move, took[:, None], out=np.zeros_like(move), where=took[:, None] > 0)
        wrong = (took <= 0) | (np.hypot(*velocity.T) > self.speed)
        if wrong.any():
            k = int(np.argmax(wrong))
            return "time" if took[k] <= 0 else "speed", (k, k + 1)
        change = np.hypot(*np.diff(velocity, axis=0).T) / ((took[1:] + took[:-1]) / 2)
        if (change > self.acceleration).any():
            k = int(np.argmax(change > self.acceleration))
            return "acceleration", (k, k + 1, k + 2)
        return None

    def reachable(self, a: int, b: int) -> bool:
        took = (self.frame[b] - self.frame[a]) / self.fps
        return took > 0 and np.hypot(*(self.xy[b] - self.xy[a])) / took <= self.speed

    def rejected(self, left: np.ndarray, places: tuple[int, ...]) -> int:
        """Which point of a conflict goes: the middle one if its neighbours reach each other, else the only one whose absence helps, else the least sure."""
        if len(places) == 3 and self.reachable(left[places[1] - 1], left[places[1] + 1]):
            return places[1]
        helps = [k for k in places if k in (0, len(left) - 1) or self.reachable(left[k - 1], left[k + 1])]
        return min(helps or places, key=lambda k: tuple(self.rank[left[k]]))

    def repaired(self) -> list[tuple[int, str]]:
        """The points that go, in order, with the reasons."""
        left, gone = np.arange(len(self.frame)), []
        while len(left) >= 2 and (found := self.conflict(left)) is not None:
            k = self.rejected(left, found[1])
            gone.append((int(left[k]), found[0]))
            left = np.delete(left, k)
        return gone


def repaired(points: DataFrame, keys: Sequence[str], fps: float, speed: float, acceleration: float = ACCELERATION) -> DataFrame:
    """Points with dropped_as (the conflict: return_excursion, time, speed or acceleration; null for those that stay) and drop_no (in which order they went).

    While a track has a conflict, one point of its first one goes, so that each decision sees what is left. Tracks without any conflict, which windows find, pass by; only the others are
    grouped, each by itself, and repaired in numpy. Of points of one frame the order is that of x and y.
    """
    if fps <= 0 or speed <= 0 or acceleration <= 0:
        raise ValueError("fps, speed and acceleration must be positive")
    w = Window.partitionBy(*keys).orderBy("source_frame", "x", "y")
    took = (F.col("source_frame") - F.lag("source_frame").over(w)) / fps
    rows = return_excursions(points, keys).withColumns({"took_": took, "vx_": F.try_divide(F.col("x") - F.lag("x").over(w), took), "vy_": F.try_divide(F.col("y") - F.lag("y").over(w), took)})
    change = F.try_divide(hypot(F.col("vx_") - F.lag("vx_").over(w), F.col("vy_") - F.lag("vy_").over(w)), (F.col("took_") + F.lag("took_").over(w)) / 2)
    wrong = F.col("excursion") | (F.col("took_") <= 0) | (hypot(F.col("vx_"), F.col("vy_")) > speed) | (F.col("change_") > acceleration)
    rows = rows.withColumn("change_", change).withColumn("bad_", F.bool_or(F.coalesce(wrong, F.lit(False))).over(Window.partitionBy(*keys)))
    fields = points.columns
    schema = StructType([*points.schema, StructField("dropped_as", StringType()), StructField("drop_no", LongType())])

    def repair(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["source_frame", "x", "y"], kind="stable").reset_index(drop=True)
        reason, number = [None] * len(pdf), [None] * len(pdf)
        for n, (k, why) in enumerate(Track(pdf, fps, speed, acceleration).repaired()):
            reason[k], number[k] = why, n + 1
        return pdf[fields].assign(dropped_as=reason, drop_no=pd.array(number, "Int64"))

    clean = rows.where("NOT bad_").select(*fields, F.lit(None).cast("string").alias("dropped_as"), F.lit(None).cast("bigint").alias("drop_no"))
    return clean.unionByName(rows.where("bad_").select(*fields).groupBy(*keys).applyInPandas(repair, schema))


def state_estimates(frames: DataFrame, points: DataFrame, keys: Sequence[str], fps: float, step: int, width: int, height: int, speed: float) -> DataFrame:
    """A state for every sampled frame (keys, source_frame) of clips that have a point: the point itself (observed, or visually_reacquired), or an estimate: between two points on
    their line, or on a bounded vertical curve where one more point beside them moves the same way; before the first and after the last by the median velocity of
    the four nearest points, at most `speed` fast. An estimate's confidence decays and its uncertainty grows with the samples to the nearest point; it is never evidence of events.

    points have one row a frame. What the neighbours' neighbours tell is computed on the points, so that a frame needs the last and the next point alone: two windows over the clip.
    """
    if fps <= 0 or step < 1 or width < 1 or height < 1:
        raise ValueError("dimensions and timing must be positive")
    w = Window.partitionBy(*keys).orderBy("source_frame")
    slope = lambda c: (F.col(c) - F.lag(c).over(w)) / (F.col("source_frame") - F.lag("source_frame").over(w))
    own = points.withColumns({"vx_": slope("x"), "vy_": slope("y")})
    medians = {f"{n}_{s}": F.coalesce(median_of(F.filter(F.collect_list(c).over(rows), lambda v: v.isNotNull())), F.lit(0.0)) for s, rows in (("back", w.rowsBetween(-2, 0)), ("ahead", w.rowsBetween(1, 3))) for n, c in (("x", "vx_"), ("y", "vy_"))}
    own = own.withColumns(medians).withColumn("rise_", F.col("vy_")).withColumn("next_rise_", F.lead("vy_").over(w))
    parts = ["source_frame", "x", "y", "confidence", "box_diagonal", "direct", "temporal_score", *medians, "rise_", "next_rise_"]
    grid = frames.select(*keys, "source_frame").distinct().withColumn("sampled_", F.lit(True))
    rows = own.withColumn("p_", F.struct(*parts)).select(*keys, "source_frame", "p_").join(grid, [*keys, "source_frame"], "full")
    a, b = F.last("p_", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.first("p_", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumns({"a_": a, "b_": b}).where("sampled_ AND coalesce(p_, a_, b_) IS NOT NULL")
    p, a, b, frame = F.col("p_"), F.col("a_"), F.col("b_"), F.col("source_frame")

    span, past, rise = b["source_frame"] - a["source_frame"], frame - a["source_frame"], b["y"] - a["y"]
    line = {c: a[c] + (b[c] - a[c]) * (past / span) for c in ("x", "y")}
    diameter = F.coalesce(median_of(F.filter(F.array(a["box_diagonal"], b["box_diagonal"]), lambda d: d > 0)), F.lit(1.0))
    mean = rise / span
    ends = F.filter(F.array(F.struct(F.abs(a["rise_"] - mean).alias("d"), F.lit(0).alias("end"), a["rise_"].alias("v")), F.struct(F.abs(b["next_rise_"] - mean).alias("d"), F.lit(1).alias("end"), b["next_rise_"].alias("v"))), lambda e: e["v"] * mean > 0)
    end = F.array_min(ends)
    first = F.when(end["end"] == 0, end["v"]).otherwise(2 * mean - end["v"])
    bent = F.when(end["end"] == 0, 2 * (rise - end["v"] * span) / (span * span)).otherwise((end["v"] - first) / span)
    curve = a["y"] + first * past + 0.5 * bent * past * past
    curved = (F.abs(rise) >= F.greatest(F.lit(RISE_PIXELS), diameter * RISE)) & end.isNotNull() & (end["d"] <= F.greatest(F.lit(1.0), F.abs(mean) * VARIES)) & (F.abs(curve - line["y"]) <= F.greatest(F.lit(BEND_PIXELS), diameter * BEND))
    curved = F.coalesce(curved, F.lit(False))

    after = a.isNotNull()
    anchor = lambda c: F.coalesce(a[c], b[c])
    delta = frame - anchor("source_frame")
    move = [F.when(after, a[f"{c}_back"]).otherwise(-b[f"{c}_ahead"]) * delta for c in ("x", "y")]
    length, most = hypot(*move), speed * F.abs(delta) / fps
    scale = F.when((length > most) & (most > 0), most / length).otherwise(1.0)

    between = a.isNotNull() & b.isNotNull()
    gap = F.when(between, F.least(past, b["source_frame"] - frame)).otherwise(F.abs(delta)) / step
    size = F.when(between, diameter).otherwise(F.greatest(F.lit(1.0), anchor("box_diagonal")))
    sure = F.when(between, F.least(a["confidence"], b["confidence"])).otherwise(anchor("confidence"))
    x = F.when(between, line["x"]).otherwise(anchor("x") + move[0] * scale)
    y = F.when(between & curved, curve).when(between, line["y"]).otherwise(anchor("y") + move[1] * scale)
    guess = F.when(between & curved, "trajectory_estimated_bidirectional_curved").when(between, "trajectory_estimated_bidirectional").when(after, "trajectory_estimated_forward").otherwise("trajectory_estimated_backward")
    seen = p.isNotNull()
    inside = lambda v, size: F.least(F.lit(float(size - 1)), F.greatest(F.lit(0.0), v))
    return rows.select(
        *keys, "source_frame", F.round(frame / fps, 3).alias("clip_seconds"), F.when(seen, p["confidence"]).otherwise(F.round(F.least(F.lit(MOST), sure * F.pow(F.lit(DECAY), gap)), 6)).alias("confidence"),
        F.when(seen, p["x"]).otherwise(inside(x, width)).alias("x"), F.when(seen, p["y"]).otherwise(inside(y, height)).alias("y"), F.when(seen, p["box_diagonal"]).otherwise(size).alias("box_diagonal"),
        F.when(seen, p["temporal_score"]).alias("temporal_score"), F.when(seen & p["direct"], "observed").when(seen, "visually_reacquired").otherwise(guess).alias("state"),
        F.round(F.when(seen, F.greatest(F.lit(1.0), p["box_diagonal"] / 2)).otherwise(size * (1 + gap)), 3).alias("uncertainty"), seen.alias("eligible"),
    )


def gaps(points: DataFrame, keys: Sequence[str], step: int) -> DataFrame:
    """Where a trajectory (one point a frame) has no point for more than `step` frames: (keys, gap_no, a: the point before, b: the point after)."""
    w = Window.partitionBy(*keys).orderBy("source_frame")
    here = F.struct(*[F.col(c).cast("double").alias(c) for c in ("source_frame", "x", "y", "box_diagonal")])
    rows = points.select(*keys, "source_frame", F.lag(here).over(w).alias("a"), here.alias("b"))
    rows = rows.where(F.col("source_frame") - F.col("a.source_frame") > step)
    return rows.select(*keys, F.row_number().over(w).cast("long").alias("gap_no"), "a", "b")


def in_gaps(candidates: DataFrame, found: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Candidates between the ends of a gap. Gaps stand in each bucket of `width` frames that they touch. Spark's estimates don't tell exploded rows, of which
    candidates are made, so that neither side is left to be broadcast."""
    start, end = F.col("a.source_frame"), F.col("b.source_frame")
    near = found.withColumn("bucket_", F.explode(F.sequence(F.floor(start / width), F.floor(end / width))))
    rows = candidates.withColumn("bucket_", F.floor(F.col("source_frame") / width)).join(near.hint("merge"), [*keys, "bucket_"])
    return rows.where((F.col("source_frame") > start) & (F.col("source_frame") < end)).drop("bucket_")


@dataclass(frozen=True)
class Bridge:
    """Fixed values of short bridges: longest gap, fewest missing samples, least score of a candidate, candidates a frame, how far apart they are in diameters, weight of attention, cost of
    a change of mode, and by how much the best path must win."""

    most_frames: int = 20
    least_points: int = 3
    least_score: float = 0.5
    options: int = 6
    apart: float = 0.75
    attention: float = 0.05
    switch: float = 0.08
    margin: float = 0.08


def bridged(candidates: DataFrame, found: DataFrame, keys: Sequence[str], step: int, fps: float, speed: float, acceleration: float = ACCELERATION, rule: Bridge = Bridge()) -> DataFrame:  # noqa: B008
    """(keys, gap_no, source_frame, candidate_no, x, y, path_score) for short gaps that one path of candidates (candidate_no, x, y, score, attention, mode) fills in every missing sample: the
    plausible path with the best sum of scores, less a cost for each change of mode, if no other comes near.

    Whether a path may go on depends on its last two candidates, so that the two best paths to each such pair are enough, whatever the number of samples: all combinations are judged
    without being listed. A clip is a group whose gaps have at most `rule.options` candidates a frame; gaps with too few missing samples don't meet candidates at all.
    """
    span = F.col("b.source_frame") - F.col("a.source_frame")
    short = found.where((span <= rule.most_frames) & (F.ceil(span / step) - 1 >= rule.least_points))
    rows = in_gaps(candidates.where(F.col("score") >= rule.least_score), short, keys, rule.most_frames)
    rows = rows.where((F.col("source_frame") - F.col("a.source_frame")) % step == 0).withColumn("worth_", F.col("score") + rule.attention * F.col("attention"))
    rows = rows.select(*keys, "gap_no", "source_frame", "candidate_no", "x", "y", "mode", "worth_", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in ("source_frame", "x", "y", "box_diagonal")])
    kinds = {f.name: f for f in rows.schema}
    schema = StructType([*[kinds[k] for k in keys], kinds["gap_no"], kinds["source_frame"], kinds["candidate_no"], StructField("x", DoubleType()), StructField("y", DoubleType()), StructField("path_score", DoubleType())])

    def bridge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(less_=-pdf["worth_"]).sort_values(["gap_no", "source_frame", "less_", "candidate_no"], kind="stable").reset_index(drop=True)
        out, scores = [], []
        for gap in portions(pdf["gap_no"].to_numpy()):
            path = best_bridge(pdf, gap, step, fps, speed, acceleration, rule)
            if path is not None:
                out += path[1]
                scores += [path[0]] * len(path[1])
        return pdf.loc[out].assign(path_score=np.array(scores, float))[schema.names]

    return rows.groupBy(*keys).applyInPandas(bridge, schema)


def portions(numbers: np.ndarray) -> list[slice]:
    """Where equal numbers stand, in a sorted array."""
    cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
    return [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


def best_bridge(pdf: pd.DataFrame, gap: slice, step: int, fps: float, speed: float, acceleration: float, rule: Bridge) -> tuple[float, list] | None:
    """Score and rows of the winning path of one gap, whose candidates stand in pdf by frame and falling worth."""
    head = {c: pdf[c].iat[gap.start] for c in ("a_source_frame", "a_x", "a_y", "a_box_diagonal", "b_source_frame", "b_x", "b_y", "b_box_diagonal")}
    missing = np.arange(head["a_source_frame"] + step, head["b_source_frame"], step)
    if len(missing) < rule.least_points:
        return None
    sizes = [d for d in (head["a_box_diagonal"], head["b_box_diagonal"]) if d > 0]
    apart = rule.apart * (float(np.median(sizes)) if sizes else 1.0)
    frames, places = pdf["source_frame"].to_numpy()[gap], np.stack([pdf[c].to_numpy(float)[gap] for c in "xy"], axis=1)
    modes, worth = pdf["mode"].to_numpy()[gap], pdf["worth_"].to_numpy(float)[gap]
    layers = [[(None, np.array([head["a_x"], head["a_y"]]), None, 0.0)]]
    for first, end in zip(np.searchsorted(frames, missing, "left"), np.searchsorted(frames, missing, "right"), strict=True):
        kept: list = []
        for k in range(first, end):
            if len(kept) == rule.options:
                break
            if all(np.hypot(*(places[k] - other[1])) > apart for other in kept):
                kept.append((gap.start + k, places[k], modes[k], worth[k]))
        if not kept:
            return None
        layers.append(kept)
    layers.append([(None, np.array([head["b_x"], head["b_y"]]), None, 0.0)])
    times = [step / fps] * len(missing) + [(head["b_source_frame"] - missing[-1]) / fps]
    xy = [np.array([n[1] for n in layer]) for layer in layers]
    # The two best paths (score, rows) to each pair of the last two nodes; the first pair has no velocity before it.
    states: dict[tuple[int, int], list] = {(-1, 0): [(0.0, ())]}
    before = None
    for depth in range(1, len(layers)):
        t, grown = times[depth - 1], {}
        v = (xy[depth][None] - xy[depth - 1][:, None]) / t
        slow = np.hypot(v[..., 0], v[..., 1]) <= speed
        if before is None:
            may = slow[None]
        else:
            turn = v[None] - before[:, :, None]
            may = slow[None] & ~(np.hypot(turn[..., 0], turn[..., 1]) / ((times[depth - 2] + t) / 2) > acceleration)
        before = v
        for (i, j), paths in states.items():
            here = layers[depth - 1][j]
            for k in np.flatnonzero(may[max(i, 0), j]).tolist():
                node = layers[depth][k]
                cost = rule.switch if 1 < depth < len(layers) - 1 and node[2] != here[2] else 0.0
                grown.setdefault((j, k), []).extend((s + node[3] - cost, (*rows, node[0])) for s, rows in paths)
        states = {pair: sorted(paths, key=lambda p: -p[0])[:2] for pair, paths in grown.items()}
    ranked = sorted((p for paths in states.values() for p in paths), key=lambda p: -p[0])
    if not ranked or len(ranked) > 1 and ranked[0][0] - ranked[1][0] < rule.margin:
        return None
    return ranked[0][0], list(ranked[0][1][:-1])


@dataclass(frozen=True)
class Beam:
    """Fixed values of paths of moving candidates: seconds to wait for a launch, least separation of a launch and of progress in diameters (a second), history in seconds, least radius and launch acceleration of a
    search in diameters, seconds of a flight, longest pause in seconds, largest acceleration in pixels, least visual score, what is near the best, radius of agreement in diameters, paths kept, paths
    that must agree, speeds whose reversal counts, cells in which paths are one."""

    wait: float = 0.8
    launch: float = 4.0
    progress: float = 8.0
    history: float = 0.8
    radius: float = 2.0
    kick: float = 80.0
    flight: float = 0.4
    pause: float = 0.12
    acceleration: float = 6250.0
    visual: float = 0.45
    near: float = 0.03
    agree: float = 0.75
    paths: int = 400
    judges: int = 100
    moving: float = 4.0
    cell: float = 8.0


#: Candidates that a task searches at once, and pairs of paths and candidates of one step; no gap is cut, so that a larger one stands alone.
ROWS, PAIRS = 1 << 18, 1 << 20


class Paths:
    """The paths in use, as arrays: the number of their last node, its candidate, velocity (x, y; NaN at first) and score, their first candidate and length; what came before is a chain of parents."""

    FIELDS = ("node", "last", "first", "length", "score", "u", "v")

    def __init__(self, node: np.ndarray, last: np.ndarray, first: np.ndarray, length: np.ndarray, score: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
        self.node, self.last, self.first, self.length, self.score, self.u, self.v = node, last, first, length, score, u, v

    def of(self, at: np.ndarray) -> Paths:
        return Paths(*(getattr(self, c)[at] for c in self.FIELDS))


def distinct_rows(*columns: np.ndarray) -> np.ndarray:
    """Places of the first of equal rows of integers, one array a column; rows are numbers of mixed radix where 62 bits hold them."""
    low = [int(c.min()) for c in columns]
    wide = [int(c.max()) - n + 1 for c, n in zip(columns, low, strict=True)]
    if np.prod([float(n) for n in wide]) >= 2**62:
        return np.unique(np.stack(columns, axis=1), axis=0, return_index=True)[1]
    code = np.zeros(len(columns[0]), np.int64)
    for c, first, n in zip(columns, low, wide, strict=True):
        code = code * n + (c - first)
    order = np.argsort(code, kind="stable")
    return order[begins(code[order])]


def begins(*columns: np.ndarray) -> np.ndarray:
    """Where rows differ from the one before them, the first among them; rows are sorted."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def ranks(numbers: np.ndarray) -> np.ndarray:
    """The place of each number among those equal to it; equal ones stand together."""
    first = begins(numbers)
    return np.arange(len(numbers)) - np.repeat(first, np.diff(np.append(first, len(numbers))))


def beams(gap: np.ndarray, frames: np.ndarray, xy: np.ndarray, visual: np.ndarray, lead: dict[str, np.ndarray], fps: float, speed: float, rule: Beam) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each gap the paths that last longest and score near the best: the gap and mean score of each path, a gap's best first; and (path, candidate) for all their candidates. Candidates are sorted by gap (from 0, without holes) and
    frame; lead has each one's diameter and where its gap starts (frame, x, y, velocity).

    All gaps take their step to the next frame together, as gaps are many and the paths of one are few.
    """
    first, diameter = np.trunc(lead["start_"]).astype(np.int64), lead["diameter_"]
    seed, expected, radius, elapsed = search_prior(lead, frames, fps, speed, rule)
    launched = np.hypot(*(xy - seed).T)
    off = np.hypot(*(xy - expected).T)
    starts = (frames <= first + round(rule.wait * fps)) & (launched >= rule.launch * diameter) & (off <= radius) & (launched <= speed * elapsed)
    begun = np.flatnonzero(starts)
    candidate, parent, nodes = [begun], [np.full(len(begun), -1)], len(begun)
    score = visual[starts] - 0.03 * (frames[starts] - first[starts] - 1) - off[starts] / np.maximum(1.0, radius[starts])
    use = Paths(np.arange(nodes), begun, begun, np.ones(nodes, np.int64), score, np.full(nodes, np.nan), np.full(nodes, np.nan))
    done = [use.of(begun[:0])]
    longest = max(1, round(rule.pause * fps))
    # The frames of gaps that have candidates, one after the other.
    layer = begins(gap, frames)
    sizes = np.diff(np.append(layer, len(gap)))
    own_layer = np.repeat(np.arange(len(layer)), sizes)
    opening = begins(gap[layer])
    closing = np.append(opening[1:], len(layer))
    x, y = np.ascontiguousarray(xy[:, 0]), np.ascontiguousarray(xy[:, 1])
    cells = [own_layer, *(np.unique(np.round(c / rule.cell), return_inverse=True)[1] for c in (x, y))]
    short = gap.astype(np.min_scalar_type(len(opening)))  # few bytes sort fast
    step = 0
    while True:
        own = gap[use.last]
        now = opening[own] + step
        past = now >= closing[own]
        since = frames[layer[np.where(past, 0, now)]] - frames[use.last]
        over = past | (since > longest)
        if over.any():
            done.append(use.of(np.flatnonzero(over)))
            on = np.flatnonzero(~over)
            use, now, since = use.of(on), now[on], since[on]
        if not len(use.node):
            break  # no path starts later
        # Every path stays as it is, too; candidates follow those paths whose last one is earlier.
        ready = np.flatnonzero(since > 0)
        start = layer[now[ready]]
        many = sizes[now[ready]]
        i = np.repeat(ready, many)
        k = np.arange(len(i)) + np.repeat(start - (np.cumsum(many) - many), many)
        u, v, wide = x[k] - x[use.last[i]], y[k] - y[use.last[i]], since[i]
        far, reach = np.hypot(u, v), speed * wide / fps
        may = np.flatnonzero(far <= reach)
        i, k, u, v, wide, far, reach = (c[may] for c in (i, k, u, v, wide, far, reach))
        u, v, before_u, before_v = u / wide, v / wide, use.u[i], use.v[i]
        may = ~(np.hypot(u - before_u, v - before_v) / wide > rule.acceleration / fps**2)
        back = np.flatnonzero(may & (u * before_u + v * before_v < 0))
        may[back] = ~((np.hypot(u[back], v[back]) > rule.moving) & (np.hypot(before_u[back], before_v[back]) > rule.moving))
        may = np.flatnonzero(may)
        i, k, u, v, wide, far, reach = (c[may] for c in (i, k, u, v, wide, far, reach))
        score = use.score[i] + visual[k] - 0.8 * far / np.maximum(1.0, reach) - 0.25 * (wide - 1)
        # A path stands before those that it grew into, where scores are equal.
        place = np.empty(len(use.node) + len(i), np.int64)
        children = np.bincount(i, minlength=len(use.node))
        place[np.arange(len(use.node)) + np.cumsum(children) - children] = np.arange(len(use.node))
        place[np.arange(len(i)) + i + 1] = np.arange(len(use.node), len(place))
        every = joined(use, Paths(use.node[i], k, use.first[i], use.length[i] + 1, score, u, v))
        order = place[np.argsort(-every.score[place], kind="stable")]
        order = order[np.argsort(short[every.last[order]], kind="stable")]
        new, every = order >= len(use.node), every.of(order)
        # Paths of earlier frames are in different cells already.
        fresh = np.flatnonzero(own_layer[every.last] >= opening[gap[every.last]] + step)
        stays = np.ones(len(order), bool)
        if len(fresh):
            at = every.last[fresh]
            stays[fresh] = False
            stays[fresh[distinct_rows(*(c[at] for c in cells), *(np.round(np.nan_to_num(c[fresh]) / rule.cell).astype(np.int64) for c in (every.u, every.v)))]] = True
        stays = np.flatnonzero(stays)
        if len(stays) > rule.paths:
            stays = stays[ranks(gap[every.last[stays]]) < rule.paths]
        use, new = every.of(stays), np.flatnonzero(new[stays])
        candidate.append(use.last[new])
        parent.append(use.node[new])
        use.node[new] = nodes + np.arange(len(new))
        nodes += len(new)
        step += 1
    ended = joined(*done)
    candidate, parent = np.concatenate(candidate), np.concatenate(parent)
    least = max(3, round(rule.flight * fps))
    took = frames[ended.last] - frames[ended.first]
    far = np.hypot(*(xy[ended.last] - xy[ended.first]).T)
    whole = ended.of((ended.length >= least) & (took >= least - 1) & (far / (np.maximum(took, 1) / fps) >= diameter[ended.last] * rule.progress))
    most = np.full(len(opening), -1)
    np.maximum.at(most, gap[whole.last], own_layer[whole.last])
    whole = whole.of(own_layer[whole.last] == most[gap[whole.last]])
    mean, best = whole.score / whole.length, np.full(len(opening), -np.inf)
    np.maximum.at(best, gap[whole.last], mean)
    near = np.flatnonzero(mean >= best[gap[whole.last]] - rule.near)
    near = near[np.lexsort((-mean[near], gap[whole.last[near]]))]
    near = near[ranks(gap[whole.last[near]]) < rule.judges]
    path, node, chains = np.arange(len(near)), whole.node[near], []
    while len(node):
        chains.append((path, candidate[node]))
        node = parent[node]
        path, node = path[node >= 0], node[node >= 0]
    chains = [np.concatenate(c) for c in zip(*chains, strict=True)] if chains else [path, node]
    return gap[whole.last[near]], mean[near], *chains


def joined(*some: Paths) -> Paths:
    return Paths(*(np.concatenate([getattr(p, c) for p in some]) for c in Paths.FIELDS))


def lead_velocity(history: np.ndarray, fps: float, speed: float, rule: Beam) -> np.ndarray:
    """How the ball moves at the end of a history (frame, x, y), in pixels a second."""
    recent = history[history[-1, 0] - history[:, 0] <= round(rule.history * fps)]
    took = np.diff(recent[:, 0])
    steps = np.diff(recent[:, 1:], axis=0)[took > 0] * fps / took[took > 0][:, None]
    v = np.median(steps, axis=0) if len(steps) else np.zeros(2)
    fast = np.hypot(*v)
    return v * (speed / fast) if fast > speed else v


def search_prior(lead: dict[str, np.ndarray], frames: np.ndarray, fps: float, speed: float, rule: Beam) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each candidate: where its gap starts, where the ball is expected in its frame, how far from there to look, and the seconds passed."""
    seed, v = (np.stack([lead[f"{c}_x"], lead[f"{c}_y"]], axis=1) for c in ("seed", "lead"))
    elapsed, diameter = np.maximum(0.0, (frames - lead["start_"]) / fps), lead["diameter_"]
    radius = np.maximum(diameter * rule.radius, 0.5 * diameter * rule.kick * elapsed**2)
    return seed, seed + v * elapsed[:, None], np.minimum(radius, speed * elapsed + diameter * rule.radius), elapsed


#: What is known of a gap before it begins.
LEAD = ("start_", "end_", "diameter_", "seed_x", "seed_y", "lead_x", "lead_y")


def leads(points: DataFrame, keys: Sequence[str], step: int, fps: float, speed: float, rule: Beam) -> DataFrame:
    """The gaps of a trajectory, as `gaps` numbers them: (keys, gap_no, start_, end_: frames of the points at their ends, diameter_, seed: the point before, lead: the velocity there). A clip, with its points, is a group."""
    back = max(1, round(rule.history * fps))
    rows = points.select(*keys, *[F.col(c).cast("double").alias(c) for c in ("source_frame", "x", "y", "box_diagonal")]).dropna(subset=[*keys, "source_frame"])
    schema = StructType([*[f for f in rows.schema if f.name in keys], StructField("gap_no", LongType()), *[StructField(c, DoubleType()) for c in LEAD]])

    def of_clip(pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf[["source_frame", "x", "y", "box_diagonal"]].to_numpy(float)
        known = known[np.argsort(known[:, 0], kind="stable")]
        frame, found = known[:, 0], []
        for k in np.flatnonzero(np.diff(frame) > step):
            v = lead_velocity(known[np.searchsorted(frame, frame[k] - back) : k + 1, :3], fps, speed, rule)
            found.append((frame[k], frame[k + 1], np.fmax(1.0, known[k, 3]), *known[k, 1:3], *v))
        out = pd.DataFrame(found, columns=LEAD, dtype=float)
        return out.assign(gap_no=np.arange(1, len(out) + 1), **{k: pdf[k].iat[0] for k in keys})[schema.names]

    return spread(rows, keys).groupBy(*keys).applyInPandas(of_clip, schema)


def agreed(pdf: pd.DataFrame, gap: np.ndarray, step: int, fps: float, speed: float, rule: Beam) -> tuple[np.ndarray, np.ndarray]:
    """Places in pdf of candidates on which the paths of their gap agree, and the best mean score there; gap numbers the gaps of pdf from 0."""
    frames, xy, visual = pdf["source_frame"].to_numpy(np.int64), pdf[["x", "y"]].to_numpy(float), pdf["visual_score"].to_numpy(float)
    lead = {c: pdf[c].to_numpy(float) for c in LEAD}
    of_gap, means, path, at = beams(gap, frames, xy, visual, lead, fps, speed, rule)
    sampled = np.flatnonzero(frames[at] % step == 0)
    path, at = path[sampled], at[sampled]
    order = np.lexsort((path, frames[at], gap[at]))
    path, at = path[order], at[order]
    if not len(at):
        return at, means[:0]
    # The candidates of the paths in one frame, that of the best path first.
    first = begins(gap[at], frames[at])
    many = np.diff(np.append(first, len(at)))
    chosen = np.repeat(at[first], many)
    apart = np.logical_or.reduceat(np.hypot(*(xy[at] - xy[chosen]).T) > rule.agree * lead["diameter_"][at], first)
    best, at = begins(of_gap), at[first]
    everyone = np.diff(np.append(best, len(of_gap)))
    which = np.searchsorted(of_gap[best], gap[at])
    good = (many == everyone[which]) & ~apart & ~(visual[at] < rule.visual)
    return at[good], means[best[which[good]]]


def beam_consensus(candidates: DataFrame, points: DataFrame, keys: Sequence[str], step: int, fps: float, speed: float, rule: Beam = Beam()) -> DataFrame:  # noqa: B008
    """(keys, gap_no, source_frame, x, y, confidence, box_diagonal, temporal_score): in gaps of a trajectory (one point a frame), where paths of candidates (source_frame, x, y, width, height, visual_score) that
    all score near the best agree on a place.

    Paths start near where the last points lead and grow frame by frame within limits of speed, acceleration and reversal; the best 400 in different cells go on. Of those that last longest
    the mean scores near the best count, and a sampled frame is published only where all of them have a candidate within a radius. Candidates find their gap by one union and one window of their
    clip, whose order is that of the search; a task takes some hundred gaps at once, whose paths are arrays of numpy.
    """
    found = leads(points, keys, step, fps, speed, rule)
    order = ["source_frame", "x", "y", "visual_score", "width", "height"]
    kinds = {f.name: f for f in candidates.schema}
    heads = found.select(*[F.col(k).cast(kinds[k].dataType).alias(k) for k in keys], F.col("start_").cast("long").alias("source_frame"), F.struct("gap_no", *LEAD).alias("gap_"))
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = spread(candidates.select(*keys, *order).unionByName(heads, allowMissingColumns=True), keys)
    rows = rows.withColumn("head_", F.col("gap_").isNotNull()).withColumn("gap_", F.last("gap_", ignorenulls=True).over(w))
    rows = rows.where(~F.col("head_") & (F.col("source_frame") > F.col("gap_.start_")) & (F.col("source_frame") < F.col("gap_.end_")))
    rows = rows.select(*keys, *order, "gap_.*").sortWithinPartitions(*keys, *order)
    numbers = [StructField(c, DoubleType()) for c in ("x", "y", "confidence", "box_diagonal", "temporal_score")]
    schema = StructType([*[kinds[k] for k in keys], StructField("gap_no", LongType()), kinds["source_frame"], *numbers])

    def agree(pdf: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
        many = np.diff(np.append(first, len(pdf)))
        gap = np.repeat(np.arange(len(first)), many)
        layer = begins(gap, pdf["source_frame"].to_numpy())
        densest = np.maximum.reduceat(np.diff(np.append(layer, len(pdf))), begins(gap[layer]))
        # Gaps whose pairs in a step stay below the limit together.
        part = np.cumsum(np.minimum(many, rule.paths) * densest) // PAIRS
        found = []
        for a, b in [(p.start, p.stop) for p in portions(part)]:
            rows = slice(first[a], first[b] if b < len(first) else len(pdf))
            at, best = agreed(pdf.iloc[rows], gap[rows] - a, step, fps, speed, rule)
            found.append((first[a] + at, best))
        at, best = (np.concatenate(c) for c in zip(*found, strict=True))
        out = pdf.iloc[at]
        box = np.hypot(out["width"].to_numpy(float), out["height"].to_numpy(float))
        return out.assign(confidence=np.round(out["visual_score"].to_numpy(float), 6), box_diagonal=box, temporal_score=np.round(best, 6))[schema.names]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, rows, enough = [], 0, ROWS
        for batch in batches:
            waiting.append(batch)
            rows += len(batch)
            if rows >= enough:
                pdf = pd.concat(waiting, ignore_index=True)
                first = begins(*[pdf[c].to_numpy() for c in (*keys, "gap_no")])
                if len(first) > 1:
                    yield agree(pdf.iloc[: first[-1]], first[:-1])
                waiting, rows = [pdf.iloc[first[-1] :]], len(pdf) - first[-1]
                enough = max(ROWS, 2 * rows)
        if rows:
            pdf = pd.concat(waiting, ignore_index=True)
            yield agree(pdf, begins(*[pdf[c].to_numpy() for c in (*keys, "gap_no")]))

    return rows.mapInPandas(search, schema)


#: Fixed values of direction cones: half angle in degrees, reach in player heights and pixels; by how many cones and how much score a candidate must lead.
HALF_ANGLE, REACH_HEIGHTS, REACH_PIXELS, LEAD_CONES, LEAD_SCORE = 40.0, 12.0, 240.0, 3, 0.75


def converging(candidates: DataFrame, cones: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidates with cones: how many players' cones (origin_x, origin_y, direction_x, direction_y, player_height, cone_confidence) of their frame hold them, and convergence: the sum of the players' confidence, less
    the farther off the axis and the farther away. A join by frame, whose cones are few."""
    frame = [*keys, "source_frame"]
    least = float(np.cos(np.deg2rad(HALF_ANGLE)))
    rows = candidates.distinct().withColumn("row_", F.struct(*candidates.columns))
    pairs = rows.join(cones, frame)
    dx, dy = F.col("x") - F.col("origin_x"), F.col("y") - F.col("origin_y")
    far, reach = hypot(dx, dy), F.greatest(F.lit(REACH_PIXELS), F.col("player_height") * REACH_HEIGHTS)
    cosine = F.try_divide(dx * F.col("direction_x") + dy * F.col("direction_y"), far)
    pairs = pairs.where((far > 1) & (far <= reach) & (cosine >= least))
    score = F.col("cone_confidence") * ((cosine - least) / (1 - least)) * F.greatest(F.lit(0.0), 1 - far / reach)
    found = pairs.groupBy("row_").agg(F.count(F.lit(1)).alias("cones"), F.sum(score).alias("convergence"))
    return candidates.withColumn("row_", F.struct(*candidates.columns)).join(found, "row_", "left").select(*candidates.columns, F.coalesce("cones", F.lit(0)).cast("long").alias("cones"), F.coalesce("convergence", F.lit(0.0)).alias("convergence"))


def decisive(other: tuple[Column, Column], selected: tuple[Column, Column]) -> Column:
    """Whether another candidate's (cones, convergence) outdo those of the selected one beyond doubt."""
    return (other[0] >= selected[0] + LEAD_CONES) & (other[1] >= selected[1] + LEAD_SCORE)
