"""Joins by frame, time band, interval and order (2C, G). Every join has the clip among its equal keys, and bands are
bucketed, so that no join compares all pairs of a clip."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.functions import geometry as g
from fieldtrace.functions.storage import spread


def nearest_player(boxes: DataFrame, keys: Sequence[str], radius: float) -> DataFrame:
    """For each ball the person of the same frame whose foot is nearest in heights, within the radius; ties to the smaller key."""
    frame = [*keys, "source_frame"]
    bx, by = g.center(g.box())
    balls = boxes.where("class_name = 'sports ball'").select(*frame, F.col("l_partkey").alias("ball_key"), F.col("l_linenumber").alias("ball_line"), bx.alias("ball_x"), by.alias("ball_y"))
    fx, fy = g.foot(g.box())
    people = boxes.where("class_name = 'person'").select(*frame, F.col("l_partkey").alias("player_key"), F.col("l_linenumber").alias("player_line"), fx.alias("foot_x"), fy.alias("foot_y"), g.height(g.box()).alias("height"))
    ratio = F.round(g.distance(F.col("ball_x"), F.col("ball_y"), F.col("foot_x"), F.col("foot_y")) / F.col("height"), 6)
    pairs = balls.join(people, frame).withColumn("ratio", ratio).where(F.col("ratio") <= radius)
    best = F.min(F.struct("ratio", "player_key", "player_line")).alias("best")
    return pairs.groupBy(*frame, "ball_key", "ball_line").agg(best).select(*frame, "ball_key", "ball_line", "best.*")


def within_band(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, other: str, tolerance: float) -> DataFrame:
    """Pairs with abs(at - other) <= tolerance: right rows stand in the buckets around theirs, left rows in one."""
    left = left.withColumn("bucket_", F.floor(F.col(at) / tolerance))
    right = right.withColumn("bucket_", F.explode(F.array(*[F.floor(F.col(other) / tolerance) + d for d in (-1, 0, 1)])))
    return left.join(right, [*keys, "bucket_"]).where(F.abs(F.col(at) - F.col(other)) <= tolerance).drop("bucket_")


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, other: str, values: Sequence[str], forward: bool = False, within: float | None = None) -> DataFrame:
    """To each left row the last right row at or before it (or the first at or after it), null beyond `within`.

    One union and one window over (keys, time): a shuffle by clip and a sort, whatever the number of matches. Of right rows
    with one time the greatest values count.
    """
    best = right.groupBy(*keys, F.col(other).alias("at_")).agg(F.max(F.struct(*values)).alias("value_"))
    rows = left.withColumn("at_", F.col(at)).withColumn("left_", F.lit(1)).unionByName(best.withColumn("left_", F.lit(0)), allowMissingColumns=True)
    side = F.when(F.col("left_") == 0, F.struct(F.col("at_"), F.col("value_")))
    if forward:
        w = Window.partitionBy(*keys).orderBy(F.desc("at_"), "left_").rowsBetween(Window.unboundedPreceding, 0)
    else:
        w = Window.partitionBy(*keys).orderBy("at_", "left_").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("found_", F.last(side, ignorenulls=True).over(w)).where("left_ = 1")
    near = F.lit(True) if within is None else F.abs(F.col("found_.at_") - F.col("at_")) <= within
    out = {other: F.when(near, F.col("found_.at_"))} | {v: F.when(near, F.col(f"found_.value_.{v}")) for v in values}
    return rows.select(*left.columns, *[c.alias(n) for n, c in out.items()])


def in_interval(points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, start: str, end: str, width: float) -> DataFrame:
    """Points with start <= t < end; intervals stand in each bucket of `width` that they touch."""
    points = points.withColumn("bucket_", F.floor(F.col(at) / width))
    intervals = intervals.withColumn("bucket_", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return points.join(intervals, [*keys, "bucket_"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("bucket_")


def contained(inner: DataFrame, outer: DataFrame, keys: Sequence[str], margin: float, width: float) -> DataFrame:
    """Inner intervals (start, end) that lie within an outer one (outer_start, outer_end) by a margin: the start meets the outer intervals of its bucket of `width`."""
    fits = F.col("end") <= F.col("outer_end") - margin
    return in_interval(inner, outer.withColumn("from_", F.col("outer_start") + margin).withColumn("until_", F.col("outer_end") + 1e-9), keys, "start", "from_", "until_", width).where(fits).drop("from_", "until_")


def exists_within(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, other: str, after: float, negate: bool = False) -> DataFrame:
    """Left rows with (without) a right row at 0 < other - at <= after."""
    first = right.select(*keys, other).distinct()
    w = Window.partitionBy(*keys).orderBy(F.desc("at_"), F.desc("left_")).rowsBetween(Window.unboundedPreceding, -1)
    rows = left.withColumn("at_", F.col(at)).withColumn("left_", F.lit(1)).unionByName(first.withColumn("at_", F.col(other)).withColumn("left_", F.lit(0)).drop(other), allowMissingColumns=True)
    # Descending time; at one time left rows come first, so that a right row at the same time is not after.
    nearest = F.last(F.when(F.col("left_") == 0, F.col("at_")), ignorenulls=True).over(w)
    hit = F.coalesce((nearest - F.col("at_") <= after) & (nearest > F.col("at_")), F.lit(False))
    rows = rows.withColumn("hit_", hit).where("left_ = 1")
    return rows.where(~F.col("hit_") if negate else F.col("hit_")).select(*left.columns)


def covisible_pairs(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Unordered pairs of tracks seen in one frame, with the number of frames. A frame's tracks are few; a clip's frames and pairs are counted in one task."""
    per = spread(points.select(*keys, "source_frame", "track_id"), keys).groupBy(*keys, "source_frame").agg(F.array_sort(F.collect_set("track_id")).alias("t"))
    pairs = F.flatten(F.transform("t", lambda a: F.transform(F.filter("t", lambda b: b > a), lambda b: F.struct(a.alias("first_track"), b.alias("second_track")))))
    return per.withColumn("p", F.explode(pairs)).groupBy(*keys, "p").agg(F.count(F.lit(1)).alias("frames")).select(*keys, "p.*", "frames")


def compared(before: DataFrame, after: DataFrame, keys: Sequence[str], limit: float) -> DataFrame:
    """C17: full outer comparison by frame of points (x, y, source): GAINED, MISSING, MOVED (by more than limit), PROVENANCE (another source) or MATCH."""
    a, b = (df.select(*keys, *[F.col(c).alias(f"{p}{c}") for c in ("x", "y", "source")]) for df, p in ((before, "a"), (after, "b")))
    moved = g.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")) > limit
    status = F.when(F.col("ax").isNull(), "GAINED").when(F.col("bx").isNull(), "MISSING").when(moved, "MOVED").when(~F.col("asource").eqNullSafe(F.col("bsource")), "PROVENANCE").otherwise("MATCH")
    return a.join(b, [*keys], "full_outer").withColumn("status", status)


def greedy_matches(candidates: DataFrame, keys: Sequence[str], left: str, right: str, distance: str) -> DataFrame:
    """Candidates (left, right, distance) matched one to one, lefts in order, each to its nearest free right.

    A clip's candidates fold inside an aggregate that carries the rights in use.
    """
    listed = candidates.groupBy(*keys, left).agg(F.array_sort(F.collect_list(F.struct(distance, right))).alias("c"))
    listed = listed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(left).alias("l"), F.col("c")))).alias("all"))
    kind = f"array<struct<l:{candidates.schema[left].dataType.simpleString()},r:{candidates.schema[right].dataType.simpleString()},d:{candidates.schema[distance].dataType.simpleString()}>>"

    def take(acc: Column, one: Column) -> Column:
        free = F.filter(one["c"], lambda c: ~F.exists(acc, lambda m: m["r"] == c[right]))
        match = F.struct(one["l"].alias("l"), free[0][right].alias("r"), free[0][distance].alias("d"))
        return F.when(F.size(free) > 0, F.concat(acc, F.array(match))).otherwise(acc)

    matched = listed.withColumn("m", F.explode(F.aggregate("all", F.array().cast(kind), take)))
    return matched.select(*keys, F.col("m.l").alias(left), F.col("m.r").alias(right), F.col("m.d").alias(distance))
