"""What several detections agree on (I25, I26), where a ball is expected and points that its path vouches for."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.functions import geometry as g
from fieldtrace.operators import points as pts
from fieldtrace.operators.trajectory import path_plausible

#: Fixed values of agreement: reach from the expected place and radius of a group in ball diameters, and how many variants must agree.
REACH, RADIUS, VARIANTS = 7.0, 1.5, 3
#: Fixed values of predictions: samples that a prediction bridges, radius of the corridor in ball diameters and pixels, reach of a score in diameters, lower part of a box that counts as feet, confidence of a person.
SAMPLES, CORRIDOR, PIXELS, SCORED, FEET, PERSON = 4, 2.5, 12.0, 6.0, 0.72, 0.25
GROUPS = "array<struct<sx:double,sy:double,w:double,score:double,members:array<struct<no:bigint,variant:string,x:double,y:double,score:double>>>>"


def grouped(detections: DataFrame, keys: Sequence[str], radius: Column, weighted: bool, rank: Callable[[Column], list[Column]], valid: Callable[[Column], Column] | None = None) -> DataFrame:
    """(keys, nos_): the numbers of the detections (no, variant, x, y, score) of the best group: in order of score, each joins the first group whose centre is within the radius, or starts one; rank orders groups, the first of equal ones counts.

    A group's centre moves with each member, so that a frame's detections, which are few, are one fold in the JVM.
    """
    one = F.struct((-F.col("score")).alias("o"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("no").cast("bigint").alias("no"), F.col("variant").cast("string").alias("variant"), F.col("score").cast("double").alias("score"))
    listed = detections.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("all_"), F.max(radius).alias("radius_"))

    def step(acc: Column, d: Column) -> Column:
        w = d["score"] if weighted else F.lit(1.0)
        near = lambda p: F.coalesce(g.distance(d["x"], d["y"], F.try_divide(p["sx"], p["w"]), F.try_divide(p["sy"], p["w"])) <= F.col("radius_"), F.lit(False))
        place = F.array_position(F.transform(acc, near), True)
        me = F.struct(d["no"].alias("no"), d["variant"].alias("variant"), d["x"].alias("x"), d["y"].alias("y"), d["score"].alias("score"))
        new = F.struct((d["x"] * w).alias("sx"), (d["y"] * w).alias("sy"), w.alias("w"), d["score"].alias("score"), F.array(me).alias("members"))
        more = lambda p: F.struct((p["sx"] + d["x"] * w).alias("sx"), (p["sy"] + d["y"] * w).alias("sy"), (p["w"] + w).alias("w"), (p["score"] + d["score"]).alias("score"), F.concat(p["members"], F.array(me)).alias("members"))
        grown = lambda place: F.when(place == 0, F.concat(acc, F.array(new)).cast(GROUPS)).otherwise(F.transform(acc, lambda p, k: F.when(k + 1 == place, more(p)).otherwise(p)).cast(GROUPS))
        return F.element_at(F.transform(F.array(place), grown), 1)  # the place is looked for once, not for each group

    made = listed.withColumn("groups_", F.aggregate("all_", F.array().cast(GROUPS), step))
    if valid is not None:
        made = made.withColumn("groups_", F.filter("groups_", valid))
    ranked = F.transform("groups_", lambda p, k: F.struct(*[c.alias(f"r{n}") for n, c in enumerate(rank(p))], (-k).alias("k"), p["members"].alias("members")))
    return made.withColumn("best_", F.array_max(ranked)).select(*keys, F.transform("best_.members", lambda m: m["no"]).alias("nos_")).where("nos_ IS NOT NULL")


def of_groups(detections: DataFrame, kept: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Detections of the groups kept. Estimates of exploded rows are too small for Spark to choose a broadcast by, so that the join is told to shuffle; the groups already lie by their keys."""
    return detections.join(kept.hint("merge"), list(keys)).where(F.array_contains("nos_", F.col("no"))).drop("nos_")


def variants_of(group: Column) -> Column:
    return F.size(F.array_distinct(F.transform(group["members"], lambda m: m["variant"])))


def variant_consensus(detections: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Detections (variant, x, y, score, expected_x, expected_y, diameter) that three variants or more agree on: of those within 7 diameters of the expected place the group whose mean is nearest to it, then the one with
    more variants, then with more score. Expected place and diameter belong to the keys."""
    near = g.distance(F.col("x"), F.col("y"), F.col("expected_x"), F.col("expected_y")) <= F.col("diameter") * REACH
    rows = detections.where((F.col("diameter") > 0) & near)
    moved = rows.withColumns({"x": F.col("x") - F.col("expected_x"), "y": F.col("y") - F.col("expected_y")})  # so that the expected place is 0, 0 within a fold
    away = lambda p: -F.sqrt(p["sx"] * p["sx"] + p["sy"] * p["sy"]) / p["w"]
    kept = grouped(moved, keys, F.col("diameter") * RADIUS, False, lambda p: [away(p), variants_of(p), p["score"]], lambda p: variants_of(p) >= VARIANTS)
    return of_groups(detections, kept, keys)


def weighted_consensus(matches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Matches (no, x, y, score, radius) of the largest group around a mean weighted by score, then of that with more score."""
    kept = grouped(matches.withColumn("variant", F.lit(None).cast("string")), keys, F.col("radius"), True, lambda p: [F.size(p["members"]), p["score"]])
    return of_groups(matches, kept, keys)


def predicted_places(points: DataFrame, trusted: DataFrame, keys: Sequence[str], step: int, most: int = SAMPLES) -> DataFrame:
    """I16: points with predicted_x, predicted_y: on the line between the trusted points before and after, if both are within `most` samples, else where the last two lead that follow each other by one sample; null
    without. One window over points and trusted ones (one a frame), whatever their number."""
    w = Window.partitionBy(*keys).orderBy("source_frame")
    at = lambda: F.struct(F.col("source_frame").alias("f"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    sure = trusted.select(*keys, "source_frame", at().alias("here_"), F.lag(at()).over(w).alias("before_")).select(*keys, "source_frame", F.struct("here_", "before_").alias("t_"))
    rows = points.withColumn("row_", F.struct(*points.columns)).select(*keys, "source_frame", "row_").unionByName(sure, allowMissingColumns=True)
    last, following = F.last("t_", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, -1)), F.first("t_", ignorenulls=True).over(w.rangeBetween(1, Window.unboundedFollowing))
    rows = rows.withColumns({"a_": last, "n_": following}).where("row_ IS NOT NULL").select("row_.*", F.col("a_.here_").alias("a_"), F.col("a_.before_").alias("z_"), F.col("n_.here_").alias("n_"))
    f, a, z, n = F.col("source_frame"), F.col("a_"), F.col("z_"), F.col("n_")
    between = F.coalesce((f - a["f"] <= step * most) & (n["f"] - f <= step * most), F.lit(False))
    onward = F.coalesce((a["f"] - z["f"] == step) & (f - a["f"] <= step * most), F.lit(False))
    place = {c: F.when(between, a[c] + (n[c] - a[c]) * ((f - a["f"]) / (n["f"] - a["f"]))).when(onward, a[c] + (a[c] - z[c]) * ((f - a["f"]) / step)) for c in ("x", "y")}
    return rows.select(*points.columns, *[v.alias(f"predicted_{c}") for c, v in place.items()])


def search_modes(points: DataFrame, trusted: DataFrame, people: DataFrame, keys: Sequence[str], step: int, diameter: float) -> DataFrame:
    """I16: points (one row each) with trajectory_score, how near they are to the expected place, and mode: near_feet in the lower part of a sure person's box of their frame, trajectory_corridor near the expected place, else
    global_fallback."""
    frame = [*keys, "source_frame"]
    rows = predicted_places(points, trusted, keys, step)
    feet = people.where(F.col("confidence") >= PERSON).select(*frame, "x1", "x2", (F.col("y1") + (F.col("y2") - F.col("y1")) * FEET).alias("top_"), "y2")
    hit = points.join(feet, frame).where(F.col("x").between(F.col("x1"), F.col("x2")) & F.col("y").between(F.col("top_"), F.col("y2"))).select(*points.columns).distinct().withColumn("feet_", F.lit(True))
    rows = rows.join(hit, points.columns, "left")
    far = g.distance(F.col("x"), F.col("y"), F.col("predicted_x"), F.col("predicted_y"))
    score = F.coalesce(F.greatest(F.lit(0.0), 1 - far / max(PIXELS, diameter * SCORED)), F.lit(0.0))
    mode = F.when(F.col("feet_"), "near_feet").when(far <= max(PIXELS, diameter * CORRIDOR), "trajectory_corridor").otherwise("global_fallback")
    return rows.select(*points.columns, "predicted_x", "predicted_y", score.alias("trajectory_score"), mode.alias("mode"))


def restored(candidates: DataFrame, trusted: DataFrame, keys: Sequence[str], step: int, fps: float, speed: float, size: float = 20.0) -> DataFrame:
    """Candidates of the detector (source_frame, x, y, near_feet) that fill frames without a trusted point (direct: seen by the detector): the only one of its frame in a cell that players' feet hold often, candidates come back to and
    three trusted points confirm; else the only candidate of its frame, if trusted points are beside it or on both sides and the path through it is plausible. `restored_as` tells anchor from path."""
    frame = [*keys, "source_frame"]
    cells = [c.alias(n) for c, n in zip(pts.cell(size), ("cell_x", "cell_y"), strict=True)]
    by_cell = [*keys, "cell_x", "cell_y"]
    anchored = pts.anchored_cells(candidates, keys, size).select(*by_cell)
    held = trusted.where("direct").select(*keys, *cells).groupBy(*by_cell).agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select(*by_cell)
    back = candidates.select(*frame, *cells).groupBy(*by_cell).agg(F.count_distinct("source_frame").alias("n")).where("n >= 2").select(*by_cell)
    confirmed = anchored.join(held, by_cell, "left_semi").join(back, by_cell, "left_semi").withColumn("sure_", F.lit(True))
    own = Window.partitionBy(*frame)
    rows = candidates.join(trusted.select(*frame).distinct(), frame, "left_anti").select("*", *[c.alias(f"{n}") for c, n in zip(pts.cell(size), ("cell_x", "cell_y"), strict=True)])
    rows = rows.join(confirmed, by_cell, "left").withColumns({"all_": F.count(F.lit(1)).over(own), "sures_": F.count("sure_").over(own)})
    by_anchor = rows.where("sure_ AND sures_ = 1").select(*candidates.columns, F.lit("anchor").alias("restored_as"))
    alone = rows.where("sures_ <> 1 AND all_ = 1").select(*candidates.columns)
    # Trusted points beside a candidate, or on both sides of it, by one window over both.
    w = Window.partitionBy(*keys).orderBy("source_frame")
    both = alone.withColumn("row_", F.struct(*alone.columns)).select(*frame, "row_").unionByName(trusted.select(*frame).withColumn("t_", F.lit(1)), allowMissingColumns=True)
    seen = lambda lo, hi: F.count("t_").over(w.rangeBetween(lo, hi)) > 0
    both = both.withColumn("held_", seen(-step, step) | (seen(-4 * step, -1) & seen(1, 4 * step))).where("row_ IS NOT NULL AND held_").select("row_.*")
    fits = path_plausible(both, trusted, keys, step, fps, speed).where("plausible").drop("plausible")
    return by_anchor.unionByName(fits.withColumn("restored_as", F.lit("path")))
