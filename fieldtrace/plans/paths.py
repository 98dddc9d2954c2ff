"""Queries of the ball's trajectory and of a match's first seconds, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrace.operators import consensus, goals, initial, trajectory
from fieldtrace.plans.catalog import CLIP, query
from fieldtrace.sources import views

#: Frames a second, frames from one sample to the next, size of a frame, and the fastest ball in pixels a second.
FPS, STEP, WIDTH, HEIGHT, SPEED = 25.0, 5, 1400, 520, 900.0

#: Points of several tracks of a ball that moves back and forth, some of them recovered, some far off, none where the event is a signup; and a second candidate at clicks and purchases.
views.SQL["pts"] = """pts AS (SELECT event_id // 500 AS clip_id, event_id % 500 // 40 AS track_id, event_id % 500 * 5 AS source_frame, event_id % 500 / 5.0 AS clip_seconds,
  CAST(abs(event_id % 500 * 23 % 1600 - 800) + user_id % 7 AS DOUBLE) + CASE WHEN event_type = 'error' AND user_id % 4 = 0 THEN 300 ELSE 0 END AS x, CAST(abs(event_id % 500 * 11 % 1000 - 500) + user_id % 5 AS DOUBLE) AS y,
  0.2 + user_id % 10 / 20.0 + value / 1000 AS confidence, CAST(6 + user_id % 5 AS DOUBLE) AS box_diagonal, event_type IN ('click', 'view') AS direct, value / 100 AS temporal_score, event_type, user_id, value FROM events)"""


def points(spark, d):
    """The same; without those of signups."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.where("event_type <> 'signup'").selectExpr(
        "event_id DIV 500 AS clip_id", "event_id % 500 DIV 40 AS track_id", "event_id % 500 * 5 AS source_frame", "CAST(event_id % 500 AS DOUBLE) / 5 AS clip_seconds",
        "CAST(abs(event_id % 500 * 23 % 1600 - 800) + user_id % 7 AS DOUBLE) + CASE WHEN event_type = 'error' AND user_id % 4 = 0 THEN 300 ELSE 0 END AS x", "CAST(abs(event_id % 500 * 11 % 1000 - 500) + user_id % 5 AS DOUBLE) AS y",
        "0.2D + CAST(user_id % 10 AS DOUBLE) / 20 + value / 1000 AS confidence", "CAST(6 + user_id % 5 AS DOUBLE) AS box_diagonal", "event_type IN ('click', 'view') AS direct", "value / 100 AS temporal_score", "event_type", "user_id", "value",
    )


def all_points(spark, d):
    """Those, and others of tracks from 100 on that move against them."""
    own = points(spark, d)
    other = own.where("event_type IN ('click', 'purchase')").withColumns({"track_id": F.col("track_id") + 100, "x": 800 - F.col("x") / 2, "confidence": F.col("confidence") / 2, "direct": F.lit(False)})
    return own.unionByName(other)


def candidates(spark, d):
    """Moving spots in all frames: near the ball's line, on a second line beside it, and astray."""
    e = spark.read.parquet(f"{d}/events.parquet").selectExpr("event_id DIV 500 AS clip_id", "event_id % 500 AS i", "user_id", "value", "explode(sequence(0, 14)) AS k")
    return e.selectExpr(
        "clip_id", "i * 5 + k DIV 3 AS source_frame", "CAST(k % 3 AS BIGINT) AS candidate_no", "abs((i * 5 + k DIV 3) * 4.6D % 1600 - 800) + (user_id + k) % 4 + CASE k % 3 WHEN 1 THEN 12 WHEN 2 THEN 40 + value ELSE 0 END AS x",
        "abs((i * 5 + k DIV 3) * 2.2D % 1000 - 500) + CASE k % 3 WHEN 2 THEN value / 2 ELSE k % 2 END AS y", "CAST(4 + user_id % 3 AS DOUBLE) AS width", "5.0D AS height",
        "CASE WHEN k % 3 = 0 THEN 0.8D + CAST(user_id AS DOUBLE) / 100 ELSE 0.5D + CAST(user_id % 7 AS DOUBLE) / 20 END AS visual_score", "CAST(user_id % 3 AS DOUBLE) / 2 AS attention", "CASE WHEN (user_id + k) % 5 = 0 THEN 'dark' ELSE 'light' END AS mode",
    )


@query("single_trajectory")
def single_trajectory(spark, d):
    return trajectory.single(all_points(spark, d), CLIP, 1.0, SPEED).select("clip_id", "source_frame", "track_id", "x", "y", "confidence")


@query("path_plausibility")
def path_plausibility(spark, d):
    """The others' points against the direct ones."""
    p = all_points(spark, d)
    return trajectory.path_plausible(p.where("NOT direct"), p.where("direct"), CLIP, STEP, FPS, SPEED).select("clip_id", "source_frame", "track_id", "x", "y", "plausible")


def _at(c: str, k: int) -> str:
    return c if k == 0 else f"{'lag' if k < 0 else 'lead'}({c}, {abs(k)}) OVER w"


EXCURSIONS = f""", l AS (SELECT clip_id, source_frame, x, y, direct, {", ".join(f"{_at(c, k)} AS {c[0]}{n}" for c in ("x", "y", "source_frame") for n, k in (("a", -2), ("b", -1), ("c", 1), ("d", 2)))},
  {_at("clip_seconds", 1)} - {_at("clip_seconds", -1)} AS span, coalesce(list_median([q FOR q IN [{", ".join(_at("box_diagonal", k) for k in range(-2, 3))}] IF q > 0]), 1) AS size FROM pts WHERE event_type <> 'signup' WINDOW w AS (PARTITION BY clip_id ORDER BY source_frame))
SELECT clip_id, source_frame, coalesce(NOT direct AND xa IS NOT NULL AND xd IS NOT NULL AND span <= 2 AND sqrt((xa - xb) ** 2 + (ya - yb) ** 2) <= greatest(15, 3 * size) AND sqrt((xb - xc) ** 2 + (yb - yc) ** 2) <= greatest(15, 3 * size)
  AND sqrt((xc - xd) ** 2 + (yc - yd) ** 2) <= greatest(15, 3 * size) AND sqrt((x - xb - (xc - xb) * (source_frame - sb) / (sc - sb)) ** 2 + (y - yb - (yc - yb) * (source_frame - sb) / (sc - sb)) ** 2) >= greatest(100, 10 * size), false) AS excursion FROM l"""


@query("return_excursions", EXCURSIONS, "pts")
def return_excursions(spark, d):
    """A slower ball, so that neighbours stand still together."""
    return trajectory.return_excursions(points(spark, d), CLIP).select("clip_id", "source_frame", "excursion")


@query("final_integrity")
def final_integrity(spark, d):
    """Repaired points, and those that went with the conflict that each was in."""
    return trajectory.repaired(points(spark, d), CLIP, FPS, SPEED).select("clip_id", "source_frame", "x", "y", "confidence", "dropped_as", "drop_no")


ESTIMATES = f""", o AS (SELECT *, (x - lag(x) OVER w) / (source_frame - lag(source_frame) OVER w) AS vx, (y - lag(y) OVER w) / (source_frame - lag(source_frame) OVER w) AS vy FROM pts WHERE event_type NOT IN ('signup', 'error') WINDOW w AS (PARTITION BY clip_id ORDER BY source_frame)),
 v AS (SELECT *, coalesce(median(vx) OVER b, 0) AS bx, coalesce(median(vy) OVER b, 0) AS bey, coalesce(median(vx) OVER f, 0) AS fx, coalesce(median(vy) OVER f, 0) AS fy, lead(vy) OVER w AS ny FROM o
  WINDOW w AS (PARTITION BY clip_id ORDER BY source_frame), b AS (PARTITION BY clip_id ORDER BY source_frame ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), f AS (PARTITION BY clip_id ORDER BY source_frame ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
 g AS (SELECT p.clip_id, p.source_frame, v AS p FROM pts p LEFT JOIN v ON v.clip_id = p.clip_id AND v.source_frame = p.source_frame),
 h AS (SELECT *, last_value(p IGNORE NULLS) OVER (PARTITION BY clip_id ORDER BY source_frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a, first_value(p IGNORE NULLS) OVER (PARTITION BY clip_id ORDER BY source_frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM (SELECT clip_id, source_frame, CASE WHEN p.clip_id IS NOT NULL THEN p END AS p FROM g)),
 i AS (SELECT *, a.clip_id IS NOT NULL AND b.clip_id IS NOT NULL AS mid, source_frame - a.source_frame AS past, b.source_frame - a.source_frame AS span, b.y - a.y AS rise, (a.box_diagonal + b.box_diagonal) / 2 AS size FROM h WHERE p.clip_id IS NOT NULL OR a.clip_id IS NOT NULL OR b.clip_id IS NOT NULL),
 j AS (SELECT *, a.x + (b.x - a.x) * past / span AS lx, a.y + rise * past / span AS ly, rise / span AS m, CASE WHEN a.vy * (rise / span) > 0 THEN abs(a.vy - rise / span) END AS da, CASE WHEN b.ny * (rise / span) > 0 THEN abs(b.ny - rise / span) END AS db FROM i),
 k AS (SELECT *, CASE WHEN da IS NULL AND db IS NULL THEN NULL WHEN db IS NULL OR da <= db THEN a.vy ELSE 2 * m - b.ny END AS v0, CASE WHEN da IS NULL AND db IS NULL THEN NULL WHEN db IS NULL OR da <= db THEN 2 * (rise - a.vy * span) / (span * span) ELSE (b.ny - (2 * m - b.ny)) / span END AS bent, least(da, db) AS dd FROM j),
 c AS (SELECT *, a.y + v0 * past + 0.5 * bent * past * past AS cy FROM k),
 q AS (SELECT *, coalesce(mid AND abs(rise) >= greatest(10, 4 * size) AND dd <= greatest(1, abs(m) / 2) AND abs(cy - ly) <= greatest(2, 0.75 * size), false) AS curved, a.clip_id IS NOT NULL AS after,
  source_frame - coalesce(a.source_frame, b.source_frame) AS delta FROM c),
 r AS (SELECT *, CASE WHEN after THEN a.bx ELSE -b.fx END * delta AS mx, CASE WHEN after THEN a.bey ELSE -b.fy END * delta AS my FROM q),
 s AS (SELECT *, CASE WHEN sqrt(mx * mx + my * my) > {SPEED} * abs(delta) / {FPS} THEN {SPEED} * abs(delta) / {FPS} / sqrt(mx * mx + my * my) ELSE 1 END AS scale, CASE WHEN mid THEN least(past, b.source_frame - source_frame) ELSE abs(delta) END / {STEP} AS gap FROM r)
SELECT clip_id, source_frame, round(source_frame / {FPS}, 3) AS clip_seconds, CASE WHEN p.clip_id IS NOT NULL THEN p.confidence ELSE round(least(0.49, CASE WHEN mid THEN least(a.confidence, b.confidence) ELSE coalesce(a.confidence, b.confidence) END * 0.8 ** gap), 6) END AS confidence,
 CASE WHEN p.clip_id IS NOT NULL THEN p.x ELSE least({WIDTH - 1}, greatest(0, CASE WHEN mid THEN lx ELSE coalesce(a.x, b.x) + mx * scale END)) END AS x,
 CASE WHEN p.clip_id IS NOT NULL THEN p.y ELSE least({HEIGHT - 1}, greatest(0, CASE WHEN curved THEN cy WHEN mid THEN ly ELSE coalesce(a.y, b.y) + my * scale END)) END AS y,
 CASE WHEN p.clip_id IS NOT NULL AND p.direct THEN 'observed' WHEN p.clip_id IS NOT NULL THEN 'visually_reacquired' WHEN curved THEN 'trajectory_estimated_bidirectional_curved' WHEN mid THEN 'trajectory_estimated_bidirectional' WHEN after THEN 'trajectory_estimated_forward' ELSE 'trajectory_estimated_backward' END AS state,
 round(CASE WHEN p.clip_id IS NOT NULL THEN greatest(1, p.box_diagonal / 2) ELSE CASE WHEN mid THEN size ELSE greatest(1, coalesce(a.box_diagonal, b.box_diagonal)) END * (1 + gap) END, 3) AS uncertainty, p.clip_id IS NOT NULL AS eligible FROM s"""


def estimated(spark, d):
    """States of all frames; points of errors are not trusted."""
    e = spark.read.parquet(f"{d}/events.parquet").selectExpr("event_id DIV 500 AS clip_id", "event_id % 500 * 5 AS source_frame")
    return trajectory.state_estimates(e, points(spark, d).where("event_type <> 'error'"), CLIP, FPS, STEP, WIDTH, HEIGHT, SPEED)


@query("state_estimates", ESTIMATES, "pts")
def state_estimates(spark, d):
    return estimated(spark, d).drop("box_diagonal", "temporal_score")


@query("short_bridges")
def short_bridges(spark, d):
    """Gaps between errors and signups, every candidate of a sampled frame being an option."""
    found = trajectory.gaps(points(spark, d).where("event_type IN ('click', 'view', 'purchase') AND user_id % 2 = 0"), CLIP, STEP)
    return trajectory.bridged(candidates(spark, d).withColumn("score", F.col("visual_score")), found, CLIP, STEP, FPS, SPEED)


@query("beam_consensus")
def beam_consensus(spark, d):
    """Gaps where only every fourth user's views are trusted, so that they last some seconds."""
    return trajectory.beam_consensus(candidates(spark, d), points(spark, d).where("event_type = 'view' AND user_id % 4 = 0"), CLIP, STEP, FPS, SPEED)


@query("direction_cones", f""", c AS (SELECT clip_id, source_frame, track_id, x, y, event_type FROM pts WHERE event_type <> 'signup'), p AS (SELECT l_orderkey // 500 AS clip_id, l_orderkey % 500 * 5 AS source_frame, CAST(l_partkey % 800 AS DOUBLE) AS ox, CAST(l_suppkey * 7 % 500 AS DOUBLE) AS oy, cos(l_partkey % 360 / 57.0) AS dx, sin(l_partkey % 360 / 57.0) AS dy, 20.0 + l_linenumber * 10 AS h, 0.2 + l_suppkey % 8 / 10.0 AS w FROM lineitem),
 j AS (SELECT c.*, w, h, sqrt((x - ox) ** 2 + (y - oy) ** 2) AS far, (x - ox) * dx + (y - oy) * dy AS along FROM c LEFT JOIN p USING (clip_id, source_frame)),
 k AS (SELECT *, greatest(240, h * 12) AS reach, far > 1 AND far <= greatest(240, h * 12) AND along / far >= cos(radians(40)) AS hit FROM j)
SELECT clip_id, source_frame, track_id, x, y, count(*) FILTER (hit) AS cones, round(coalesce(sum(w * (along / far - cos(radians(40))) / (1 - cos(radians(40))) * greatest(0, 1 - far / reach)) FILTER (hit), 0), 6) AS convergence FROM k GROUP BY ALL""", "pts")
def direction_cones(spark, d):
    cones = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr(
        "l_orderkey DIV 500 AS clip_id", "l_orderkey % 500 * 5 AS source_frame", "CAST(l_partkey % 800 AS DOUBLE) AS origin_x", "CAST(l_suppkey * 7 % 500 AS DOUBLE) AS origin_y", "cos(CAST(l_partkey % 360 AS DOUBLE) / 57) AS direction_x", "sin(CAST(l_partkey % 360 AS DOUBLE) / 57) AS direction_y",
        "20.0D + l_linenumber * 10 AS player_height", "0.2D + CAST(l_suppkey % 8 AS DOUBLE) / 10 AS cone_confidence",
    )
    return trajectory.converging(points(spark, d).select("clip_id", "source_frame", "track_id", "x", "y"), cones, CLIP).withColumn("convergence", F.round("convergence", 6))


def opening_tracks(spark, d):
    """Tracked players with colours and places on the pitch: two teams, a keeper at each goal, an official; some clips have kits too much alike."""
    near = "CAST(l_partkey % 100 AS DOUBLE) / 100"
    rows = views.detections(spark, d).withColumn("clip_seconds", F.col("source_frame") / 25).withColumn("k", F.expr("(l_partkey + l_suppkey) % 13")).withColumn("alike", F.expr("clip_id % 7 = 3"))
    rows = rows.selectExpr(
        "clip_id", "k AS track_id", "clip_seconds", f"CASE WHEN k = 10 THEN 0.05 + {near} / 12 WHEN k = 11 THEN 0.95 - {near} / 12 WHEN k = 12 THEN 0.3 + {near} / 3 WHEN k % 2 = 0 THEN 0.1 + {near} / 2 ELSE 0.45 + {near} / 2 END AS x", "CAST(l_suppkey % 50 AS DOUBLE) / 50 AS y",
        "CAST(l_linenumber * 4 + CASE WHEN k = 12 THEN 200 WHEN k >= 10 THEN 40 WHEN k % 2 = 0 OR alike THEN 25 ELSE 160 END AS INT) AS b", "CAST(l_linenumber * 3 + CASE WHEN k >= 10 THEN 190 WHEN k % 2 = 0 OR alike THEN 25 ELSE 60 END AS INT) AS g",
        "CAST(l_linenumber * 2 + CASE WHEN k = 10 THEN 30 WHEN k >= 10 THEN 210 WHEN k % 2 = 0 OR alike THEN 180 ELSE 20 END AS INT) AS r",
    )
    return initial.evidence(rows, CLIP)


def opened(spark, d):
    tracks = opening_tracks(spark, d)
    clips = tracks.select("clip_id").distinct().selectExpr("clip_id", "CAST(clip_id % 2 + 1 AS INT) AS half", "0.0D AS source_start_seconds", "clip_id % 5 <> 4 AS starts_at_kickoff")
    return initial.initialization(clips, tracks, CLIP)


@query("match_initialization")
def match_initialization(spark, d):
    """Results as text, team by team and keeper by keeper."""
    return opened(spark, d).withColumns({c: F.to_json(c) for c in ("teams", "official_track_ids", "goalkeepers", "directions", "abstention_reasons")})


@query("side_switches")
def side_switches(spark, d):
    """Two clips after one another are the halves of a match; one in three changes sides, seen as a mirrored pitch."""
    mirrored = opening_tracks(spark, d).withColumn("positions", F.when((F.col("clip_id") % 2 == 1) & (F.col("clip_id") % 3 == 1), F.transform("positions", lambda p: F.struct((1 - p["x"]).alias("x"), p["y"].alias("y")))).otherwise(F.col("positions")))
    clips = mirrored.select("clip_id").distinct().selectExpr("clip_id", "CAST(clip_id % 2 + 1 AS INT) AS half", "0.0D AS source_start_seconds", "true AS starts_at_kickoff")
    return initial.side_switch(initial.initialization(clips, mirrored, CLIP).withColumn("match_id", F.expr("clip_id DIV 2")), ["match_id"])


def cameras(spark, d):
    """A camera for each supplier and side: goals in perspective, some with corners that don't fit."""
    rows = spark.read.parquet(f"{d}/supplier.parquet").selectExpr("s_suppkey AS camera_id", "explode(array('left', 'right')) AS side")
    rows = rows.selectExpr("*", "300.0D + camera_id % 50 * 3 AS x0", "260.0D + camera_id % 20 * 2 AS y0", "camera_id % 17 AS odd", "CASE WHEN side = 'left' THEN 1.0D ELSE -1.0D END AS way")
    at = lambda x, y: f"named_struct('x', {x}, 'y', {y})"
    # Posts' bases on the line, the farther one higher in the image and its post shorter.
    far, near = ("x0", "y0"), ("x0 + way * (40 + camera_id % 9)", "y0 + 70 + camera_id % 11")
    corners = [at(f"{near[0]} + CASE WHEN odd = 5 THEN way * 60 ELSE 0 END", near[1]), at(far[0], f"{far[1]} - 34"), at(f"{near[0]} + 2", f"{near[1]} - CASE WHEN odd = 7 THEN -9 ELSE 52 END"), at(*far)]
    line = [at("x0 - way * 60", "y0 - 110"), at(*far), at("x0 + way * (60 + camera_id % 9)", "y0 + 110")]
    return rows.selectExpr("camera_id", "side", f"CASE WHEN odd = 3 THEN array({', '.join(corners[:3])}) ELSE array({', '.join(corners)}) END AS polygon", f"array({', '.join(line)}) AS goal_line")


@query("goal_calibrations")
def goal_calibrations(spark, d):
    out = goals.goal_faces(cameras(spark, d))
    return out.select("camera_id", "side", "goal_line_x", "post_low", "post_high", F.round("uncertainty", 6).alias("uncertainty"), F.to_json("corners").alias("corners"), "rejected_as")


@query("calibrated_faces")
def calibrated_faces(spark, d):
    """The ball's points on the face of one camera a clip, as its calibration sees them."""
    left = cameras(spark, d).where("side = 'left'")
    balls = points(spark, d).selectExpr("clip_id", "clip_id % 10 + 1 AS camera_id", "source_frame", "290 + x / 8 AS x", "200 + y / 3 AS y")
    return goals.on_faces(balls, goals.goal_faces(left).drop("side"), ["camera_id"]).select("clip_id", "source_frame", "camera_id", *[F.round(c, 6).alias(c) for c in ("goal_y", "goal_z", "image_distance")], "face")


def spots(spark, d):
    """The moving spots of each sample as detections of several variants."""
    rows = candidates(spark, d).withColumn("sample", F.expr("source_frame DIV 5")).withColumn("no", F.expr("source_frame % 5 * 3 + candidate_no"))
    return rows.selectExpr("clip_id", "sample", "no", "CAST(no % 5 AS STRING) AS variant", "x", "y", "visual_score AS score", "abs(sample * 23.0D % 1600 - 800) - 6 AS expected_x", "abs(sample * 11.0D % 1000 - 500) AS expected_y", "6.0D AS diameter", "9.0D AS radius")


@query("variant_consensus")
def variant_consensus(spark, d):
    return consensus.variant_consensus(spots(spark, d), ["clip_id", "sample"]).select("clip_id", "sample", "no", "variant", "x", "y", "score")


@query("weighted_consensus")
def weighted_consensus(spark, d):
    return consensus.weighted_consensus(spots(spark, d).drop("variant"), ["clip_id", "sample"]).select("clip_id", "sample", "no", "x", "y", "score")


MODES = f""", t AS (SELECT clip_id, source_frame, x, y, lag(source_frame) OVER w AS zf, lag(x) OVER w AS zx, lag(y) OVER w AS zy FROM pts WHERE event_type IN ('click', 'view') WINDOW w AS (PARTITION BY clip_id ORDER BY source_frame)),
 c AS (SELECT clip_id, source_frame, track_id, x, y FROM pts WHERE event_type <> 'signup'), j AS (SELECT c.*, a AS a, b AS b FROM c ASOF LEFT JOIN t a ON a.clip_id = c.clip_id AND a.source_frame < c.source_frame ASOF LEFT JOIN t b ON b.clip_id = c.clip_id AND b.source_frame > c.source_frame),
 k AS (SELECT *, source_frame - a.source_frame <= 20 AND b.source_frame - source_frame <= 20 AS mid, a.source_frame - a.zf = 5 AND source_frame - a.source_frame <= 20 AS onward FROM j),
 p AS (SELECT clip_id, source_frame, track_id, x, y, CASE WHEN mid THEN a.x + (b.x - a.x) * ((source_frame - a.source_frame) / (b.source_frame - a.source_frame)) WHEN onward THEN a.x + (a.x - a.zx) * ((source_frame - a.source_frame) / 5) END AS px,
  CASE WHEN mid THEN a.y + (b.y - a.y) * ((source_frame - a.source_frame) / (b.source_frame - a.source_frame)) WHEN onward THEN a.y + (a.y - a.zy) * ((source_frame - a.source_frame) / 5) END AS py FROM k),
 q AS (SELECT *, sqrt((x - px) ** 2 + (y - py) ** 2) AS far, EXISTS (SELECT 1 FROM det d WHERE d.clip_id = p.clip_id AND d.source_frame * 5 = p.source_frame AND class_name = 'person' AND confidence >= 0.25 AND p.x BETWEEN x1 - 40 AND x2 + 40 AND p.y BETWEEN y1 + (y2 - y1) * 0.72 AND y2) AS feet FROM p)
SELECT clip_id, source_frame, track_id, x, y, round(px, 6) AS predicted_x, round(py, 6) AS predicted_y, round(coalesce(greatest(0, 1 - far / 36), 0), 6) AS trajectory_score, CASE WHEN feet THEN 'near_feet' WHEN far <= 15 THEN 'trajectory_corridor' ELSE 'global_fallback' END AS mode FROM q"""


@query("search_modes", MODES, "pts", "det")
def search_modes(spark, d):
    p = points(spark, d)
    people = views.detections(spark, d).where("class_name = 'person'").withColumns({"source_frame": F.col("source_frame") * 5, "x1": F.col("x1") - 40, "x2": F.col("x2") + 40})
    out = consensus.search_modes(p.select("clip_id", "source_frame", "track_id", "x", "y"), p.where("direct"), people, CLIP, STEP, 6.0)
    return out.withColumns({c: F.round(c, 6) for c in ("predicted_x", "predicted_y", "trajectory_score")})


def detector_spots(spark, d):
    """What the detector saw, often at a few places, some of them at a player's feet."""
    return all_points(spark, d).where("event_type <> 'view' OR track_id >= 100").selectExpr("clip_id", "source_frame", "track_id", "CASE WHEN user_id % 3 = 0 THEN 200.0D + user_id % 2 * 100 ELSE x END AS x", "CASE WHEN user_id % 3 = 0 THEN 100.0D ELSE y END AS y", "user_id % 3 = 0 AND event_type <> 'error' AS near_feet")


def trusted_spots(spark, d):
    return points(spark, d).where("event_type IN ('view', 'click')").withColumns({"x": F.expr("CASE WHEN user_id % 5 = 0 AND event_type = 'view' THEN 202.0D ELSE x END"), "y": F.expr("CASE WHEN user_id % 5 = 0 AND event_type = 'view' THEN 101.0D ELSE y END")}).where("event_type = 'view' OR user_id % 2 = 0")


@query("restored_points")
def restored_points(spark, d):
    return consensus.restored(detector_spots(spark, d), trusted_spots(spark, d), CLIP, STEP, FPS, SPEED)
