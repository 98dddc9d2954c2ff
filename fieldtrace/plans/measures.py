"""Queries of points, cells, association and scores, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldtrace.functions import geometry as g
from fieldtrace.operators import evidence, joins, points, scoring, shots, state, tracks
from fieldtrace.plans import play
from fieldtrace.plans.catalog import CLIP, TRACK, query, r6
from fieldtrace.sources import reviews, views

SPELLS = play.SPELL_VIEWS
FRAME = ["clip_id", "source_frame"]


@query("offset_boxes", "SELECT l_partkey, l_linenumber, clip_id, source_frame, x1 + 460 * (l_suppkey % 3) AS x1, y1 + 230 * (l_suppkey % 2) AS y1, x2 + 460 * (l_suppkey % 3) AS x2, y2 + 230 * (l_suppkey % 2) AS y2 FROM det", "det")
def offset_boxes(spark, d):
    boxes = views.detections(spark, d).withColumns({"tile_x": 460 * (F.col("l_suppkey") % 3), "tile_y": 230 * (F.col("l_suppkey") % 2)})
    return points.offset_boxes(boxes).select("l_partkey", "l_linenumber", "clip_id", "source_frame", "x1", "y1", "x2", "y2")


@query("upper_body_points", """SELECT b.clip_id, b.source_frame, EXISTS (SELECT 1 FROM det p WHERE p.clip_id = b.clip_id AND p.source_frame = b.source_frame AND class_name = 'person' AND confidence >= 0.25 AND b.x BETWEEN x1 AND x2 AND b.y BETWEEN y1 AND y1 + (y2 - y1) * 0.75) AS upper_body FROM bal b""", "det", "bal")
def upper_body_points(spark, d):
    balls = views.balls(spark, d).select("clip_id", "source_frame", "x", "y")
    return points.upper_body_points(balls, views.detections(spark, d).where("class_name = 'person'"), CLIP).select("clip_id", "source_frame", "upper_body")


@query("rescaled_points", "SELECT clip_id, source_frame, x * 1280 / (640 + clip_id % 3 * 64) AS x, y * 720 / (360 + clip_id % 3 * 36) AS y FROM bal", "bal")
def rescaled_points(spark, d):
    balls = views.balls(spark, d)
    sizes = balls.select("clip_id").distinct().selectExpr("clip_id", "640 + clip_id % 3 * 64 AS from_width", "360 + clip_id % 3 * 36 AS from_height", "1280 AS to_width", "720 AS to_height")
    return points.rescaled(balls.select("clip_id", "source_frame", "x", "y"), sizes, CLIP)


@query("restart_laws", "SELECT job_id, " + "CASE " + " ".join(f"WHEN r = '{k}' THEN '{v}'" for k, v in state.LAWS.items()) + " END AS law FROM (SELECT job_id, list_extract(['throw_in', 'corner_kick', 'goal_kick', 'free_kick', 'kick_off', 'penalty_kick', 'no_such_kick'], CAST(job_id % 7 + 1 AS INT)) AS r FROM job)", "job")
def restart_laws(spark, d):
    kinds = F.array(*map(F.lit, ("throw_in", "corner_kick", "goal_kick", "free_kick", "kick_off", "penalty_kick", "no_such_kick")))
    return views.jobs(spark, d).select("job_id", state.law_of(F.get(kinds, (F.col("job_id") % 7).cast("int"))).alias("law"))


#: Candidates: balls, near a player's feet where the event is a click.
views.SQL["can"] = "can AS (SELECT *, state = 'click' AS near_feet FROM bal)"


def candidates(spark, d):
    return views.balls(spark, d).withColumn("near_feet", F.col("state") == "click")


@query("anchored_cells", "SELECT clip_id, CAST(round_even(x / 16, 0) AS BIGINT) AS cell_x, CAST(round_even(y / 16, 0) AS BIGINT) AS cell_y, count(DISTINCT source_frame) AS frames FROM can WHERE near_feet GROUP BY ALL HAVING frames >= 2", "bal", "can")
def anchored_cells(spark, d):
    return points.anchored_cells(candidates(spark, d), CLIP, 16.0)


CELLS = "anc AS (SELECT clip_id, CAST(round_even(x / 16, 0) AS BIGINT) AS cell_x, CAST(round_even(y / 16, 0) AS BIGINT) AS cell_y FROM can WHERE near_feet GROUP BY ALL HAVING count(DISTINCT source_frame) >= 2)"
views.SQL["anc"] = CELLS

for _name, _not in (("near_anchored", ""), ("far_from_anchored", "NOT ")):

    @query(_name, f"SELECT clip_id, source_frame, x, y FROM can c WHERE {_not}EXISTS (SELECT 1 FROM anc a WHERE a.clip_id = c.clip_id AND sqrt(pow(c.x - a.cell_x * 16, 2) + pow(c.y - a.cell_y * 16, 2)) <= 16)", "bal", "can", "anc")
    def _near(spark, d, negate=bool(_not)):
        cells = points.anchored_cells(candidates(spark, d), CLIP, 16.0)
        return points.near_cells(views.balls(spark, d).select("clip_id", "source_frame", "x", "y"), cells, CLIP, 16.0, negate)


@query("unanchored_clusters", """, c AS (SELECT *, CAST(round_even(x / 32, 0) AS BIGINT) AS cell_x, CAST(round_even(y / 32, 0) AS BIGINT) AS cell_y FROM can), a AS (SELECT clip_id, cell_x, cell_y FROM c WHERE near_feet GROUP BY ALL HAVING count(DISTINCT source_frame) >= 2),
 p AS (SELECT *, clip_seconds - lag(clip_seconds) OVER (PARTITION BY clip_id, cell_x, cell_y ORDER BY clip_seconds) AS wait, avg(x) OVER (PARTITION BY clip_id, cell_x, cell_y) AS mx, avg(y) OVER (PARTITION BY clip_id, cell_x, cell_y) AS my FROM c ANTI JOIN a USING (clip_id, cell_x, cell_y) WHERE NOT near_feet)
SELECT clip_id, cell_x, cell_y, count(DISTINCT source_frame) AS frames, round(any_value(mx), 6) AS x, round(any_value(my), 6) AS y FROM p GROUP BY clip_id, cell_x, cell_y HAVING frames >= 2 AND max(wait) > 0.56 AND max(sqrt(pow(x - mx, 2) + pow(y - my, 2))) <= 16""", "bal", "can")
def unanchored_clusters(spark, d):
    return points.unanchored_clusters(candidates(spark, d), CLIP, 32.0, least=2, radius=0.5).withColumns(r6("x", "y"))


@query("trailing_speeds", """SELECT clip_id, source_frame, round(CASE WHEN clip_seconds > first(clip_seconds) OVER w THEN sqrt(pow(x - first(x) OVER w, 2) + pow(y - first(y) OVER w, 2)) / 48 / (clip_seconds - first(clip_seconds) OVER w) ELSE 0 END, 6) AS scaled_speed FROM bal WINDOW w AS (PARTITION BY clip_id ORDER BY CAST(round(clip_seconds * 1000) AS BIGINT) RANGE BETWEEN 400 PRECEDING AND CURRENT ROW)""", "bal")
def trailing_speeds(spark, d):
    return points.trailing_speed(views.balls(spark, d), CLIP, 0.4, F.lit(48.0)).select("clip_id", "source_frame", F.round("scaled_speed", 6).alias("scaled_speed"))


@query("recent_velocities", """SELECT clip_id, source_frame, round(coalesce(list_aggregate(list(vx) OVER w, 'median'), 0), 6) AS velocity_x, round(coalesce(list_aggregate(list(vy) OVER w, 'median'), 0), 6) AS velocity_y FROM (SELECT *, (x - lag(x) OVER v) / (source_frame - lag(source_frame) OVER v) AS vx, (y - lag(y) OVER v) / (source_frame - lag(source_frame) OVER v) AS vy FROM bal WINDOW v AS (PARTITION BY clip_id ORDER BY source_frame)) WINDOW w AS (PARTITION BY clip_id ORDER BY source_frame ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""", "bal")
def recent_velocities(spark, d):
    return points.recent_velocity(views.balls(spark, d), CLIP).select("clip_id", "source_frame", F.round("velocity_x", 6).alias("velocity_x"), F.round("velocity_y", 6).alias("velocity_y"))


@query("plausible_steps", """, a AS (SELECT *, clip_seconds - lag(clip_seconds) OVER w AS took, (x - lag(x) OVER w) / (clip_seconds - lag(clip_seconds) OVER w) AS vx, (y - lag(y) OVER w) / (clip_seconds - lag(clip_seconds) OVER w) AS vy FROM bal WINDOW w AS (PARTITION BY clip_id ORDER BY source_frame)),
 b AS (SELECT *, sqrt(vx * vx + vy * vy) AS v, lag(took) OVER w AS lt, sqrt(pow(vx - lag(vx) OVER w, 2) + pow(vy - lag(vy) OVER w, 2)) / ((lag(took) OVER w + took) / 2) AS acc FROM a WINDOW w AS (PARTITION BY clip_id ORDER BY source_frame))
SELECT clip_id, source_frame, took IS NULL OR coalesce(took > 0 AND v <= 700 AND (lt IS NULL OR (lt > 0 AND acc <= 12000)), false) AS plausible FROM b""", "bal")
def plausible_steps(spark, d):
    return points.plausible(views.balls(spark, d), CLIP, 700.0).select("clip_id", "source_frame", "plausible")


@query("track_overlaps", f""", e AS (SELECT DISTINCT clip_id, from_track, to_track FROM ({play.TRANSFERS}))
SELECT clip_id, from_track, to_track, count(DISTINCT source_frame) AS common_frames, count(*) FILTER (o >= 0.5 * s) AS overlaps FROM (SELECT e.*, a.source_frame, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS o, least((a.x2 - a.x1) * (a.y2 - a.y1), (b.x2 - b.x1) * (b.y2 - b.y1)) AS s FROM e JOIN pla a ON a.clip_id = e.clip_id AND a.track_id = e.from_track JOIN pla b ON b.clip_id = e.clip_id AND b.track_id = e.to_track AND b.source_frame = a.source_frame) GROUP BY ALL""", *SPELLS)
def track_overlaps(spark, d):
    pairs = play.control_transfers(spark, d).select("clip_id", "from_track", "to_track").distinct()
    return points.track_overlaps(views.players(spark, d), pairs, CLIP, 0.5)


@query("nearest_observations", """SELECT a.clip_id, event_no, arg_min(o.source_frame, struct_pack(d := abs(o.clip_seconds - a.at), t := o.clip_seconds)) AS near_frame FROM ask a JOIN ob o ON o.clip_id = a.clip_id AND abs(o.clip_seconds - a.at) <= 0.11 GROUP BY ALL
 UNION ALL SELECT clip_id, event_no, NULL FROM ask a WHERE NOT EXISTS (SELECT 1 FROM ob o WHERE o.clip_id = a.clip_id AND abs(o.clip_seconds - a.at) <= 0.11)""", *SPELLS[:5], "pth", "ask")
def nearest_observations(spark, d):
    seen = play.observed(spark, d).select("clip_id", F.col("clip_seconds").alias("seen_seconds"), F.col("source_frame").alias("near_frame"))
    return points.nearest_in_time(play.asked(spark, d).select("clip_id", "event_no", "at"), seen, CLIP, "at", "seen_seconds", ["near_frame"], 0.11).select("clip_id", "event_no", "near_frame")


@query("event_identities", f""", e AS ({play.TRANSFERS}), r AS (SELECT e.*, (SELECT b.source_frame FROM bal b WHERE b.clip_id = e.clip_id ORDER BY abs(b.clip_seconds - e.clip_seconds), b.clip_seconds LIMIT 1) AS rf, (SELECT b.source_frame FROM bal b WHERE b.clip_id = e.clip_id ORDER BY abs(b.clip_seconds - e.completion_seconds), b.clip_seconds LIMIT 1) AS cf FROM e)
SELECT clip_id, clip_seconds, from_track, to_track, (SELECT min(team) FROM pla p WHERE p.clip_id = r.clip_id AND p.source_frame = rf AND p.track_id = from_track) AS sender_team, (SELECT min(team) FROM pla p WHERE p.clip_id = r.clip_id AND p.source_frame = cf AND p.track_id = to_track) AS receiver_team FROM r""", *SPELLS)
def event_identities(spark, d):
    out = points.identities(play.control_transfers(spark, d), views.balls(spark, d), views.players(spark, d), CLIP)
    return out.select("clip_id", "clip_seconds", "from_track", "to_track", "sender_team", "receiver_team")


@query("chained_events", f""", e AS ({play.TRANSFERS}) SELECT a.clip_id, a.clip_seconds, a.from_track, max(p.completion_seconds) AS prior_completion FROM e a LEFT JOIN e p ON p.clip_id = a.clip_id AND p.to_track = a.from_track AND a.clip_seconds - p.completion_seconds BETWEEN 0 AND 2 GROUP BY a.clip_id, a.clip_seconds, a.from_track, a.to_track""", *SPELLS)
def chained_events(spark, d):
    return points.chained(play.control_transfers(spark, d), CLIP, 2.0).select("clip_id", "clip_seconds", "from_track", "prior_completion")


@query("events_in_precedence", """SELECT clip_id, key, min(s) AS stream_no FROM (SELECT clip_id, source_frame // 4 AS key, 0 AS s FROM pth WHERE event_type = 'click' UNION ALL SELECT clip_id, source_frame // 4, 1 FROM pth WHERE event_type = 'view' UNION ALL SELECT clip_id, source_frame // 4, 2 FROM pth WHERE event_type = 'purchase') GROUP BY ALL""", "pth")
def events_in_precedence(spark, d):
    p = views.path(spark, d).withColumn("key", F.expr("source_frame DIV 4"))
    streams = [p.where(F.col("event_type") == t).select("clip_id", "key") for t in ("click", "view", "purchase")]
    return points.in_precedence(streams, ["clip_id", "key"])


@query("evidence_summary", """SELECT clip_id, count(DISTINCT source_frame) AS total_frames, count(DISTINCT source_frame) FILTER (eligible) AS direct_frames, count(DISTINCT source_frame) FILTER (NOT eligible) AS estimated_frames, (SELECT string_agg(state || ':' || n, ',' ORDER BY state || ':' || n) FROM (SELECT state, count(DISTINCT source_frame) AS n FROM bal c WHERE c.clip_id = b.clip_id GROUP BY 1)) AS frames_by_state FROM bal b GROUP BY clip_id""", "bal")
def evidence_summary(spark, d):
    return points.evidence_summary(views.balls(spark, d), CLIP)


@query("event_evidence", f""", e AS ({play.TRANSFERS}), j AS (SELECT e.clip_id, e.clip_seconds, e.completion_seconds, e.from_track, e.to_track, count(DISTINCT source_frame) FILTER (eligible) AS direct, count(DISTINCT source_frame) FILTER (NOT eligible) AS estimated, string_agg(DISTINCT state, ',' ORDER BY state) AS evidence_types, round(max(uncertainty), 3) AS most_uncertain
 FROM e LEFT JOIN bal b ON b.clip_id = e.clip_id AND b.clip_seconds >= e.clip_seconds - 0.2 AND b.clip_seconds < e.completion_seconds + 0.2 + 1e-9 GROUP BY ALL)
SELECT clip_id, clip_seconds, from_track, to_track, CASE WHEN direct > 0 AND estimated > 0 THEN 'mixed' WHEN direct > 0 THEN 'direct' WHEN estimated > 0 THEN 'estimated' ELSE 'unavailable' END AS status, direct, estimated, evidence_types, most_uncertain FROM j""", *SPELLS)
def event_evidence(spark, d):
    out = points.event_evidence(play.control_transfers(spark, d), views.balls(spark, d), CLIP)
    return out.select("clip_id", "clip_seconds", "from_track", "to_track", "status", "direct", "estimated", "evidence_types", "most_uncertain")


@query("spaced_candidates")
def spaced_candidates(spark, d):
    return points.spaced(views.detections(spark, d).select("clip_id", "source_frame", "l_partkey", "l_linenumber", "confidence", F.col("x1").alias("x"), F.col("y1").alias("y")), FRAME, [F.desc("confidence"), F.asc("l_partkey"), F.asc("l_linenumber")], 120.0)


@query("player_tracks")
def player_tracks(spark, d):
    boxes = views.players(spark, d).select("clip_id", "source_frame", "clip_seconds", (F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("point_no"), "x1", "y1", "x2", "y2")
    return points.associated(boxes, CLIP, 0.4, 300.0)


@query("ball_tracks")
def ball_tracks(spark, d):
    boxes = views.balls(spark, d).select("clip_id", "source_frame", "clip_seconds", F.col("user_id").alias("point_no"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return points.associated(boxes, CLIP, 0.4, 400.0, least=35.0, heights=0.0, overlap=0.0)


@query("event_scores")
def event_scores(spark, d):
    p = views.path(spark, d).select("clip_id", F.col("source_frame").alias("event_no"), F.col("clip_seconds").alias("seconds"), "event_type", "team")
    kind = F.when(F.col("team") == "red", "pass").otherwise("shot")
    return scoring.event_scores(p.where("event_type = 'purchase'").withColumn("event_type", kind), p.where("event_type IN ('click', 'view')").withColumn("event_type", kind), CLIP, 0.25)


#: A reference point a frame: the ball, less the frames of errors. Points to score: the ball shifted, and the path in every frame of a view.
views.SQL["ref"] = "ref AS (SELECT clip_id, source_frame, x AS ref_x, y AS ref_y FROM bal WHERE state <> 'error')"
views.SQL["sel"] = "sel AS (SELECT clip_id, source_frame, x + user_id % 48 AS x, y, 'detector' AS source FROM bal WHERE state <> 'purchase' UNION ALL SELECT clip_id, source_frame, x, y / 8, 'path' FROM pth WHERE event_type = 'view')"
views.SQL["dtb"] = "dtb AS (SELECT clip_id, source_frame, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM det WHERE class_name = 'sports ball')"


def reference(spark, d):
    return views.balls(spark, d).where("state <> 'error'").select("clip_id", "source_frame", F.col("x").alias("ref_x"), F.col("y").alias("ref_y"))


def selected(spark, d):
    own = views.balls(spark, d).where("state <> 'purchase'").select("clip_id", "source_frame", (F.col("x") + F.col("user_id") % 48).alias("x"), "y", F.lit("detector").alias("source"))
    return own.unionByName(views.path(spark, d).where("event_type = 'view'").select("clip_id", "source_frame", "x", (F.col("y") / 8).alias("y"), F.lit("path").alias("source")))


def detected(spark, d):
    x, y = g.center(g.box())
    return views.detections(spark, d).where("class_name = 'sports ball'").select("clip_id", "source_frame", x.alias("x"), y.alias("y"))


NEAREST = """n AS (SELECT r.clip_id, r.source_frame, count(s.x) AS n, min(sqrt(pow(s.x - ref_x, 2) + pow(s.y - ref_y, 2))) AS far FROM ref r LEFT JOIN sel s USING (clip_id, source_frame) WHERE r.source_frame % 2 = 0 GROUP BY ALL),
 m AS (SELECT r.clip_id, r.source_frame, count(s.x) AS n, min(sqrt(pow(s.x - ref_x, 2) + pow(s.y - ref_y, 2))) AS far FROM ref r LEFT JOIN dtb s USING (clip_id, source_frame) GROUP BY ALL)"""
views.SQL["nea"] = NEAREST


@query("coordinate_scores", """, q AS (SELECT n.*, coalesce(n.far <= 32, false) AS hit, coalesce(m.far <= 32, false) AS det FROM n JOIN m USING (clip_id, source_frame))
SELECT clip_id, count(*) AS evaluated, count(*) FILTER (n > 0) AS tracked, count(*) FILTER (hit) AS matched, count(*) FILTER (n = 0) AS missing, count(*) FILTER (n > 0 AND NOT hit) AS wrong, (sum(n) - count(*) FILTER (hit))::BIGINT AS false_points, round(coalesce(avg(far) FILTER (hit), 0), 3) AS mean_far,
 round(coalesce(quantile_cont(far, 0.5) FILTER (hit), 0), 3) AS median_far, round(coalesce(quantile_cont(far, 0.9) FILTER (hit), 0), 3) AS p90_far, count(*) FILTER (far <= 32) AS matched_band, count(*) FILTER (far > 32 AND far <= 50) AS borderline_frames, count(*) FILTER (far > 50 AND far <= 100) AS review_frames, count(*) FILTER (far > 100 AND far <= 250) AS unreliable_frames, count(*) FILTER (far > 250) AS wrong_object_frames,
 count(*) FILTER (det) AS detector_frames, count(*) FILTER (det AND hit) AS kept_frames, count(*) FILTER (det AND NOT hit AND n > 0) AS lost_to_wrong, count(*) FILTER (det AND n = 0) AS lost_to_none, count(*) FILTER (NOT det AND hit) AS recovered,
 round(count(*) FILTER (n > 0) / count(*), 4) AS coverage, round(count(*) FILTER (hit) / count(*), 4) AS recall, round(coalesce(count(*) FILTER (hit) / nullif(sum(n), 0), 0), 4) AS precision FROM q GROUP BY clip_id""", "bal", "pth", "det", "ref", "sel", "dtb", "nea")
def coordinate_scores(spark, d):
    return scoring.coordinate_scores(reference(spark, d), selected(spark, d), detected(spark, d), CLIP, 2, 32.0)


@query("detection_scores", """SELECT clip_id, count(*) AS evaluated, count(*) FILTER (far <= 64) AS matched, count(*) FILTER (coalesce(far > 64, true)) AS missed, (sum(n) - count(*) FILTER (far <= 64))::BIGINT AS false_positives, round(count(*) FILTER (far <= 64) / count(*), 6) AS recall, round(coalesce(count(*) FILTER (far <= 64) / nullif(sum(n), 0), 0), 6) AS precision, round(coalesce(avg(far) FILTER (far <= 64), 0), 6) AS mean_far FROM m GROUP BY clip_id""", "bal", "pth", "det", "ref", "sel", "dtb", "nea")
def detection_scores(spark, d):
    return scoring.detection_scores(reference(spark, d), detected(spark, d), CLIP, 64.0)


@query("run_performance", """SELECT l_orderkey, l_linenumber, round(l_quantity / nullif(l_linenumber * 8, 0), 6) AS realtime_factor, round((l_partkey % 300) / nullif(l_quantity, 0), 6) AS frames_per_second, round(l_suppkey % 40 - l_quantity, 6) AS headroom_seconds, round(greatest(1.0, l_quantity / nullif(l_suppkey % 40, 0)), 6) AS needed_speedup FROM lineitem""")
def run_performance(spark, d):
    runs = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_orderkey", "l_linenumber", "l_quantity AS wall_seconds", "CAST(l_linenumber * 8 AS DOUBLE) AS media_seconds", "l_partkey % 300 AS frames", "CAST(l_suppkey % 40 AS DOUBLE) AS deadline_seconds")
    return scoring.run_performance(runs).select("l_orderkey", "l_linenumber", "realtime_factor", "frames_per_second", "headroom_seconds", "needed_speedup")


@query("goal_faces", """SELECT clip_id, source_frame, CASE WHEN z < -0.5 THEN 'ambiguous' WHEN y BETWEEN 30.84 + 0.5 AND 44.16 - 0.5 AND z <= 2.44 - 0.5 THEN 'inside' WHEN y < 30.84 - 0.5 OR y > 44.16 + 0.5 OR z > 2.44 + 0.5 THEN 'outside' ELSE 'ambiguous' END AS face FROM (SELECT clip_id, source_frame, y / 4 AS y, CAST(user_id % 16 AS DOUBLE) / 4 - 0.75 AS z FROM bal)""", "bal")
def goal_faces(spark, d):
    b = views.balls(spark, d).select("clip_id", "source_frame", (F.col("y") / 4).alias("y"), (F.col("user_id") % 16 / 4.0 - 0.75).alias("z"))
    return b.select("clip_id", "source_frame", shots.face(F.col("y"), F.col("z"), 30.84, 44.16, 2.44, 0.5).alias("face"))


@query("goal_line_crossings", """, s AS (SELECT clip_id, source_frame, x - 200 AS a, y, CAST(user_id % 16 AS DOUBLE) / 4 AS z, lead(x - 200) OVER w AS b, lead(y) OVER w AS ny, lead(CAST(user_id % 16 AS DOUBLE) / 4) OVER w AS nz, lead(source_frame) OVER w AS nf FROM bal WINDOW w AS (PARTITION BY clip_id ORDER BY source_frame))
SELECT clip_id, CASE WHEN a = 0 THEN source_frame ELSE nf END AS crossing_frame, round(CASE WHEN a = 0 THEN y ELSE y + (ny - y) * (a / (a - b)) END, 6) AS crossing_y, round(CASE WHEN a = 0 THEN z ELSE z + (nz - z) * (a / (a - b)) END, 6) AS crossing_z FROM s WHERE b IS NOT NULL AND (a = 0 OR a * b < 0 OR b = 0) QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY source_frame) = 1""", "bal")
def goal_line_crossings(spark, d):
    samples = views.balls(spark, d).withColumn("z", F.col("user_id") % 16 / 4.0)
    return shots.goal_line_crossings(samples, CLIP, 200.0).withColumns(r6("crossing_y", "crossing_z"))


@query("face_projections", """, s AS (SELECT clip_id, x, y, CAST(user_id % 16 AS DOUBLE) / 4 AS z, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(CAST(user_id % 16 AS DOUBLE) / 4) OVER w AS pz, source_frame FROM bal WINDOW w AS (PARTITION BY clip_id ORDER BY source_frame) QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY source_frame DESC) = 1),
 r AS (SELECT *, (400 - x) / nullif(x - px, 0) AS k FROM s), q AS (SELECT *, y + (y - py) * k AS fy, z + (z - pz) * k AS fz FROM r)
SELECT clip_id, CASE WHEN px IS NULL THEN 'insufficient' WHEN x = px OR (400 - x) * (x - px) < 0 THEN 'outside' WHEN fz < -0.5 THEN 'ambiguous' WHEN fy BETWEEN 100.5 AND 199.5 AND fz <= 1.94 THEN 'inside' WHEN fy < 99.5 OR fy > 200.5 OR fz > 2.94 THEN 'outside' ELSE 'ambiguous' END AS projected FROM q""", "bal")
def face_projections(spark, d):
    samples = views.balls(spark, d).withColumn("z", F.col("user_id") % 16 / 4.0)
    return shots.projected_faces(samples, CLIP, 400.0, 100.0, 200.0, 2.44, 0.5)


@query("goal_arrests", """, s AS (SELECT clip_id, source_frame, clip_seconds, x, CAST(round(clip_seconds * 1000) AS BIGINT) AS ms, x < lag(x) OVER w AS toward, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) / (clip_seconds - lag(clip_seconds) OVER w) AS speed FROM bal WINDOW w AS (PARTITION BY clip_id ORDER BY source_frame)),
 p AS (SELECT *, max(CASE WHEN toward THEN speed END) OVER (PARTITION BY clip_id ORDER BY ms RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW) AS peak, max(x) OVER f AS widest, min(speed) OVER f AS slowest, count(*) OVER f AS later FROM s WINDOW f AS (PARTITION BY clip_id ORDER BY ms RANGE BETWEEN 1 FOLLOWING AND 600 FOLLOWING))
SELECT clip_id, source_frame, round(peak, 6) AS peak FROM p WHERE x <= 120 AND peak >= 200 AND later >= 3 AND widest <= 120 AND slowest <= 0.35 * peak""", "bal")
def goal_arrests(spark, d):
    zone = views.balls(spark, d).withColumn("far", F.col("x"))
    return shots.arrests(zone, CLIP, 120.0, 200.0).select("clip_id", "source_frame", F.round("peak", 6).alias("peak"))


@query("shot_summary", """, a AS (SELECT clip_id, source_frame // 8 AS attempt_id, arg_min(team, source_frame) AS team, arg_min(event_type, source_frame) AS e FROM pth GROUP BY ALL), r AS (SELECT *, CASE e WHEN 'purchase' THEN 'on_target' WHEN 'click' THEN 'off_target' ELSE 'unresolved' END AS resolution FROM a)
SELECT clip_id, count(*) FILTER (resolution = 'on_target' AND team = 'red') AS red_on_target, count(*) FILTER (resolution = 'on_target' AND team = 'black') AS black_on_target, count(*) FILTER (resolution = 'unresolved') AS unresolved, CASE WHEN count(*) FILTER (resolution = 'unresolved') > 0 THEN 'partial' ELSE 'complete' END AS analysis_status,
 (SELECT string_agg(e || ':' || n, ',' ORDER BY e || ':' || n) FROM (SELECT e, count(*) AS n FROM r x WHERE x.clip_id = r.clip_id AND resolution = 'unresolved' GROUP BY 1)) AS unresolved_reasons FROM r GROUP BY clip_id""", "pth")
def shot_summary(spark, d):
    resolution = F.when(F.col("event_type") == "purchase", "on_target").when(F.col("event_type") == "click", "off_target").otherwise("unresolved")
    attempts = views.path(spark, d).select("clip_id", F.expr("source_frame DIV 8").alias("attempt_id"), F.col("source_frame").alias("order_no"), "team", resolution.alias("resolution"), F.col("event_type").alias("reason"))
    return shots.summary(attempts, CLIP, ["red", "black"])


@query("supported_tracks", "SELECT clip_id, track_id, points FROM (SELECT clip_id, track_id, count(*) AS points, avg(control_ratio) AS m, max(speed) AS v, bool_or(event_type = 'click') AS feet FROM (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) / (clip_seconds - lag(clip_seconds) OVER w) AS speed FROM (SELECT clip_id, CAST(floor(clip_seconds * 2) AS BIGINT) * 12 + track_id AS track_id, source_frame, clip_seconds, x, y, event_type, control_ratio FROM pth) WINDOW w AS (PARTITION BY clip_id, track_id ORDER BY source_frame)) GROUP BY ALL) WHERE points >= 3 OR (points = 2 AND v >= 75 AND (m >= 0.6 OR (feet AND m >= 0.3)))", "pth")
def supported_tracks(spark, d):
    """The path's tracks, cut every half second."""
    p = views.path(spark, d).withColumn("track_id", F.floor(F.col("clip_seconds") * 2) * 12 + F.col("track_id")).withColumns({"near_feet": F.col("event_type") == "click", "confidence": F.col("control_ratio")})
    return evidence.supported_tracks(p, TRACK, 3, 1000.0, 0.6, 0.3)


ACTION_FRAMES = """bb AS (SELECT clip_id, source_frame, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM det WHERE class_name = 'sports ball' QUALIFY row_number() OVER (PARTITION BY clip_id, source_frame ORDER BY confidence DESC, l_partkey, l_linenumber) = 1),
 bs AS (SELECT *, source_frame / 25 AS t, CAST(source_frame * 40 AS BIGINT) AS ms FROM bb),
 pp2 AS (SELECT b.clip_id, b.source_frame, p.l_suppkey % 40 AS track, sqrt(pow(b.x - (p.x1 + p.x2) / 2, 2) + pow(b.y - p.y2, 2)) / greatest(1.0, p.y2 - p.y1) AS prox, greatest(1.0, p.y2 - p.y1) AS h FROM bs b JOIN det p ON p.clip_id = b.clip_id AND p.source_frame = b.source_frame AND p.class_name = 'person'),
 ct AS (SELECT clip_id, source_frame, median(h) AS scale, arg_min(track, struct_pack(a := prox, b := track)) FILTER (prox <= 2) AS controller, min(prox) FILTER (prox <= 2) AS proximity FROM pp2 GROUP BY ALL),
 af AS (SELECT bs.clip_id, bs.source_frame, controller, proximity, CASE WHEN t > first(t) OVER w THEN sqrt(pow(x - first(x) OVER w, 2) + pow(y - first(y) OVER w, 2)) / greatest(1.0, coalesce(scale, 1.0)) / (t - first(t) OVER w) ELSE 0 END AS speed FROM bs LEFT JOIN ct USING (clip_id, source_frame) WINDOW w AS (PARTITION BY bs.clip_id ORDER BY ms RANGE BETWEEN 600 PRECEDING AND CURRENT ROW))"""
views.SQL["acf"] = ACTION_FRAMES


@query("action_candidates", """SELECT clip_id, source_frame, CASE WHEN controller IS NOT NULL THEN 'ball_control_candidate' ELSE 'pass_or_shot_candidate' END AS event_type, coalesce(controller, before) AS actor, round(CASE WHEN controller IS NOT NULL THEN greatest(0, least(1, 1 - proximity)) ELSE least(1, speed / 4) END, 6) AS confidence
 FROM (SELECT *, lag(controller) OVER (PARTITION BY clip_id ORDER BY source_frame) AS before FROM af) WHERE (controller IS NOT NULL AND controller IS DISTINCT FROM before) OR (controller IS NULL AND before IS NOT NULL AND speed >= 2)""", "det", "acf")
def action_candidates(spark, d):
    boxes = views.detections(spark, d)
    x, y = g.center(g.box())
    order = Window.partitionBy(*FRAME).orderBy(F.desc("confidence"), "l_partkey", "l_linenumber")
    balls = boxes.where("class_name = 'sports ball'").withColumn("k", F.row_number().over(order)).where("k = 1").select(*FRAME, (F.col("source_frame") / 25).alias("clip_seconds"), x.alias("x"), y.alias("y"))
    fx, fy = g.foot(g.box())
    people = boxes.where("class_name = 'person'").select(*FRAME, (F.col("l_suppkey") % 40).alias("track"), fx.alias("fx"), fy.alias("fy"), g.height(g.box()).alias("h"))
    pairs = balls.join(people, FRAME).withColumn("prox", g.distance(F.col("x"), F.col("y"), F.col("fx"), F.col("fy")) / F.col("h"))
    near = F.when(F.col("prox") <= 2, F.struct("prox", "track"))
    held = pairs.groupBy(*FRAME).agg(F.percentile("h", 0.5).alias("scale"), F.min(near).alias("n")).select(*FRAME, "scale", F.col("n.track").alias("controller"), F.col("n.prox").alias("proximity"))
    rows = points.trailing_speed(balls.join(held, FRAME, "left"), CLIP, 0.6, F.coalesce("scale", F.lit(1.0)))
    return tracks.actions(rows, CLIP, 2.0)


SHOT_STEPS = """ss AS (SELECT clip_id, clip_seconds, lead(clip_seconds) OVER w AS nt, x, y, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM bal WINDOW w AS (PARTITION BY clip_id ORDER BY source_frame)),
 sc AS (SELECT clip_id, (clip_seconds + nt) / 2 AS clip_seconds, sqrt(dx * dx + dy * dy) / (nt - clip_seconds) AS speed, CASE WHEN x >= 240 THEN 'right' ELSE 'left' END AS side FROM (SELECT *, CASE WHEN x >= 240 THEN 0.95 * 400 ELSE 0.18 * 400 END - x AS gx, 0.27 * 300 - y AS gy FROM ss WHERE x >= 240 OR x <= 160) WHERE nt > clip_seconds AND nt - clip_seconds <= 0.8 AND sqrt(dx * dx + dy * dy) / (nt - clip_seconds) >= 500 AND (dx * gx + dy * gy) / nullif(sqrt(dx * dx + dy * dy) * sqrt(gx * gx + gy * gy), 0) >= 0.8)"""
views.SQL["sc"] = SHOT_STEPS


def shot_steps(spark, d):
    return shots.candidates(views.balls(spark, d), CLIP, 400.0, 300.0, 500.0, 0.8)


@query("shot_candidates", "SELECT clip_id, round(clip_seconds, 3) AS clip_seconds, round(speed, 4) AS speed, side FROM sc", "bal", "sc")
def shot_candidates(spark, d):
    return shot_steps(spark, d).select("clip_id", F.round("clip_seconds", 3).alias("clip_seconds"), F.round("speed", 4).alias("speed"), "side")


@query("shot_events")
def shot_events(spark, d):
    found = tracks.debounced(shot_steps(spark, d).select("clip_id", "clip_seconds", "speed"), CLIP, 2.0)
    return shots.events(found, play.controlled(spark, d), play.control_transfers(spark, d), CLIP, ["red", "black"], receiver=0.1)


@query("event_windows", """, a AS (SELECT clip_id, source_frame, clip_seconds, event_type, greatest(0, clip_seconds - 2) AS s FROM pth WHERE event_type = 'purchase'), c AS (SELECT a.clip_id, a.s, count(*) FILTER (p.event_type = 'purchase') AS required, count(*) FILTER (p.event_type = 'click') AS passes, count(*) AS actions FROM a JOIN pth p ON p.clip_id = a.clip_id AND p.clip_seconds >= a.s AND p.clip_seconds < a.s + 4 GROUP BY a.clip_id, a.s, a.source_frame)
SELECT clip_id, round(s, 3) AS start_seconds, round(s + 4, 3) AS end_seconds, CAST(round_even(s * 25, 0) AS BIGINT) AS start_frame, CAST(round_even((s + 4) * 25, 0) AS BIGINT) AS end_frame, required, passes, actions FROM c QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY required DESC, passes DESC, actions DESC, s) = 1""", "pth")
def event_windows(spark, d):
    p = views.path(spark, d).select("clip_id", "source_frame", "clip_seconds", F.col("event_type").alias("label"))
    return scoring.best_windows(p, CLIP, 4.0, ["purchase"], ["click"], 25.0)


@query("clip_plans", """SELECT l_orderkey, l_linenumber, CAST(floor(s / 3) AS BIGINT) AS first_segment, CAST(ceil((s - floor(s / 3) * 3 + dur) / 3) AS BIGINT) AS segment_count, round(floor(s / 3) * 3, 3) AS source_start_seconds, round(s - floor(s / 3) * 3, 3) AS clip_start_seconds, round(dur, 3) AS duration_seconds FROM (SELECT *, least(l_quantity, 300.0 - s) AS dur FROM (SELECT *, CAST(l_suppkey * 7 % 400 AS DOUBLE) AS s FROM lineitem) WHERE s < 300 AND l_quantity > 0)""")
def clip_plans(spark, d):
    asked = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_orderkey", "l_linenumber", "CAST(l_suppkey * 7 % 400 AS DOUBLE) AS start_seconds", "l_quantity AS duration_seconds", "300.0D AS source_seconds")
    return scoring.clip_plans(asked, 3.0, 300.0).select("l_orderkey", "l_linenumber", "first_segment", "segment_count", "source_start_seconds", "clip_start_seconds", "duration_seconds")


@query("neighbour_counts", """SELECT a.clip_id, a.source_frame, CAST(EXISTS (SELECT 1 FROM bal b WHERE b.clip_id = a.clip_id AND b.source_frame = a.source_frame - 2 AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 40) AS INT) + CAST(EXISTS (SELECT 1 FROM bal b WHERE b.clip_id = a.clip_id AND b.source_frame = a.source_frame + 2 AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 40) AS INT) AS neighbours FROM bal a""", "bal")
def neighbour_counts(spark, d):
    return points.temporal_neighbours(views.balls(spark, d).select("clip_id", "source_frame", "x", "y"), CLIP, 2, 500.0, 25.0)


@query("detection_changes")
def detection_changes(spark, d):
    """Ball boxes of the sure half against those of the others, by frame."""
    found = detected_with_key(spark, d)
    return scoring.detection_changes(found.where("confidence < 0.5"), found.where("confidence >= 0.5"), CLIP, 60.0)


def detected_with_key(spark, d):
    x, y = g.center(g.box())
    return views.detections(spark, d).where("class_name = 'sports ball'").select("clip_id", "source_frame", (F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("box_no"), "confidence", x.alias("x"), y.alias("y"))


@query("state_fill", """, k AS (SELECT clip_id, source_frame, CAST(event_id_ AS BIGINT) AS track_id, x, y, false AS interpolated FROM (SELECT *, 1 AS event_id_ FROM bal WHERE state NOT IN ('error', 'signup')))
SELECT * FROM k UNION ALL SELECT clip_id, source_frame, 1, x, y, true FROM bal WHERE state IN ('error', 'signup') AND NOT eligible""", "bal")
def state_fill(spark, d):
    b = views.balls(spark, d)
    kept = b.where("state NOT IN ('error', 'signup')").select("clip_id", "source_frame", "track_id", "x", "y")
    return points.filled(kept, b.select("clip_id", "source_frame", "x", "y", "eligible"), CLIP)


@query("ball_predictions")
def ball_predictions(spark, d):
    """Every second frame; only clicks and views are trusted."""
    b = views.balls(spark, d)
    trusted = F.col("state").isin("click", "view")
    return points.predicted(b.select("clip_id", "source_frame", F.when(trusted, F.col("x")).alias("x"), F.when(trusted, F.col("y")).alias("y")), CLIP, 25.0)


def saved_states(spark, d):
    """A review state for each conversation: user's turns as proposals (every third without a key of its own), others as predictions and verdicts."""
    rows = spark.read.parquet(f"{d}/conversations.parquet").withColumn("n", F.expr("concat(CASE WHEN turn % 3 = 2 THEN 'x' WHEN role = 'user' THEN 'C' ELSE 'E' END, turn + 1)"))
    mine, others = lambda x: x["role"] == "user", lambda x: x["role"] != "user"
    listed = lambda some, what: F.array_sort(F.transform(F.filter("turns", some), what))
    at = lambda some, what: F.transform(listed(some, lambda x: F.struct(x["turn"].alias("turn"), what(x).alias("v"))), lambda x: x["v"])
    named = lambda some, what: F.map_from_entries(listed(some, lambda x: F.struct(x["turn"].cast("string").alias("k"), what(x).alias("v"))))
    parts = {
        "additionalProposals": at(mine, lambda x: F.struct(x["n"].alias("id"), x["text"].alias("text"))), "engineAfter": F.struct(at(others, lambda x: F.struct(x["n"].alias("eventKey"), F.length(x["text"]).alias("length"))).alias("predictions")),
        "decisions": named(mine, lambda x: F.struct(F.when(x["turn"] % 2 == 0, "accepted").alias("status"))), "engineEventReviews": named(others, lambda x: F.struct(F.lit("seen").alias("status"), x["text"].alias("text"))),
        "conversation": at(lambda x: F.lit(True), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))),
    }
    # Turns are listed once, for a list of its own for each part would send every text twice.
    per = rows.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "n", "role", "text")).alias("turns")).select("conv_id", *[v.alias(k) for k, v in parts.items()])
    return per.select("conv_id", F.parse_json(F.to_json(F.struct(*parts))).alias("state"))


@query("history_records", """SELECT conv_id, 'C' AS stream, place, 'C' || (turn + 1) AS event_key, NULL AS proposal_key, NULL AS type FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations WHERE role = 'user') WHERE turn % 3 <> 2
 UNION ALL SELECT conv_id, 'E', place, 'E' || (turn + 1), NULL, NULL FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations WHERE role <> 'user') WHERE turn % 3 <> 2
 UNION ALL SELECT conv_id, 'decision', row_number() OVER (PARTITION BY conv_id ORDER BY turn::VARCHAR) - 1, NULL, 'decision-index:' || turn, CASE WHEN turn % 2 = 0 THEN 'accepted' ELSE 'decision' END FROM conversations WHERE role = 'user'
 UNION ALL SELECT conv_id, 'verdict', row_number() OVER (PARTITION BY conv_id ORDER BY turn::VARCHAR) - 1, turn::VARCHAR, NULL, 'seen' FROM conversations WHERE role <> 'user'
 UNION ALL SELECT conv_id, 'activity', row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1, NULL, NULL, 'conversation' FROM conversations""")
def history_records(spark, d):
    return reviews.history_records(saved_states(spark, d), ["conv_id"]).drop("payload", "fingerprint")


@query("record_fingerprints", """SELECT conv_id, stream, sha256('{"imported":true,"role":' || to_json(role) || ',"text":' || to_json(text) || ',"type":"conversation"}') AS fingerprint, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM (SELECT *, 'activity' AS stream FROM conversations)""")
def record_fingerprints(spark, d):
    """Of the conversations' messages; the same text and digest as any writer of sorted JSON without spaces gives."""
    return reviews.history_records(saved_states(spark, d), ["conv_id"]).where("stream = 'activity'").select("conv_id", "stream", "fingerprint", "place")
