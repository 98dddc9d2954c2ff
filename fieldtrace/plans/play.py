"""Queries of control, identity and match state, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldtrace.functions import geometry as g
from fieldtrace.functions.storage import once
from fieldtrace.operators import chain, control, identity, joins, rules, state, tracks
from fieldtrace.operators import restarts as still
from fieldtrace.plans.catalog import CLIP, POLYGON, TRACK, query, r6
from fieldtrace.sources import views

RB = """CASE WHEN yellow >= 0.35 AND white < 0.1 THEN 'official' WHEN dark >= 0.3 THEN 'black' WHEN warm >= 0.12 OR (white >= 0.12 AND warm + yellow >= 0.12) THEN 'red' ELSE 'unknown' END"""
BW = """CASE WHEN warm >= 0.15 OR yellow >= 0.15 THEN 'goalkeeper' WHEN dark >= 0.35 THEN 'official' WHEN blue >= 0.2 AND blue > 1.75 * white THEN 'blue' WHEN white >= 0.2 AND white > 1.25 * blue THEN 'white' ELSE 'unknown' END"""
views.SQL["lab"] = f"lab AS (SELECT *, {RB} AS label FROM pla)"
views.SQL["mo"] = """mo AS (SELECT clip_id, source_frame, greatest(il / it, ol / ot) AS sp, (ix * ox + iy * oy) / (il * ol) AS turn FROM (SELECT *, sqrt(ix * ix + iy * iy) AS il, sqrt(ox * ox + oy * oy) AS ol FROM (
 SELECT *, x - lag(x) OVER w AS ix, y - lag(y) OVER w AS iy, clip_seconds - lag(clip_seconds) OVER w AS it, lead(x) OVER w - x AS ox, lead(y) OVER w - y AS oy, lead(clip_seconds) OVER w - clip_seconds AS ot FROM bal WINDOW w AS (PARTITION BY clip_id ORDER BY source_frame)))
 WHERE it > 0 AND ot > 0 AND il > 0 AND ol > 0)"""
views.SQL["pr"] = """pr AS (SELECT b.clip_id, b.source_frame, b.clip_seconds, b.x AS ball_x, b.y AS ball_y, p.team, p.track_id, (p.x1 + p.x2) / 2 AS player_x, p.y2 AS player_y, greatest(1.0, p.y2 - p.y1) AS height,
  sqrt((b.x - (p.x1 + p.x2) / 2) * (b.x - (p.x1 + p.x2) / 2) + (b.y - p.y2) * (b.y - p.y2)) AS dist, m.sp, m.turn FROM bal b JOIN pla p ON b.clip_id = p.clip_id AND b.source_frame = p.source_frame LEFT JOIN mo m ON m.clip_id = b.clip_id AND m.source_frame = b.source_frame)"""
OB = """ob AS (SELECT * EXCLUDE (k), round(dist / height, 4) AS control_ratio FROM (SELECT *, row_number() OVER (PARTITION BY clip_id, source_frame ORDER BY dist, track_id, dist / height) AS k FROM pr WHERE dist / height <= 1.2
  AND NOT ((player_y - ball_y) / height > 0.9 AND (turn IS NULL OR turn > 0.5 OR abs(ball_x - player_x) / height > 0.5))) WHERE k = 1 AND NOT coalesce(turn >= 0.85 AND sp >= 700, false))"""
views.SQL["ob"] = OB
views.SQL["spl"] = """o AS (SELECT *, row_number() OVER w AS k, clip_seconds - lag(clip_seconds) OVER w <= 0.64 AND team = lag(team) OVER w AS j, greatest(1.0, (height + lag(height) OVER w) / 2) AS scale, clip_seconds - lag(clip_seconds) OVER w AS dt,
  track_id = lag(track_id) OVER w AS st, sqrt(pow(player_x - lag(player_x) OVER w, 2) + pow(player_y - lag(player_y) OVER w, 2)) AS moved, lag(control_ratio) OVER w AS cr, ball_x - lag(ball_x) OVER w AS ox, ball_y - lag(ball_y) OVER w AS oy,
  lag(ball_x) OVER w - lag(ball_x, 2) OVER w AS ix, lag(ball_y) OVER w - lag(ball_y, 2) OVER w AS iy FROM ob WINDOW w AS (PARTITION BY clip_id ORDER BY clip_seconds)),
 o2 AS (SELECT *, coalesce(j AND (st OR moved / scale <= 0.75), false) AS same, coalesce(j AND cr <= 1 AND control_ratio <= 1 AND dt > 0 AND sqrt(ix * ix + iy * iy) > 0 AND sqrt(ox * ox + oy * oy) > 0 AND ix * ox + iy * oy >= 0.9 * sqrt(ix * ix + iy * iy) * sqrt(ox * ox + oy * oy) AND sqrt(ox * ox + oy * oy) / dt / scale <= 5, false) AS dribbled FROM o),
 ks AS (SELECT clip_id, k, 1 AS spell_no, 1 AS n /* RECURSION */ FROM o2 WHERE k = 1 UNION ALL SELECT o2.clip_id, o2.k, ks.spell_no + CASE WHEN same OR (dribbled AND ks.n >= 2) THEN 0 ELSE 1 END, CASE WHEN same OR (dribbled AND ks.n >= 2) THEN ks.n + 1 ELSE 1 END FROM ks JOIN o2 ON o2.clip_id = ks.clip_id AND o2.k = ks.k + 1),
 spl AS (SELECT clip_id, spell_no, arg_min(team, k) AS team, arg_min(track_id, k) AS track_id, min(clip_seconds) AS start_seconds, max(clip_seconds) AS end_seconds, count(*) AS observations, count(*) FILTER (control_ratio <= 0.5) AS close,
  arg_min(ball_x, k) AS fx, arg_min(ball_y, k) AS fy, arg_min(height, k) AS fh, arg_max(ball_x, k) AS lx, arg_max(ball_y, k) AS ly, arg_max(height, k) AS lh FROM o2 JOIN ks USING (clip_id, k) GROUP BY ALL)"""
SPELL_VIEWS = ("pla", "bal", "mo", "pr", "ob", "spl")


def labelled(spark, d):
    """Players with the label of their colours."""
    return views.players(spark, d).withColumn("label", identity.team_label("red-black"))


def observed(spark, d):
    return control.control_observations(views.players(spark, d), views.balls(spark, d), CLIP, 1.2, ground=0.9, flyby_speed=700.0)


def controlled(spark, d):
    return control.spells(control.spell_numbers(observed(spark, d), CLIP, 0.64, 0.75), CLIP)


@query("team_labels", f"SELECT l_partkey, l_linenumber, clip_id, source_frame, {RB} AS red_black, {BW} AS blue_white FROM pla", "pla")
def team_labels(spark, d):
    return views.players(spark, d).select("l_partkey", "l_linenumber", "clip_id", "source_frame", identity.team_label("red-black").alias("red_black"), identity.team_label("blue-white").alias("blue_white"))


@query("control_observations", "SELECT clip_id, source_frame, team, track_id, ball_x, ball_y, control_ratio FROM ob", *SPELL_VIEWS[:5])
def control_observations(spark, d):
    return observed(spark, d).select("clip_id", "source_frame", "team", "track_id", "ball_x", "ball_y", "control_ratio")


@query("confirmed_control")
def confirmed_control(spark, d):
    out = control.control_observations(views.players(spark, d), views.balls(spark, d), CLIP, 1.2, ground=0.5, flyby_speed=500.0, confirm=1.2)
    return out.select("clip_id", "source_frame", "team", "track_id", "control_ratio")


@query("smoothed_control", """SELECT clip_id, source_frame, team, track_id, control_ratio FROM (SELECT *, sum(CASE WHEN team = 'red' THEN 1 / pow(greatest(0.1, control_ratio), 2) ELSE 0 END) OVER w AS r, sum(CASE WHEN team = 'black' THEN 1 / pow(greatest(0.1, control_ratio), 2) ELSE 0 END) OVER w AS b
 FROM ob WINDOW w AS (PARTITION BY clip_id ORDER BY CAST(round(clip_seconds * 1000) AS BIGINT) RANGE BETWEEN 400 PRECEDING AND 400 FOLLOWING)) WHERE control_ratio <= 0.35 OR (team = 'red' AND r >= b) OR (team = 'black' AND b >= r)""", *SPELL_VIEWS[:5])
def smoothed_control(spark, d):
    return identity.smoothed(observed(spark, d), CLIP, ["red", "black"], 0.4).select("clip_id", "source_frame", "team", "track_id", "control_ratio")


@query("control_spells", "SELECT clip_id, spell_no, team, track_id, start_seconds, end_seconds, observations, close, fx AS first_ball_x, lx AS last_ball_x FROM spl", *SPELL_VIEWS)
def control_spells(spark, d):
    return control.flat(controlled(spark, d), CLIP).select("clip_id", "spell_no", "team", "track_id", "start_seconds", "end_seconds", "observations", "close", F.col("first.ball_x").alias("first_ball_x"), F.col("last.ball_x").alias("last_ball_x"))


@query("returning_tracks", """SELECT DISTINCT a.clip_id, least(a.track_id, b.track_id) AS low, greatest(a.track_id, b.track_id) AS high FROM ob a JOIN ob b ON a.clip_id = b.clip_id AND a.track_id <> b.track_id AND b.clip_seconds > a.clip_seconds AND b.clip_seconds - a.clip_seconds <= 1
 JOIN ob c ON c.clip_id = a.clip_id AND c.track_id = a.track_id AND c.clip_seconds > b.clip_seconds AND c.clip_seconds - b.clip_seconds <= 1 + 1e-9""", *SPELL_VIEWS[:5])
def returning_tracks(spark, d):
    return control.returning_pairs(observed(spark, d), CLIP, 1.0)


@query("stable_spells", "SELECT clip_id, spell_no, team, track_id, observations FROM spl WHERE observations >= 2 OR (observations = 1 AND track_id IN (1, 2))", *SPELL_VIEWS)
def stable_spells(spark, d):
    return control.flat(control.stable(controlled(spark, d), 2, [1, 2]), CLIP).select("clip_id", "spell_no", "team", "track_id", "observations")


@query("collapsed_spells")
def collapsed_spells(spark, d):
    kept = control.collapsed(controlled(spark, d), CLIP, 0.6, 1.5, 3.0)
    return control.flat(kept, CLIP).select("clip_id", "spell_no", "team", "track_id", "start_seconds", "end_seconds", "observations", "close")


TRANSFERS = """SELECT clip_id, CASE WHEN team = b.team THEN 'pass_candidate' ELSE 'turnover_candidate' END AS event_type, end_seconds AS clip_seconds, team, track_id AS from_track, b.track_id AS to_track,
 round(least(1.0, 0.3 + 0.05 * least(observations, 3) + 0.05 * least(b.observations, 3) + 0.05 * least(travel, 3.0)), 4) AS confidence, round(b.start_seconds, 3) AS completion_seconds
 FROM (SELECT *, sqrt(pow(b.fx - lx, 2) + pow(b.fy - ly, 2)) / greatest(1.0, (lh + b.fh) / 2) AS travel FROM (SELECT s.*, lead(s) OVER (PARTITION BY clip_id ORDER BY spell_no) AS b FROM spl s))
 WHERE b.start_seconds - end_seconds BETWEEN 0 AND 3 AND b.track_id <> track_id AND (travel >= 0.5 OR (team <> b.team AND b.observations >= 4 AND b.close >= 2))"""


@query("control_transfers", TRANSFERS, *SPELL_VIEWS)
def control_transfers(spark, d):
    return control.transfers(controlled(spark, d), CLIP, 3.0, 0.5)


def points_of(spark, d):
    return control.triples(views.balls(spark, d), CLIP)


@query("turning_transfers")
def turning_transfers(spark, d):
    return control.direction_changes(controlled(spark, d), points_of(spark, d), CLIP, 3.0, 100.0)


def released(spark, d):
    fast = tracks.steps(views.balls(spark, d), CLIP, 0.24).withColumns({"clip_seconds": F.col("clip_seconds") - F.col("step_seconds"), "speed": F.round("speed", 4)})
    return tracks.debounced(fast.where("speed >= 600").select("clip_id", F.round("clip_seconds", 2).alias("clip_seconds"), "speed"), CLIP, 1.0)


@query("flight_transfers")
def flight_transfers(spark, d):
    return control.flights(released(spark, d), controlled(spark, d), CLIP, 1.0, 3.0)


@query("slowed_transfers")
def slowed_transfers(spark, d):
    return control.decelerations(controlled(spark, d), points_of(spark, d), CLIP, 100.0, 0.9, 1.0, 8.0, 0.1)


def shared(spark, d) -> chain.Inputs:
    """What the rules share, each computed once."""
    return chain.Inputs({
        "observations": lambda t: observed(spark, d),
        "numbered": lambda t: control.spell_numbers(t["observations"], CLIP, 0.64, 0.75),
        "spells": lambda t: control.spells(t["numbered"], CLIP),
        "transfers": lambda t: control.transfers(t["spells"], CLIP, 3.0, 0.5),
        "motion": lambda t: tracks.motion(views.balls(spark, d), TRACK).select("clip_id", "source_frame", "turn_cosine"),
        "restarts": lambda t: restarts(spark, d),
        "durations": lambda t: durations(spark, d),
        "changes": lambda t: state.transitions(t["restarts"].selectExpr("*", *[f"{v} AS {k}" for k, v in RULES.items()]), t["durations"], CLIP),
        "states": lambda t: state.state_intervals(t["changes"], t["durations"], CLIP),
        "labels": lambda t: labelled(spark, d).select("clip_id", "track_id", "clip_seconds", F.when(F.col("label").isin("red", "black"), F.col("label")).alias("label")),
    })


def merged(spark, d, t: chain.Inputs):
    """Flights and turns, which come first, and transfers between spells where neither is near."""
    first = control.flights(released(spark, d), t["spells"], CLIP, 1.0, 3.0).unionByName(control.direction_changes(t["spells"], points_of(spark, d), CLIP, 3.0, 100.0))
    return control.with_fallback(first, t["transfers"], CLIP, 0.5)


@query("merged_transfers")
def merged_transfers(spark, d):
    return merged(spark, d, shared(spark, d))


@query("startup_guarded", f"""SELECT * FROM ({TRANSFERS}) e WHERE NOT (completion_seconds <= 5 AND coalesce((SELECT min(control_ratio) FROM ob o WHERE o.clip_id = e.clip_id AND o.track_id = e.to_track AND abs(o.clip_seconds - e.completion_seconds) <= 0.25), 0) > 0.5)""", *SPELL_VIEWS)
def startup_guarded(spark, d):
    return control.startup_guarded(control_transfers(spark, d), observed(spark, d), CLIP, 5.0, 0.5)


@query("inherited_turnovers", """SELECT clip_id, 'turnover_candidate' AS event_type, 0.0::DOUBLE AS clip_seconds, 'red' AS team, NULL::BIGINT AS from_track, track_id AS to_track, 0.65::DOUBLE AS confidence, round(start_seconds, 3) AS completion_seconds FROM spl WHERE team <> 'red' AND spell_no = 1""", *SPELL_VIEWS)
def inherited_turnovers(spark, d):
    owners = views.balls(spark, d).select("clip_id", F.lit("red").alias("initial_team")).distinct()
    return control.inherited(controlled(spark, d), owners, CLIP)


def near_ball(spark, d):
    fx, fy = g.foot(g.box())
    b = views.balls(spark, d).select("clip_id", "source_frame", F.col("x").alias("ball_x"), F.col("y").alias("ball_y"))
    p = labelled(spark, d).withColumn("label", F.when(F.col("label").isin("red", "black"), F.col("label"))).join(b, ["clip_id", "source_frame"])
    return p.withColumn("ratio", g.distance(fx, fy, F.col("ball_x"), F.col("ball_y")) / g.height(g.box()))


def asked(spark, d):
    """The purchases as events to look at."""
    return views.path(spark, d).where("event_type = 'purchase'").select("clip_id", F.col("source_frame").alias("event_no"), F.col("clip_seconds").alias("at"), "track_id", "team")


views.SQL["ask"] = "ask AS (SELECT clip_id, source_frame AS event_no, clip_seconds AS at, track_id, team FROM pth WHERE event_type = 'purchase')"


@query("receiver_evidence", """, n AS (SELECT p.clip_id, p.clip_seconds, p.label, sqrt(pow((p.x1 + p.x2) / 2 - b.x, 2) + pow(p.y2 - b.y, 2)) / greatest(1.0, p.y2 - p.y1) AS ratio FROM lab p JOIN bal b USING (clip_id, source_frame)),
 w AS (SELECT a.clip_id, event_no, label, sum(1 / pow(greatest(0.25, ratio), 2)) AS weight FROM ask a JOIN n ON n.clip_id = a.clip_id AND abs(n.clip_seconds - a.at) <= 0.6 WHERE ratio <= 1.8 AND label IN ('red', 'black') GROUP BY ALL)
SELECT clip_id, event_no, arg_max(label, weight) AS evidence_team, round(max(weight) / sum(weight), 6) AS share, round(sum(weight), 6) AS support FROM w GROUP BY ALL""", "pla", "lab", "bal", "pth", "ask")
def receiver_evidence(spark, d):
    return identity.receiver_evidence(asked(spark, d).select("clip_id", "event_no", "at"), near_ball(spark, d), CLIP, 0.6).withColumns(r6("share", "support"))


@query("local_majority", """SELECT clip_id, event_no, track_id, label AS local_team, labels FROM (SELECT *, sum(n) OVER w::BIGINT AS labels, row_number() OVER (w ORDER BY n DESC, label DESC) AS k FROM (SELECT a.clip_id, event_no, a.track_id, label, count(*) AS n FROM ask a JOIN lab l ON l.clip_id = a.clip_id AND l.track_id = a.track_id AND abs(l.clip_seconds - a.at) <= 2 WHERE label IN ('red', 'black') GROUP BY ALL) WINDOW w AS (PARTITION BY clip_id, event_no, track_id))
 WHERE k = 1 AND labels >= 3 AND n >= 0.6 * labels""".replace("OVER w::BIGINT", "OVER (PARTITION BY clip_id, event_no, track_id)::BIGINT").replace("OVER (w ORDER", "OVER (PARTITION BY clip_id, event_no, track_id ORDER").replace(" WINDOW w AS (PARTITION BY clip_id, event_no, track_id)", ""), "pla", "lab", "pth", "ask")
def local_majority(spark, d):
    points = labelled(spark, d).withColumn("label", F.when(F.col("label").isin("red", "black"), F.col("label")))
    return identity.local_majority(asked(spark, d).drop("team"), points, CLIP, 2.0, 3)


@query("confirmed_tracks", "SELECT a.clip_id, event_no, l.track_id, count(*) FILTER (label = a.team) AS own, count(*) AS labels FROM ask a JOIN lab l ON l.clip_id = a.clip_id AND abs(l.clip_seconds - a.at) <= 0.8 WHERE label IN ('red', 'black') GROUP BY ALL HAVING own >= 2 AND 2 * own > labels", "pla", "lab", "pth", "ask")
def confirmed_tracks(spark, d):
    points = labelled(spark, d).withColumn("label", F.when(F.col("label").isin("red", "black"), F.col("label")))
    return identity.confirmed_tracks(asked(spark, d).drop("track_id"), points, CLIP, 0.8)


@query("near_ball_teams", """, n AS (SELECT l.clip_id, l.source_frame, l.track_id, CASE WHEN label IN ('red', 'black') THEN label ELSE team END AS worn, sqrt(pow(greatest(x1 - b.x, 0, b.x - x2), 2) + pow(greatest(y1 - b.y, 0, b.y - y2), 2)) / greatest(1.0, y2 - y1) AS ratio FROM lab l JOIN bal b USING (clip_id, source_frame))
SELECT clip_id, source_frame, string_agg(DISTINCT worn, ',' ORDER BY worn) AS teams, min(t) FILTER (worn = 'red') AS first_team_track, min(t) FILTER (worn = 'black') AS second_team_track FROM (SELECT *, first_value(track_id) OVER (PARTITION BY clip_id, source_frame, worn ORDER BY ratio, track_id) AS t FROM n WHERE ratio <= 1) GROUP BY ALL""", "pla", "lab", "bal")
def near_ball_teams(spark, d):
    return identity.near_ball_teams(labelled(spark, d), views.balls(spark, d), CLIP, 1.0, ["red", "black"])


@query("causal_labels")
def causal_labels(spark, d):
    points = labelled(spark, d).groupBy("clip_id", "track_id", "source_frame").agg(F.min("label").alias("label"))
    return identity.causal_labels(points, TRACK)


@query("player_summary", """, f AS (SELECT clip_id, source_frame, label, count(*) AS n FROM lab GROUP BY ALL), g AS (SELECT clip_id, source_frame, k.label, coalesce(f.n, 0) AS n FROM (SELECT DISTINCT clip_id, source_frame FROM lab) CROSS JOIN (VALUES ('red'), ('black'), ('official'), ('unknown'), ('goalkeeper')) k(label) LEFT JOIN f USING (clip_id, source_frame, label))
SELECT clip_id, label, round(median(n), 2) AS median_visible, coalesce((SELECT count(DISTINCT track_id) FROM lab l WHERE l.clip_id = g.clip_id AND l.label = g.label), 0) AS tracks FROM g GROUP BY ALL""", "pla", "lab")
def player_summary(spark, d):
    return identity.player_summary(labelled(spark, d), CLIP, ["red", "black", "official", "unknown", "goalkeeper"])


@query("region_roles", """, t AS (SELECT clip_id, track_id, median((x1 + x2) / 2) AS foot_x, median(y2) AS foot_y, max(clip_seconds) - min(clip_seconds) AS seconds, mode(team) AS label FROM pla GROUP BY ALL)
SELECT clip_id, track_id, label, foot_x, foot_y, CASE WHEN label = 'red' AND foot_x BETWEEN 0 AND 190 AND seconds >= 4 THEN 'red_keeper' WHEN foot_x BETWEEN 180 AND 400 AND foot_y BETWEEN 100 AND 300 AND seconds >= 4 THEN 'far_keeper' END AS keeper_team FROM t""", "pla")
def region_roles(spark, d):
    fx, fy = g.foot(g.box())
    t = views.players(spark, d).groupBy(*TRACK).agg(F.percentile(fx, 0.5).alias("foot_x"), F.percentile(fy, 0.5).alias("foot_y"), (F.max("clip_seconds") - F.min("clip_seconds")).alias("seconds"), F.min("team").alias("label"))
    rules = [(1, "red_keeper", ["red"], 4.0, 0.0, 190.0, -1e9, 1e9), (2, "far_keeper", ["red", "black"], 4.0, 180.0, 400.0, 100.0, 300.0)]
    regions = spark.createDataFrame(rules, "rule_no int, region_team string, eligible array<string>, least_seconds double, x_min double, x_max double, y_min double, y_max double")
    return identity.by_region(t, regions).select("clip_id", "track_id", "label", "foot_x", "foot_y", "keeper_team")


@query("attacking_goals", """, l AS (SELECT workflow_id AS clip_id, team, goal FROM (SELECT workflow_id, job_id, CASE priority_rank % 2 WHEN 0 THEN 'red' ELSE 'black' END AS team, CASE job_id % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' END AS goal FROM (SELECT o_custkey AS workflow_id, o_orderkey AS job_id, CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority_rank FROM orders)) WHERE goal IS NOT NULL QUALIFY row_number() OVER (PARTITION BY workflow_id, team ORDER BY job_id DESC) = 1),
 p AS (SELECT clip_id, max(goal) FILTER (team = 'red') AS r, max(goal) FILTER (team = 'black') AS b FROM l GROUP BY 1), q AS (SELECT clip_id, coalesce(CASE r WHEN 'left' THEN 'right' WHEN 'right' THEN 'left' END, b) AS red_attacks, coalesce(CASE b WHEN 'left' THEN 'right' WHEN 'right' THEN 'left' END, r) AS black_attacks FROM p)
SELECT * FROM q WHERE red_attacks <> black_attacks""", "job")
def attacking_goals(spark, d):
    told = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_custkey AS clip_id", "o_orderkey AS ordinal", "CASE CAST(substr(o_orderpriority, 1, 1) AS INT) % 2 WHEN 0 THEN 'red' ELSE 'black' END AS team", "CASE o_orderkey % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' END AS goal")
    return identity.attacking_goals(told, CLIP, ["red", "black"])


RECTANGLE = [(20.0, 10.0), (380.0, 10.0), (380.0, 290.0), (20.0, 290.0)]


def signed_sql(polygon) -> str:
    """The distance from the outline of a convex polygon, negative outside."""
    edges = list(zip(polygon, [*polygon[1:], polygon[0]], strict=True))
    share = lambda a, b: f"greatest(0, least(1, ((x - {a[0]}) * ({b[0]} - {a[0]}) + (y - {a[1]}) * ({b[1]} - {a[1]})) / {(b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2}))"
    near = ", ".join(f"sqrt(pow(x - {a[0]} - {share(a, b)} * ({b[0]} - {a[0]}), 2) + pow(y - {a[1]} - {share(a, b)} * ({b[1]} - {a[1]}), 2))" for a, b in edges)
    inside = " AND ".join(f"({b[0]} - {a[0]}) * (y - {a[1]}) - ({b[1]} - {a[1]}) * (x - {a[0]}) >= 0" for a, b in edges)
    return f"least({near}) * CASE WHEN {inside} THEN 1 ELSE -1 END"


def intervals_sql(source: str, polygon, least: float) -> str:
    return f"""s0 AS (SELECT *, {signed_sql(polygon)} AS signed FROM {source}), s1 AS (SELECT *, signed < -5 AS outside, row_number() OVER w AS rn, lag(signed) OVER w AS ls FROM s0 WINDOW w AS (PARTITION BY clip_id ORDER BY source_frame)),
 s2 AS (SELECT *, sum(CASE WHEN outside AND coalesce(ls >= -5, true) THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY source_frame) AS run, min(CASE WHEN NOT outside THEN clip_seconds END) OVER (PARTITION BY clip_id ORDER BY source_frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS res FROM s1),
 iv AS (SELECT clip_id, min(source_frame) AS start_frame, max(source_frame) AS end_frame, min(clip_seconds) AS start_seconds, max(clip_seconds) AS end_seconds, round(min(signed), 6) AS minimum_signed_distance, min(res) AS resumed_seconds, min(rn) = 1 AS starts_outside FROM s2 WHERE outside GROUP BY clip_id, run HAVING max(clip_seconds) - min(clip_seconds) + 1e-9 >= {least})"""


views.SQL["iv"] = intervals_sql("bal", RECTANGLE, 0.04)
views.SQL["piv"] = intervals_sql("pth", POLYGON, 0.04)


def stoppages(spark, d):
    return tracks.boundary_intervals(views.balls(spark, d), CLIP, RECTANGLE, 5.0, 0.04).withColumns(r6("minimum_signed_distance"))


@query("boundary_intervals", "SELECT * FROM iv", "pth", "piv")
def boundary_intervals(spark, d):
    return tracks.boundary_intervals(views.path(spark, d), CLIP, POLYGON, 5.0, 0.04).withColumns(r6("minimum_signed_distance"))


@query("ball_stoppages", "SELECT * FROM iv", "bal", "iv")
def ball_stoppages(spark, d):
    return stoppages(spark, d)


views.SQL["rel"] = """bst AS (SELECT clip_id, clip_seconds, lead(clip_seconds) OVER w AS next_seconds, sqrt(pow(lead(x) OVER w - x, 2) + pow(lead(y) OVER w - y, 2)) / (lead(clip_seconds) OVER w - clip_seconds) AS speed FROM bal WINDOW w AS (PARTITION BY clip_id ORDER BY clip_seconds)),
 rel AS (SELECT i.* EXCLUDE (search_end), CASE WHEN search_end IS NULL OR f.next_seconds <= search_end THEN round(f.clip_seconds, 3) END AS play_resumed_seconds FROM (SELECT *, lead(start_seconds) OVER (PARTITION BY clip_id ORDER BY start_seconds) AS search_end FROM iv) i ASOF LEFT JOIN (SELECT * FROM bst WHERE speed >= 500) f ON f.clip_id = i.clip_id AND i.resumed_seconds <= f.clip_seconds)"""


def ball_steps(spark, d):
    later = tracks.ordered(CLIP)
    rows = views.balls(spark, d).withColumns({c: F.lead(v).over(later) for c, v in (("next_seconds", "clip_seconds"), ("nx", "x"), ("ny", "y"))}).where("next_seconds > clip_seconds")
    return rows.select("clip_id", "clip_seconds", "next_seconds", (g.distance(F.col("x"), F.col("y"), F.col("nx"), F.col("ny")) / (F.col("next_seconds") - F.col("clip_seconds"))).alias("speed"))


def restarts(spark, d):
    return state.restart_releases(stoppages(spark, d), ball_steps(spark, d), CLIP, 500.0)


@query("restart_releases", "SELECT clip_id, start_seconds, resumed_seconds, play_resumed_seconds FROM rel", "bal", "iv", "rel")
def restart_releases(spark, d):
    return restarts(spark, d).select("clip_id", "start_seconds", "resumed_seconds", "play_resumed_seconds")


@query("aerial_crossings", """, x AS (SELECT i.*, p.end_seconds AS pe, p.team AS pt FROM iv i ASOF LEFT JOIN (SELECT clip_id, end_seconds, max(team) AS team FROM spl GROUP BY ALL) p ON p.clip_id = i.clip_id AND i.start_seconds >= p.end_seconds),
 y AS (SELECT x.*, n.start_seconds AS ns, n.team AS nt FROM x ASOF LEFT JOIN (SELECT clip_id, start_seconds, max(team) AS team FROM spl GROUP BY ALL) n ON n.clip_id = x.clip_id AND x.resumed_seconds <= n.start_seconds)
SELECT clip_id, start_seconds, CASE WHEN start_seconds - pe <= 1 AND ns - resumed_seconds <= 1.2 AND ns - start_seconds <= 4 AND pt = nt THEN 'continuous_possession' END AS reason FROM y""", *SPELL_VIEWS, "iv")
def aerial_crossings(spark, d):
    return state.without_aerial_crossings(stoppages(spark, d), controlled(spark, d), CLIP).select("clip_id", "start_seconds", "reason")


RULES = {
    "law_event": "CASE WHEN start_frame % 97 = 3 THEN 'period_end' WHEN start_frame % 7 = 1 THEN 'offence' WHEN start_frame % 7 = 2 THEN 'goal' WHEN start_frame % 7 = 3 THEN 'other_referee_stoppage' END",
    "stoppage_kind": "CASE WHEN start_frame % 11 = 4 THEN 'stationary_ball_restart' END",
    "restart_type": "CASE WHEN start_frame % 5 = 1 THEN 'throw_in' WHEN start_frame % 5 = 2 THEN 'corner_kick' END",
    "advantage_applied": "CASE WHEN start_frame % 3 = 1 THEN true WHEN start_frame % 3 = 2 THEN false END",
    "continued_seconds": "CASE WHEN start_frame % 4 = 1 THEN start_seconds + 0.4 END",
    "confirmed_seconds": "CASE WHEN start_frame % 4 = 2 THEN start_seconds + 0.6 END",
    "confidence": "CASE WHEN start_frame % 2 = 0 THEN 0.625 END",
    "release_confidence": "CAST(NULL AS DOUBLE)", "continuation_confidence": "CAST(NULL AS DOUBLE)", "confirmation_confidence": "CAST(NULL AS DOUBLE)",
}
LAW_SQL = "CASE " + " ".join(f"WHEN r = '{k}' THEN '{v}'" for k, v in state.LAWS.items()) + " END"
law = lambda r: LAW_SQL.replace("r = ", f"{r} = ")
RELEASED = "law_8_start_and_restart"


def branch(pos, at, to, trigger, confidence, restart, law_, where):
    return f"SELECT clip_id, start_seconds, {pos} AS pos, round(least(greatest({at}, 0), duration), 3) AS s, '{to}' AS state, {trigger} AS trigger, CAST({confidence} AS DOUBLE) AS confidence, {restart} AS restart_type, {law_} AS law_reference FROM lw WHERE start_seconds <= duration AND {where}"


OFFENCE, STOP, STILL = "law_event = 'offence'", "law_event IN ('goal', 'other_referee_stoppage')", "law_event IS NULL AND stoppage_kind IS NOT NULL"
OPENING, EXIT = "law_event IS NULL AND stoppage_kind IS NULL AND starts_outside", "law_event IS NULL AND stoppage_kind IS NULL AND NOT starts_outside"
FREE, OTHER, UNKNOWN = "coalesce(restart_type, 'free_kick')", "CASE WHEN law_event = 'goal' THEN 'kick_off' ELSE coalesce(restart_type, 'dropped_ball') END", "coalesce(restart_type, 'unknown')"
LEGAL = "play_resumed_seconds IS NOT NULL"
PROPOSED = " UNION ALL ".join([
    branch(0, "start_seconds", "restart_pending", "'offence_stopped_play'", "coalesce(confidence, 0.75)", FREE, f"'{state.ADVANTAGE}'", f"{OFFENCE} AND NOT advantage_applied"),
    branch(1, "start_seconds", "possible_stoppage", "'possible_offence_awaiting_play_outcome'", "coalesce(confidence, 0.5)", FREE, f"'{state.ADVANTAGE}'", f"{OFFENCE} AND advantage_applied IS NULL"),
    branch(2, "continued_seconds", "in_play", "'advantage_or_no_stoppage_confirmed'", "0.7", "NULL", f"'{state.ADVANTAGE}'", f"{OFFENCE} AND advantage_applied IS NULL AND continued_seconds IS NOT NULL"),
    branch(3, "confirmed_seconds", "restart_pending", "'stoppage_confirmed'", "0.75", FREE, f"'{state.ADVANTAGE}'", f"{OFFENCE} AND advantage_applied IS NULL AND continued_seconds IS NULL AND confirmed_seconds IS NOT NULL"),
    branch(4, "play_resumed_seconds", "in_play", "'legal_restart_release_detected'", "0.85", FREE, law(FREE), f"{OFFENCE} AND coalesce(NOT advantage_applied, true) AND NOT (advantage_applied IS NULL AND continued_seconds IS NOT NULL) AND {LEGAL}"),
    branch(0, "start_seconds", "restart_pending", "CASE WHEN law_event = 'goal' THEN 'goal_requires_kick_off' ELSE 'referee_stoppage_requires_restart' END", "coalesce(confidence, 0.75)", OTHER, f"'{RELEASED}'", STOP),
    branch(1, "play_resumed_seconds", "in_play", "'legal_restart_release_detected'", "0.85", OTHER, law(OTHER), f"{STOP} AND {LEGAL}"),
    branch(0, "start_seconds", "period_ended", "'period_ended'", "coalesce(confidence, 0.9)", "NULL", f"'{RELEASED}'", "law_event = 'period_end'"),
    branch(0, "start_seconds", "restart_pending", "'stationary_ball_and_player_disengagement'", "coalesce(confidence, 0.75)", UNKNOWN, law(UNKNOWN), STILL),
    branch(1, "play_resumed_seconds", "in_play", "'restart_kick_and_player_reaction'", "0.85", UNKNOWN, law(UNKNOWN), f"{STILL} AND {LEGAL}"),
    branch(0, "start_seconds", "unknown", "'ball_tracking_opened_outside_boundary'", "0.5", "NULL", f"'{state.BALL}'", f"{OPENING} AND start_seconds > 1e-9"),
    branch(1, "play_resumed_seconds", "in_play", "'restart_release_detected'", "0.7", "'unknown'", f"'{RELEASED}'", f"{OPENING} AND {LEGAL}"),
    branch(0, "start_seconds", "out_of_play", "'sustained_boundary_exit'", "0.75", "NULL", f"'{state.BALL}'", EXIT),
    branch(1, "resumed_seconds", "restart_pending", "'ball_reentered_before_restart_release'", "0.7", "'unknown'", f"'{RELEASED}'", f"{EXIT} AND resumed_seconds IS NOT NULL AND (play_resumed_seconds IS NULL OR play_resumed_seconds > resumed_seconds + 1e-9)"),
    branch(2, "play_resumed_seconds", "in_play", "'restart_release_detected'", "0.8", "'unknown'", f"'{RELEASED}'", f"{EXIT} AND {LEGAL}"),
])
views.SQL["tl"] = f"""dur AS (SELECT clip_id, max(clip_seconds) AS duration FROM bal GROUP BY 1), lw AS (SELECT *, {", ".join(f"{v} AS {k}" for k, v in RULES.items())} FROM rel JOIN dur USING (clip_id)),
 ini AS (SELECT clip_id, duration, CASE WHEN (SELECT starts_outside AND start_seconds <= 1e-9 FROM lw WHERE lw.clip_id = dur.clip_id ORDER BY start_seconds LIMIT 1) THEN 'unknown' ELSE 'in_play' END AS initial FROM dur),
 pro AS ({PROPOSED}), ch AS (SELECT * FROM (SELECT *, row_number() OVER w AS no, coalesce(lag(state) OVER w, initial) AS was FROM pro JOIN ini USING (clip_id) WINDOW w AS (PARTITION BY clip_id ORDER BY start_seconds, pos)) WHERE state <> was),
 tl AS (SELECT clip_id, row_number() OVER w AS transition_no, s AS clip_seconds, coalesce(lag(state) OVER w, initial) AS previous_state, state, trigger, confidence, restart_type, law_reference, round(start_seconds, 3) AS boundary_start_seconds, initial, duration FROM ch WINDOW w AS (PARTITION BY clip_id ORDER BY s, no)),
 stt AS (SELECT clip_id, state, clip_seconds AS start_seconds, coalesce(lead(clip_seconds) OVER w, duration) AS end_seconds FROM tl WINDOW w AS (PARTITION BY clip_id ORDER BY transition_no) UNION ALL SELECT clip_id, initial, 0, clip_seconds FROM tl WHERE transition_no = 1 UNION ALL SELECT clip_id, 'in_play', 0, round(duration, 3) FROM dur WHERE clip_id NOT IN (SELECT clip_id FROM tl)),
 st AS (SELECT * FROM stt WHERE end_seconds > start_seconds)"""
STATE_VIEWS = ("bal", "iv", "rel", "tl")


def ruled(spark, d):
    return restarts(spark, d).selectExpr("*", *[f"{v} AS {k}" for k, v in RULES.items()])


def durations(spark, d):
    return views.balls(spark, d).groupBy("clip_id").agg(F.max("clip_seconds").alias("duration_seconds"))


def changes_of(spark, d):
    return state.transitions(ruled(spark, d), durations(spark, d), CLIP)


@query("state_transitions", "SELECT clip_id, transition_no, clip_seconds, previous_state, state, trigger, confidence, restart_type, law_reference, boundary_start_seconds FROM tl", *STATE_VIEWS)
def state_transitions(spark, d):
    return changes_of(spark, d).drop("duration_seconds", "initial_state")


@query("state_intervals", "SELECT * FROM st", *STATE_VIEWS)
def state_intervals(spark, d):
    return state.state_intervals(changes_of(spark, d), durations(spark, d), CLIP)


@query("gated_events", f""", e AS ({TRANSFERS}), b AS (SELECT *, max(end_seconds) OVER (PARTITION BY clip_id) AS lst FROM st)
SELECT e.* FROM e WHERE (event_type = 'turnover_candidate' AND EXISTS (SELECT 1 FROM tl WHERE tl.clip_id = e.clip_id AND tl.state = 'out_of_play' AND abs(tl.clip_seconds - e.clip_seconds) <= 1e-6))
 OR (EXISTS (SELECT 1 FROM b WHERE b.clip_id = e.clip_id AND b.state = 'in_play' AND e.clip_seconds >= b.start_seconds AND (e.clip_seconds < b.end_seconds OR (b.end_seconds = lst AND e.clip_seconds <= b.end_seconds)))
  AND EXISTS (SELECT 1 FROM b WHERE b.clip_id = e.clip_id AND b.state = 'in_play' AND e.completion_seconds >= b.start_seconds AND (e.completion_seconds < b.end_seconds OR (b.end_seconds = lst AND e.completion_seconds <= b.end_seconds))))""", *SPELL_VIEWS, "iv", "rel", "tl")
def gated_events(spark, d):
    t = shared(spark, d)
    return state.gated(t["transfers"], t["states"], t["changes"], CLIP)


@query("boundary_contexts", """SELECT a.clip_id, a.event_no, coalesce((SELECT arg_min(c, start_seconds) FROM (SELECT start_seconds, CASE WHEN a.at BETWEEN start_seconds AND end_seconds THEN 'possible_out' WHEN resumed_seconds <= a.at AND a.at < resumed_seconds + 0.5 THEN 'recently_resumed' END AS c FROM iv WHERE iv.clip_id = a.clip_id) WHERE c IS NOT NULL), 'inside') AS boundary_context FROM ask a""", "bal", "iv", "pth", "ask")
def boundary_contexts(spark, d):
    return state.boundary_context(asked(spark, d).select("clip_id", "event_no", "at"), stoppages(spark, d), CLIP, "at", 0.5).drop("at")


@query("boundary_turnovers")
def boundary_turnovers(spark, d):
    return lost_outside(shared(spark, d))


def lost_outside(t: chain.Inputs, prior=None):
    intervals = t["restarts"].withColumn("stoppage_kind", F.lit(None).cast("string"))
    return state.boundary_turnovers(intervals, t["spells"], t["transfers"] if prior is None else prior, CLIP, apart=0.5, startup=2.0)


@query("outside_events", f""", e AS ({TRANSFERS}), h AS (SELECT e.*, (SELECT arg_min(struct_pack(r := resumed_seconds, ok := true), start_seconds) FROM rel WHERE rel.clip_id = e.clip_id AND NOT starts_outside AND start_seconds <= e.clip_seconds AND e.clip_seconds <= coalesce(play_resumed_seconds, resumed_seconds, 1e9)) AS hit,
 EXISTS (SELECT 1 FROM rel WHERE rel.clip_id = e.clip_id AND NOT starts_outside AND start_seconds <= e.completion_seconds AND e.completion_seconds <= coalesce(play_resumed_seconds, resumed_seconds, 1e9)) AS completed_outside FROM e)
SELECT clip_id, clip_seconds, from_track, to_track, coalesce(event_type = 'pass_candidate' AND hit.ok AND NOT EXISTS (SELECT 1 FROM ob WHERE ob.clip_id = h.clip_id AND ob.track_id = h.from_track AND ob.clip_seconds >= hit.r AND ob.clip_seconds < h.clip_seconds), false) AS released_outside, completed_outside FROM h""", *SPELL_VIEWS, "iv", "rel")
def outside_events(spark, d):
    out = state.outside_flags(control_transfers(spark, d), restarts(spark, d), observed(spark, d), CLIP)
    return out.select("clip_id", "clip_seconds", "from_track", "to_track", "released_outside", "completed_outside")


@query("continuous_flights", """, n AS (SELECT iv.clip_id, iv.start_seconds, b.clip_seconds, b.x - lag(b.x) OVER w AS dx, b.y - lag(b.y) OVER w AS dy, b.clip_seconds - lag(b.clip_seconds) OVER w AS dt FROM iv JOIN bal b ON b.clip_id = iv.clip_id AND b.clip_seconds >= iv.start_seconds - 0.4 AND b.clip_seconds < iv.end_seconds + 0.4 + 1e-9 WINDOW w AS (PARTITION BY iv.clip_id, iv.start_seconds ORDER BY b.clip_seconds)),
 s AS (SELECT *, sqrt(dx * dx + dy * dy) AS long, sqrt(dx * dx + dy * dy) / dt AS speed FROM n WHERE dt > 0), p AS (SELECT clip_id, start_seconds, count(*) AS steps, median(speed) AS med, avg(CASE WHEN speed >= 80 THEN 1.0::DOUBLE ELSE 0 END) AS mov FROM s GROUP BY ALL),
 t AS (SELECT clip_id, start_seconds, avg(CASE WHEN c >= 0.7 THEN 1.0::DOUBLE ELSE 0 END) AS straight FROM (SELECT *, (dx * lag(dx) OVER w + dy * lag(dy) OVER w) / nullif(long * lag(long) OVER w, 0) AS c FROM s WHERE speed >= 80 WINDOW w AS (PARTITION BY clip_id, start_seconds ORDER BY clip_seconds)) WHERE c IS NOT NULL GROUP BY ALL)
SELECT iv.clip_id, iv.start_seconds, CASE WHEN steps >= 4 AND end_seconds - iv.start_seconds >= 0.04 AND abs(minimum_signed_distance) >= 6 AND med >= 120 AND mov >= 0.5 AND coalesce(straight, 0) >= 0.5 THEN 'continuous_flight' END AS reason, round(med, 2) AS median_speed, round(coalesce(mov, 0), 4) AS moving_ratio, round(coalesce(straight, 0), 4) AS straight_ratio FROM iv LEFT JOIN p USING (clip_id, start_seconds) LEFT JOIN t USING (clip_id, start_seconds)""", "bal", "iv")
def continuous_flights(spark, d):
    out = state.continuous_flights(stoppages(spark, d), views.balls(spark, d), CLIP, ratio=0.5, seconds=0.04, depth=6.0)
    return out.select("clip_id", "start_seconds", "reason", "median_speed", "moving_ratio", "straight_ratio")


@query("fragmented_projections", """, st3 AS (SELECT *, start_frame % 5 AS merged, coalesce(lead(resumed_seconds, 3) OVER (PARTITION BY clip_id ORDER BY start_seconds), end_seconds) AS back FROM iv), j AS (SELECT s.clip_id, s.start_seconds, merged, minimum_signed_distance, count(p.spell_no) AS inner_spells, round(max(p.end_seconds - p.start_seconds), 3) AS longest_spell FROM st3 s LEFT JOIN spl p ON p.clip_id = s.clip_id AND p.start_seconds >= s.start_seconds + 0.5 AND p.end_seconds <= s.back - 0.5 AND p.end_seconds - p.start_seconds >= 0.08 GROUP BY ALL)
SELECT clip_id, start_seconds, inner_spells, longest_spell, CASE WHEN merged >= 3 AND abs(minimum_signed_distance) <= 60 AND inner_spells > 0 THEN 'competitive_possession_inside_boundary' END AS reason FROM j""", *SPELL_VIEWS, "iv")
def fragmented_projections(spark, d):
    """Each stoppage stretched to the return of the third one after it."""
    w = Window.partitionBy("clip_id").orderBy("start_seconds")
    wide = stoppages(spark, d).withColumn("back", F.coalesce(F.lead("resumed_seconds", 3).over(w), F.col("end_seconds"))).withColumns({"resumed_seconds": F.col("back"), "merged": F.col("start_frame") % 5})
    out = state.fragmented_projections(wide, controlled(spark, d), CLIP, margin=0.5, seconds=0.08)
    return out.select("clip_id", "start_seconds", "inner_spells", "longest_spell", "reason")


@query("comparison_types", f"SELECT clip_id, clip_seconds, from_track, to_track, CASE event_type WHEN 'pass_candidate' THEN 'completed_pass' WHEN 'turnover_candidate' THEN 'turnover' END AS comparison_type FROM ({TRANSFERS})", *SPELL_VIEWS)
def comparison_types(spark, d):
    return control_transfers(spark, d).select("clip_id", "clip_seconds", "from_track", "to_track", rules.comparison_type(F.col("event_type")).alias("comparison_type"))


LAB_PALETTE = {"black": (25, 25, 25), "blue": (170, 70, 25), "green": (45, 140, 45), "red": (35, 35, 190), "white": (220, 220, 220), "yellow": (40, 210, 220)}


@query("lab_colors", """, l AS (SELECT track_id, CASE WHEN r / 255.0::DOUBLE <= 0.04045 THEN r / 255.0::DOUBLE / 12.92 ELSE pow((r / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END AS r, CASE WHEN g / 255.0::DOUBLE <= 0.04045 THEN g / 255.0::DOUBLE / 12.92 ELSE pow((g / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END AS g, CASE WHEN b / 255.0::DOUBLE <= 0.04045 THEN b / 255.0::DOUBLE / 12.92 ELSE pow((b / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END AS b FROM col),
 x AS (SELECT track_id, (0.412453 * r + 0.357580 * g + 0.180423 * b) / 0.950456 AS x, 0.212671 * r + 0.715160 * g + 0.072169 * b AS y, (0.019334 * r + 0.119193 * g + 0.950227 * b) / 1.088754 AS z FROM l),
 f AS (SELECT track_id, y, CASE WHEN x > 0.008856 THEN pow(x, 1.0::DOUBLE / 3) ELSE 7.787 * x + 16.0::DOUBLE / 116 END AS fx, CASE WHEN y > 0.008856 THEN pow(y, 1.0::DOUBLE / 3) ELSE 7.787 * y + 16.0::DOUBLE / 116 END AS fy, CASE WHEN z > 0.008856 THEN pow(z, 1.0::DOUBLE / 3) ELSE 7.787 * z + 16.0::DOUBLE / 116 END AS fz FROM x)
SELECT track_id, round(CASE WHEN y > 0.008856 THEN 116 * fy - 16 ELSE 903.3 * y END * 255 / 100, 0) AS lab_l, round(500 * (fx - fy) + 128, 0) AS lab_a, round(200 * (fy - fz) + 128, 0) AS lab_b FROM f""", "col")
def lab_colors(spark, d):
    parts = rules.lab(*[F.col(c).cast("double") for c in ("b", "g", "r")])
    return views.colors(spark, d).select("track_id", *[p.alias(f"lab_{n}") for p, n in zip(parts, "lab", strict=True)])


@query("lab_color_names")
def lab_color_names(spark, d):
    return views.colors(spark, d).select("track_id", rules.nearest_name(*[F.col(c).cast("double") for c in ("b", "g", "r")], LAB_PALETTE).alias("color"))


@query("uncrossed_passes", f""", e AS ({TRANSFERS}), i AS (SELECT e.clip_id, e.clip_seconds, e.from_track, e.to_track, e.completion_seconds, o.clip_seconds AS t, o.team, o.track_id, o.control_ratio FROM e JOIN ob o ON o.clip_id = e.clip_id AND o.clip_seconds > e.clip_seconds AND o.clip_seconds < e.completion_seconds AND o.team <> e.team WHERE event_type = 'pass_candidate'),
 x AS (SELECT DISTINCT a.clip_id, a.clip_seconds, a.from_track, a.to_track FROM i a JOIN i b ON a.clip_id = b.clip_id AND a.clip_seconds = b.clip_seconds AND a.from_track = b.from_track AND a.to_track = b.to_track AND a.team = b.team AND a.track_id = b.track_id AND a.t <> b.t AND abs(a.t - b.t) <= 0.8 + 1e-9 WHERE a.control_ratio <= 0.8 AND b.control_ratio <= 1.2)
SELECT * FROM e ANTI JOIN x USING (clip_id, clip_seconds, from_track, to_track)""", *SPELL_VIEWS)
def uncrossed_passes(spark, d):
    return rules.without_crossing(control_transfers(spark, d), observed(spark, d), CLIP, 0.8, 1.2, 0.8)


@query("proven_receptions", f""", e AS ({TRANSFERS}), w AS (SELECT spl.clip_id, spl.spell_no, spl.track_id, round(spl.start_seconds, 3) AS s FROM spl JOIN ks USING (clip_id, spell_no) JOIN o2 USING (clip_id, k) LEFT JOIN mo ON mo.clip_id = o2.clip_id AND mo.source_frame = o2.source_frame GROUP BY ALL HAVING NOT bool_or(o2.control_ratio <= 0.5 OR coalesce(mo.turn <= -0.25, false)))
SELECT e.* FROM e WHERE NOT (confidence < 0.55 AND EXISTS (SELECT 1 FROM w WHERE w.clip_id = e.clip_id AND w.track_id = e.to_track AND w.s = e.completion_seconds))""", *SPELL_VIEWS)
def proven_receptions(spark, d):
    numbered = control.spell_numbers(observed(spark, d), CLIP, 0.64, 0.75)
    motion = tracks.motion(views.balls(spark, d), TRACK).select("clip_id", "source_frame", "turn_cosine")
    return rules.without_transient(control_transfers(spark, d), control.flat(control.spells(numbered, CLIP), CLIP), motion, numbered, CLIP, sure=0.55, close=0.5)


@query("single_receptions")
def single_receptions(spark, d):
    return rules.one_reception(merged_transfers(spark, d), CLIP, 0.5)


@query("trusted_openings", f""", e AS ({TRANSFERS}), f AS (SELECT *, min(CASE WHEN confidence >= 0.6 OR event_type <> 'pass_candidate' THEN clip_seconds END) OVER (PARTITION BY clip_id) AS first_ FROM e), g AS (SELECT *, max(CASE WHEN clip_seconds < first_ THEN completion_seconds END) OVER (PARTITION BY clip_id) AS done FROM f)
SELECT * EXCLUDE (first_, done) FROM g WHERE NOT coalesce(clip_seconds < first_ AND first_ - done >= 0.1, false)""", *SPELL_VIEWS)
def trusted_openings(spark, d):
    return rules.without_startup(control_transfers(spark, d), CLIP, 0.6, 0.1)


@query("single_touch_senders", """, cl AS (SELECT clip_id, spell_no, min(clip_seconds) AS t, arg_min(ball_x, clip_seconds) AS bx, arg_min(ball_y, clip_seconds) AS by_, arg_min(height, clip_seconds) AS h FROM o2 JOIN ks USING (clip_id, k) WHERE control_ratio <= 0.5 GROUP BY ALL HAVING count(*) >= 2),
 sb AS (SELECT * FROM spl WHERE observations >= 2), si AS (SELECT spl.*, o2.control_ratio AS r FROM spl JOIN ks USING (clip_id, spell_no) JOIN o2 USING (clip_id, k) WHERE observations = 1 AND o2.control_ratio <= 0.35),
 cv AS (SELECT DISTINCT a.clip_id, a.track_id AS x, b.track_id AS y FROM pla a JOIN pla b ON a.clip_id = b.clip_id AND a.source_frame = b.source_frame AND a.track_id <> b.track_id)
SELECT clip_id, spell_no, team, track_id, observations FROM sb UNION ALL SELECT clip_id, spell_no, team, track_id, observations FROM si WHERE EXISTS (SELECT 1 FROM sb JOIN cl USING (clip_id, spell_no) JOIN cv ON cv.clip_id = sb.clip_id AND cv.y = sb.track_id WHERE sb.clip_id = si.clip_id AND sb.team = si.team AND sb.track_id <> si.track_id AND cv.x = si.track_id AND cl.t >= si.start_seconds AND cl.t < si.start_seconds + 2 + 1e-9 AND sqrt(pow(cl.bx - si.lx, 2) + pow(cl.by_ - si.ly, 2)) / greatest(1.0, (si.lh + cl.h) / 2) >= 0.3)""", *SPELL_VIEWS)
def single_touch_senders(spark, d):
    numbered = control.spell_numbers(observed(spark, d), CLIP, 0.64, 0.75)
    rows = control.spells(numbered, CLIP)
    seen = joins.covisible_pairs(views.players(spark, d), CLIP)
    return control.flat(control.with_single_touches(rows, control.stable(rows, 2, []), numbered, seen, CLIP, 2.0, 0.3), CLIP).select("clip_id", "spell_no", "team", "track_id", "observations")


def numbered(events):
    return events.withColumn("event_no", F.row_number().over(Window.partitionBy("clip_id").orderBy("clip_seconds", "completion_seconds", "from_track", "to_track", "event_type")).cast("bigint"))


def follow_shirts(events, t):
    return still.identity_switches(numbered(events), t["labels"], CLIP, ("red", "black"), 4.0).drop("event_no", "corrected")


#: The rules that are built, in order: what guards the start, what the stoppages add, who wears which shirt, what drops events, and what the state of play lets through.
RULE_CHAIN = [
    [chain.Rule("startup_guard", lambda e, t: control.startup_guarded(e, t["observations"], CLIP, 5.0, 0.5))],
    [chain.Rule("boundary_turnovers", lambda e, t: e.unionByName(lost_outside(t, e)), ("startup_guard",))],
    [chain.Rule("identity_switches", follow_shirts, ("boundary_turnovers",)), chain.Rule("one_reception", lambda e, t: rules.one_reception(e, CLIP, 0.5), ("identity_switches",))],
    [chain.Rule("crossing_control", lambda e, t: rules.without_crossing(e, t["observations"], CLIP, 0.8, 1.2, 0.8), ("one_reception",)),
     chain.Rule("transient_receptions", lambda e, t: rules.without_transient(e, control.flat(t["spells"], CLIP), t["motion"], t["numbered"], CLIP, sure=0.55, close=0.5), ("one_reception",)),
     chain.Rule("startup_chain", lambda e, t: rules.without_startup(e, CLIP, 0.6, 0.1), ("transient_receptions",))],
    [chain.Rule("state_gate", lambda e, t: state.gated(e, t["states"], t["changes"], CLIP), ("startup_chain", "boundary_turnovers"))],
]


@query("rule_chain")
def rule_chain(spark, d):
    """All rules over the merged transfers, with inputs computed once."""
    t = shared(spark, d)
    return chain.run(merged(spark, d, t), RULE_CHAIN, t)


@query("identity_switches")
def identity_switches(spark, d):
    t = shared(spark, d)
    return still.identity_switches(numbered(t["transfers"]), t["labels"], CLIP, ("red", "black"), 4.0)


def dead_ball(spark, d):
    """A ball that lies still for a second and is kicked, over and over; at times it is not seen."""
    e = spark.read.parquet(f"{d}/events.parquet").selectExpr("event_id DIV 500 AS clip_id", "event_id % 500 AS i", "user_id", "value", "event_type")
    e = e.withColumn("phase", F.expr("i % 60")).withColumn("moved", F.expr("i DIV 60 * 31 + greatest(phase - 26, 0)"))
    return e.where("event_type <> 'signup' OR user_id % 3 > 0").selectExpr("clip_id", "CAST(i AS DOUBLE) / 25 AS clip_seconds", "CAST(moved * 18 % 700 AS DOUBLE) + CAST(user_id % 2 AS DOUBLE) / 2 AS x", "300.0D + CASE WHEN event_type = 'error' AND user_id % 5 = 0 THEN 9 ELSE 0 END AS y", "value / 400 AS confidence")


def standing_players(spark, d):
    """Ten players around the ball who stand while it lies still and run when it is kicked."""
    e = spark.read.parquet(f"{d}/events.parquet").selectExpr("event_id DIV 500 AS clip_id", "event_id % 500 AS i", "user_id", "explode(sequence(0, 9)) AS k")
    e = e.withColumn("phase", F.expr("i % 60")).withColumn("moved", F.expr("i DIV 60 * 31 + greatest(phase - 26, 0)")).where("(user_id + k) % 11 > 0")
    e = e.withColumn("cx", F.expr("CAST(moved * 18 % 700 AS DOUBLE) + k * 30 - 150 + CASE WHEN phase >= 24 THEN (phase - 24) * (2 + k % 3) ELSE 0 END + CASE WHEN (user_id + i + k) % 9 = 0 THEN 3 ELSE 0 END"))
    return e.selectExpr("clip_id", "k AS track_id", "CAST(i AS DOUBLE) / 25 AS clip_seconds", "cx - 10 AS x1", "260.0D AS y1", "cx + 10 AS x2", "300.0D + k AS y2")


@query("stationary_restarts")
def stationary_restarts(spark, d):
    return still.stationary_restarts(dead_ball(spark, d), standing_players(spark, d), CLIP)


@query("restart_states")
def restart_states(spark, d):
    """Changes of state through the restarts that the still ball shows."""
    found = still.stationary_restarts(dead_ball(spark, d), standing_players(spark, d), CLIP)
    nothing = {c: F.lit(None).cast(t) for c, t in {"law_event": "string", "advantage_applied": "boolean", "continued_seconds": "double", "confirmed_seconds": "double", "continuation_confidence": "double", "confirmation_confidence": "double"}.items()}
    clips = dead_ball(spark, d).groupBy("clip_id").agg(F.max("clip_seconds").alias("duration_seconds"))
    return state.transitions(found.drop("duration_seconds").withColumns(nothing), clips, CLIP).drop("duration_seconds", "initial_state")


def passed_ball(spark, d):
    """The ball that lies still and is kicked, over and over, by frames."""
    e = spark.read.parquet(f"{d}/events.parquet").selectExpr("event_id DIV 500 AS clip_id", "event_id % 500 AS source_frame", "user_id")
    e = e.withColumn("phase", F.expr("source_frame % 60")).withColumn("moved", F.expr("source_frame DIV 60 * 31 + greatest(phase - 26, 0)"))
    return e.selectExpr("clip_id", "source_frame", "CAST(source_frame AS DOUBLE) / 25 AS clip_seconds", "1L AS track_id", "CAST(moved * 18 % 700 AS DOUBLE) + CAST(user_id % 3 AS DOUBLE) / 2 AS x", "300.0D AS y", "phase", "user_id")


def passing_players(spark, d):
    """Two of a team who have the ball in turn: one before it comes to rest, one after it flies again."""
    k = passed_ball(spark, d).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(2))))
    k = k.withColumn("dy", F.expr("CASE WHEN phase BETWEEN 56 - 10 * k AND 60 - 10 * k AND user_id % 5 > 0 THEN 2.0D ELSE 3000.0D END"))
    return k.selectExpr("clip_id", "source_frame", "clip_seconds", "CAST(k AS BIGINT) AS track_id", "'red' AS team", "x - 10 AS x1", "y + dy - 40 AS y1", "x + 10 AS x2", "y + dy AS y2")


def passed_spells(spark, d):
    seen = control.control_observations(passing_players(spark, d), passed_ball(spark, d), CLIP, 1.2, ground=0.9, flyby_speed=700.0)
    return control.spells(control.spell_numbers(seen, CLIP, 0.64, 0.75), CLIP)


@query("slowed_flights")
def slowed_flights(spark, d):
    """Passes whose flight a ball at rest interrupts."""
    return control.decelerations(passed_spells(spark, d), control.triples(passed_ball(spark, d), CLIP), CLIP, 100.0, 0.9, 1.0, 8.0, 0.1)


@query("restarts_through_setup")
def restarts_through_setup(spark, d):
    """Still-ball restarts after which a player carries the ball for a while, in some cycles."""
    balls = dead_ball(spark, d)
    carried = balls.withColumn("i", F.round(F.col("clip_seconds") * 25).cast("long")).where("i % 60 BETWEEN 30 AND 58 AND i DIV 60 % 3 > 0").groupBy("clip_id", F.expr("i DIV 60").alias("cycle")).agg(F.min("clip_seconds").alias("start_seconds"), F.max("clip_seconds").alias("end_seconds"))
    found = once(still.stationary_restarts(balls, standing_players(spark, d), CLIP))
    return still.through_setup(found, carried.drop("cycle"), balls, CLIP)


@query("handoff_free_passes", f""", b AS (SELECT clip_id, track_id, source_frame, clip_seconds, CASE WHEN track_id % 5 = 0 THEN 'black' ELSE team END AS worn, x1, y1, x2, y2 FROM pla QUALIFY row_number() OVER (PARTITION BY clip_id, track_id, source_frame ORDER BY l_partkey, l_linenumber) = 1),
 n AS (SELECT clip_id, track_id, min(source_frame) AS f, max(source_frame) AS l FROM b GROUP BY ALL), e AS ({TRANSFERS})
SELECT e.* FROM e WHERE NOT (event_type = 'pass_candidate' AND EXISTS (SELECT 1 FROM b r JOIN b s ON s.clip_id = r.clip_id AND s.source_frame = r.source_frame JOIN n x ON x.clip_id = s.clip_id AND x.track_id = s.track_id JOIN n y ON y.clip_id = r.clip_id AND y.track_id = r.track_id
 WHERE r.clip_id = e.clip_id AND r.track_id = e.to_track AND s.track_id = e.from_track AND r.clip_seconds >= e.clip_seconds - 0.41 AND r.clip_seconds <= e.completion_seconds + 1e-9
 AND greatest(0, least(r.x2, s.x2) - greatest(r.x1, s.x1)) * greatest(0, least(r.y2, s.y2) - greatest(r.y1, s.y1)) / least(greatest(1, (r.x2 - r.x1) * (r.y2 - r.y1)), greatest(1, (s.x2 - s.x1) * (s.y2 - s.y1))) >= 0.3 AND ((x.l = r.source_frame AND y.f = r.source_frame) OR r.worn <> e.team)))""", *SPELL_VIEWS)
def handoff_free_passes(spark, d):
    """Transfers without those between two tracks of one player; of a track's boxes in a frame the first counts."""
    first = Window.partitionBy("clip_id", "track_id", "source_frame").orderBy("l_partkey", "l_linenumber")
    boxes = views.players(spark, d).withColumn("k", F.row_number().over(first)).where("k = 1").select("clip_id", "track_id", "source_frame", "clip_seconds", F.when(F.col("track_id") % 5 == 0, "black").otherwise(F.col("team")).alias("team"), "x1", "y1", "x2", "y2")
    return rules.without_handoffs(control_transfers(spark, d), boxes, CLIP, overlap=0.3)


@query("controlled_turnovers")
def controlled_turnovers(spark, d):
    """Transfers, at whose completion the other team is near enough."""
    return still.controlled_turnovers(numbered(control_transfers(spark, d)), views.players(spark, d), views.balls(spark, d), CLIP, heights=0.6)
