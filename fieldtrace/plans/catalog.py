"""The engine's queries: what each operator gives on the domain tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldtrace.functions import geometry as g
from fieldtrace.operators import blocks, evidence, frames, history, joins, reports, tracks
from fieldtrace.sources import views
from fieldtrace.streaming import windows

CLIP, TRACK = ["clip_id"], ["clip_id", "track_id"]
POLYGON = [(20.0, 10.0), (380.0, 10.0), (360.0, 2400.0), (40.0, 2400.0)]
PALETTE = {"red": (40, 40, 200), "blue": (200, 60, 40), "black": (20, 20, 20), "white": (235, 235, 235)}
PITCH = (105.0, 68.0)
HOMOGRAPHY = [0.26, 0.001, 0.5, 0.002, 0.022, 0.3, 0.0001, 0.00001, 1.0]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *uses: str) -> Callable[[Query], Query]:
    """Registers a query, and its SQL over the named views."""

    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            head = "WITH RECURSIVE" if any("RECURSION" in views.SQL[u] for u in uses) else "WITH"
            SQL[name] = (f"{head} {', '.join(views.SQL[u] for u in uses)}\n" if uses else "") + sql
        return f

    return keep


def r6(*columns: str) -> dict:
    return {c: F.round(c, 6) for c in columns}


@query("box_geometry", """SELECT clip_id, source_frame, l_partkey, l_linenumber, l_extendedprice, (x1 + x2) / 2 AS center_x, (y1 + y2) / 2 AS center_y, (x1 + x2) / 2 AS foot_x, y2 AS foot_y,
 greatest(1.0, y2 - y1) AS height, round(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 6) AS diagonal FROM det""", "det")
def box_geometry(spark, d):
    return frames.with_box_geometry(views.detections(spark, d)).withColumns(r6("diagonal")).select("clip_id", "source_frame", "l_partkey", "l_linenumber", "l_extendedprice", "center_x", "center_y", "foot_x", "foot_y", "height", "diagonal")


@query("confident_boxes", "SELECT clip_id, source_frame, class_name, l_partkey, l_linenumber, confidence FROM det WHERE (class_name = 'person' AND confidence >= 0.25) OR (class_name = 'sports ball' AND confidence >= 0.1)", "det")
def confident_boxes(spark, d):
    return frames.confident(views.detections(spark, d), 0.25, 0.1).select("clip_id", "source_frame", "class_name", "l_partkey", "l_linenumber", "confidence")


@query("normalized_classes", "SELECT p_partkey, p_brand, replace(lower(p_brand), '#', '_') AS class_name FROM part WHERE lower(p_brand) IN ('brand#2', 'brand#17', 'brand#5')")
def normalized_classes(spark, d):
    names = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_brand", F.concat(F.lit("  "), "p_brand", F.lit(" ")).alias("class_name"))
    return frames.normalized_class(names, ["brand_2", "brand_17", "brand_5"])


@query("pitch_mask", """SELECT clip_id, source_frame, l_partkey, l_linenumber FROM (SELECT *, (x1 + x2) / 2 / 500 - 1 AS p FROM det)
 WHERE y2 >= 60 + 80 * p * p AND y2 <= 480 - 30 * p * p""", "det")
def pitch_mask(spark, d):
    return frames.on_pitch_mask(views.detections(spark, d), 1000.0, (60.0, 80.0), (480.0, -30.0)).select("clip_id", "source_frame", "l_partkey", "l_linenumber")


@query("near_ball_players", """SELECT clip_id, source_frame, l_partkey, l_linenumber FROM det p WHERE class_name = 'person' AND EXISTS (SELECT 1 FROM det b WHERE b.class_name = 'sports ball' AND b.clip_id = p.clip_id AND b.source_frame = p.source_frame
 AND sqrt(pow((p.x1 + p.x2) / 2 - (b.x1 + b.x2) / 2, 2) + pow(p.y2 - (b.y1 + b.y2) / 2, 2)) <= 1.5 * greatest(1, p.y2 - p.y1))""", "det")
def near_ball_players(spark, d):
    return frames.near_ball(views.detections(spark, d), CLIP).select("clip_id", "source_frame", "l_partkey", "l_linenumber")


H = HOMOGRAPHY
PTH_M = f"""pm AS (SELECT *, ({H[0]} * x + {H[1]} * y + {H[2]}) / ({H[6]} * x + {H[7]} * y + {H[8]}) AS x_metres, ({H[3]} * x + {H[4]} * y + {H[5]}) / ({H[6]} * x + {H[7]} * y + {H[8]}) AS y_metres FROM pth),
 pp AS (SELECT * FROM pm WHERE x_metres BETWEEN 0 AND 105 AND y_metres BETWEEN 0 AND 68)"""
views.SQL["pm"] = PTH_M


def on_pitch(spark, d):
    return frames.in_pitch(views.path(spark, d), HOMOGRAPHY, *PITCH)


@query("pitch_points", "SELECT clip_id, source_frame, round(x_metres, 6) AS x_metres, round(y_metres, 6) AS y_metres FROM pp", "pth", "pm")
def pitch_points(spark, d):
    return on_pitch(spark, d).withColumns(r6("x_metres", "y_metres")).select("clip_id", "source_frame", "x_metres", "y_metres")


@query("sampled_window", "SELECT clip_id, source_frame, track_id FROM pth WHERE clip_seconds >= 4 AND clip_seconds < 12 AND source_frame >= 2 AND (source_frame - 2) % 5 = 0", "pth")
def sampled_window(spark, d):
    return frames.sampled(frames.analysis_window(views.path(spark, d), 4.0, 12.0), 5, 2).select("clip_id", "source_frame", "track_id")


@query("tile_grid", """SELECT w AS width, h AS height, tx AS tile_x, ty AS tile_y FROM (SELECT DISTINCT 600 + p_size * 40 AS w, 400 + p_size * 20 AS h FROM part),
 LATERAL (SELECT unnest(list_distinct(list_concat([s FOR s IN generate_series(0, greatest(0, w - 512), 460) IF s < greatest(0, w - 512)], [greatest(0, w - 512)]))) AS tx),
 LATERAL (SELECT unnest(list_distinct(list_concat([s FOR s IN generate_series(0, greatest(0, h - 512), 460) IF s < greatest(0, h - 512)], [greatest(0, h - 512)]))) AS ty)""")
def tile_grid(spark, d):
    sizes = spark.read.parquet(f"{d}/part.parquet").selectExpr("CAST(600 + p_size * 40 AS INT) AS width", "CAST(400 + p_size * 20 AS INT) AS height").distinct()
    return frames.tiles(sizes, 512, 0.1).selectExpr("width", "height", "CAST(tile_x AS BIGINT) AS tile_x", "CAST(tile_y AS BIGINT) AS tile_y")


@query("track_color_names", "SELECT track_id, (SELECT name FROM (VALUES " + ", ".join(f"('{n}', {c[0]}, {c[1]}, {c[2]})" for n, c in PALETTE.items()) + ") p(name, pb, pg, pr) ORDER BY (b - pb) * (b - pb) + (g - pg) * (g - pg) + (r - pr) * (r - pr), name LIMIT 1) AS color FROM col", "col")
def track_color_names(spark, d):
    return frames.nearest_color(views.colors(spark, d), PALETTE).select("track_id", "color")


@query("non_maximum_suppression")
def non_maximum_suppression(spark, d):
    return frames.suppressed(views.detections(spark, d), CLIP, ["l_partkey", "l_linenumber"], 0.3).select("clip_id", "source_frame", "class_name", "l_partkey", "l_linenumber", "confidence")


@query("box_overlaps", """SELECT a.clip_id, a.source_frame, a.l_partkey AS person_key, a.l_linenumber AS person_line, b.l_partkey AS ball_key, b.l_linenumber AS ball_line, round(o / u, 6) AS iou, round(o / s, 6) AS of_smaller, round(sqrt(pow(greatest(a.x1 - bx, 0, bx - a.x2), 2) + pow(greatest(a.y1 - y_, 0, y_ - a.y2), 2)) / greatest(1.0, a.y2 - a.y1), 6) AS box_distance
 FROM det a JOIN det b ON a.clip_id = b.clip_id AND a.source_frame = b.source_frame AND a.class_name = 'person' AND b.class_name = 'sports ball',
 LATERAL (SELECT greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS o, (b.x1 + b.x2) / 2 AS bx, (b.y1 + b.y2) / 2 AS y_), LATERAL (SELECT (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - o AS u, least((a.x2 - a.x1) * (a.y2 - a.y1), (b.x2 - b.x1) * (b.y2 - b.y1)) AS s)""", "det")
def box_overlaps(spark, d):
    boxes = views.detections(spark, d)
    sides = [boxes.where(f"class_name = '{c}'").select("clip_id", "source_frame", F.col("l_partkey").alias(f"{n}_key"), F.col("l_linenumber").alias(f"{n}_line"), *[F.col(x).alias(f"{n[0]}{x}") for x in ("x1", "y1", "x2", "y2")]) for c, n in (("person", "person"), ("sports ball", "ball"))]
    pairs = sides[0].join(sides[1], ["clip_id", "source_frame"])
    a, b = g.box("p"), g.box("b")
    told = {"iou": F.round(g.iou(a, b), 6), "of_smaller": F.round(g.overlap_of_smaller(a, b), 6), "box_distance": F.round(g.box_distance(*g.center(b), a), 6)}
    return pairs.select("clip_id", "source_frame", "person_key", "person_line", "ball_key", "ball_line", *[c.alias(n) for n, c in told.items()])


@query("nearest_player", """, q AS (SELECT b.clip_id, b.source_frame, b.l_partkey AS ball_key, b.l_linenumber AS ball_line, p.l_partkey AS player_key, p.l_linenumber AS player_line,
 round(sqrt(pow((b.x1 + b.x2) / 2 - (p.x1 + p.x2) / 2, 2) + pow((b.y1 + b.y2) / 2 - p.y2, 2)) / greatest(1.0, p.y2 - p.y1), 6) AS ratio
 FROM det b JOIN det p ON b.clip_id = p.clip_id AND b.source_frame = p.source_frame WHERE b.class_name = 'sports ball' AND p.class_name = 'person')
SELECT clip_id, source_frame, ball_key, ball_line, ratio, player_key, player_line FROM q WHERE ratio <= 3 QUALIFY row_number() OVER (PARTITION BY clip_id, source_frame, ball_key, ball_line ORDER BY ratio, player_key, player_line) = 1""", "det")
def nearest_player(spark, d):
    return joins.nearest_player(views.detections(spark, d), CLIP, 3.0)


def split_events(spark, d):
    p = views.path(spark, d)
    manual = p.where("event_type IN ('click', 'view')").select("clip_id", F.col("source_frame").alias("manual_frame"), "clip_seconds", "team")
    predicted = p.where("event_type IN ('purchase', 'signup')").select("clip_id", F.col("source_frame").alias("predicted_frame"), F.col("clip_seconds").alias("other_seconds"), F.col("team").alias("other_team"))
    return manual, predicted


M_P = "m AS (SELECT clip_id, source_frame AS manual_frame, clip_seconds, team FROM pth WHERE event_type IN ('click', 'view')), p AS (SELECT clip_id, source_frame AS predicted_frame, clip_seconds AS other_seconds, team AS other_team FROM pth WHERE event_type IN ('purchase', 'signup'))"
views.SQL["mp"] = M_P


@query("time_band_pairs", "SELECT m.clip_id, m.manual_frame, p.predicted_frame FROM m JOIN p ON m.clip_id = p.clip_id AND abs(m.clip_seconds - p.other_seconds) <= 0.25", "pth", "mp")
def time_band_pairs(spark, d):
    a, b = split_events(spark, d)
    return joins.within_band(a, b, CLIP, "clip_seconds", "other_seconds", 0.25).select("clip_id", "manual_frame", "predicted_frame")


@query("last_event_before", """SELECT m.clip_id, m.manual_frame, CASE WHEN m.clip_seconds - p.other_seconds <= 2 THEN p.predicted_frame END AS predicted_frame
 FROM m ASOF LEFT JOIN p ON m.clip_id = p.clip_id AND m.clip_seconds >= p.other_seconds""", "pth", "mp")
def last_event_before(spark, d):
    a, b = split_events(spark, d)
    return joins.as_of(a, b, CLIP, "clip_seconds", "other_seconds", ["predicted_frame"], within=2.0).select("clip_id", "manual_frame", "predicted_frame")


@query("first_event_after", """SELECT m.clip_id, m.manual_frame, CASE WHEN p.other_seconds - m.clip_seconds <= 2 THEN p.predicted_frame END AS predicted_frame
 FROM m ASOF LEFT JOIN p ON m.clip_id = p.clip_id AND m.clip_seconds <= p.other_seconds""", "pth", "mp")
def first_event_after(spark, d):
    a, b = split_events(spark, d)
    return joins.as_of(a, b, CLIP, "clip_seconds", "other_seconds", ["predicted_frame"], forward=True, within=2.0).select("clip_id", "manual_frame", "predicted_frame")


for _name, _not in (("confirmed_events", ""), ("vetoed_events", "NOT ")):

    @query(_name, f"SELECT clip_id, manual_frame FROM m WHERE {_not}EXISTS (SELECT 1 FROM p WHERE p.clip_id = m.clip_id AND p.other_seconds > m.clip_seconds AND p.other_seconds - m.clip_seconds <= 0.2)", "pth", "mp")
    def _exists(spark, d, negate=bool(_not)):
        a, b = split_events(spark, d)
        return joins.exists_within(a, b, CLIP, "clip_seconds", "other_seconds", 0.2, negate).select("clip_id", "manual_frame")


@query("covisible_tracks", "SELECT first_track, second_track, count(*) AS frames FROM (SELECT DISTINCT a.l_suppkey % 40 AS first_track, b.l_suppkey % 40 AS second_track, a.clip_id, a.source_frame FROM det a JOIN det b ON a.clip_id = b.clip_id AND a.source_frame = b.source_frame AND a.l_suppkey % 40 < b.l_suppkey % 40) GROUP BY ALL", "det")
def covisible_tracks(spark, d):
    points = views.detections(spark, d).select(F.lit(0).alias("all"), "clip_id", "source_frame", (F.col("l_suppkey") % 40).alias("track_id"))
    return joins.covisible_pairs(points, CLIP).groupBy("first_track", "second_track").agg(F.sum("frames").alias("frames"))


@query("path_changes", """SELECT clip_id, source_frame, CASE WHEN a.x IS NULL THEN 'GAINED' WHEN b.x IS NULL THEN 'MISSING' WHEN sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) > 30 THEN 'MOVED' WHEN a.src <> b.src THEN 'PROVENANCE' ELSE 'MATCH' END AS status
 FROM (SELECT clip_id, source_frame, x, y, event_type AS src FROM pth) a FULL JOIN (SELECT clip_id, source_frame, avg((x1 + x2) / 2) AS x, avg(y2) AS y, CASE WHEN max(confidence) >= 0.5 THEN 'click' ELSE 'view' END AS src FROM det WHERE class_name = 'sports ball' GROUP BY ALL) b USING (clip_id, source_frame)""", "pth", "det")
def path_changes(spark, d):
    """The path against the mean ball box of each frame."""
    x, y = g.foot(g.box())
    found = views.detections(spark, d).where("class_name = 'sports ball'").groupBy("clip_id", "source_frame").agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.when(F.max("confidence") >= 0.5, "click").otherwise("view").alias("source"))
    return joins.compared(views.path(spark, d).withColumn("source", F.col("event_type")), found, ["clip_id", "source_frame"], 30.0).select("clip_id", "source_frame", "status")


@query("greedy_event_matches")
def greedy_event_matches(spark, d):
    a, b = split_events(spark, d)
    pairs = joins.within_band(a, b, CLIP, "clip_seconds", "other_seconds", 0.25).withColumn("difference", F.round(F.abs(F.col("clip_seconds") - F.col("other_seconds")), 6))
    return joins.greedy_matches(pairs.select("clip_id", "manual_frame", "predicted_frame", "difference"), CLIP, "manual_frame", "predicted_frame", "difference")


@query("event_comparison")
def event_comparison(spark, d):
    p = views.path(spark, d).select("clip_id", F.col("source_frame").alias("event_no"), F.col("clip_seconds").alias("seconds"), "team", "event_type")
    kind = F.when(F.col("event_type").isin("click", "purchase"), "completed_pass").otherwise("turnover")
    manual, predicted = (p.where(F.col("event_type").isin(*k)).withColumn("event_type", kind) for k in (("click", "view"), ("purchase", "signup")))
    return reports.event_comparison(manual, predicted, CLIP, 1.0, 3.0, ["red", "black"], ["completed_pass", "turnover"])


@query("detection_summary", """, c AS (SELECT clip_id, max(source_frame) + 1 AS frame_count FROM pth GROUP BY 1)
SELECT clip_id, count(*) AS frames, sum(p)::BIGINT AS persons, sum(b)::BIGINT AS balls, count(*) FILTER (p > 0) AS frames_with_person, count(*) FILTER (b > 0) AS frames_with_ball, round((count(*) FILTER (b > 0)) / count(*), 6) AS ball_coverage, CAST(ceil(any_value(frame_count) / 2) AS BIGINT) AS expected_frames, count(*) >= ceil(any_value(frame_count) / 2) AS complete
 FROM (SELECT clip_id, source_frame, count(*) FILTER (class_name = 'person') AS p, count(*) FILTER (class_name = 'sports ball') AS b FROM det GROUP BY ALL) JOIN c USING (clip_id) GROUP BY clip_id""", "det", "pth")
def detection_summary(spark, d):
    clips = views.path(spark, d).groupBy("clip_id").agg((F.max("source_frame") + 1).alias("frame_count"))
    return blocks.detection_summary(views.detections(spark, d), clips, CLIP, 2)


@query("micro_average", """SELECT lang, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, round(coalesce(sum(tp) / nullif(sum(tp) + sum(fp), 0), 0), 6) AS precision, round(coalesce(sum(tp) / nullif(sum(tp) + sum(fn), 0), 0), 6) AS recall
 FROM (SELECT lang, quality * toxic AS tp, quality * (1 - toxic) AS fp, (1 - quality) * toxic AS fn FROM labels JOIN documents USING (doc_id)) GROUP BY ROLLUP (lang)""")
def micro_average(spark, d):
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    parts = labels.join(docs.select("doc_id", "lang"), "doc_id").selectExpr("lang", "CAST(quality * toxic AS BIGINT) AS tp", "CAST(quality * (1 - toxic) AS BIGINT) AS fp", "CAST((1 - quality) * toxic AS BIGINT) AS fn")
    return blocks.micro_average(parts, ["lang"])


@query("error_bands", """SELECT band, coalesce(n, 0) AS n FROM (VALUES ('to_50'), ('to_100'), ('to_250'), ('above'), ('not_visible')) b(band) LEFT JOIN
 (SELECT CASE WHEN e IS NULL THEN 'not_visible' WHEN e <= 50 THEN 'to_50' WHEN e <= 100 THEN 'to_100' WHEN e <= 250 THEN 'to_250' ELSE 'above' END AS band, count(*) AS n FROM (SELECT CASE WHEN event_type <> 'view' THEN x END AS e FROM pth) GROUP BY 1) USING (band)""", "pth")
def error_bands(spark, d):
    return blocks.error_bands(views.path(spark, d).select(F.when(F.col("event_type") != "view", F.col("x")).alias("e")), "e", (50, 100, 250))


@query("possession_share", """SELECT clip_id, block, team, n AS controlled_samples, round(100 * n / sum(n) OVER (PARTITION BY clip_id, block), 1) AS possession_percent
 FROM (SELECT clip_id, CAST(floor(clip_seconds / 5) AS BIGINT) AS block, team, count(*) AS n FROM pth GROUP BY ALL)""", "pth")
def possession_share(spark, d):
    return blocks.possession_share(views.path(spark, d), CLIP, 5.0)


SPELLS = """sp0 AS (SELECT *, CASE WHEN lag(team) OVER w = team AND lag(track_id) OVER w = track_id AND clip_seconds - lag(clip_seconds) OVER w <= 0.64 THEN 0 ELSE 1 END AS new FROM pth WINDOW w AS (PARTITION BY clip_id ORDER BY source_frame)),
 sp1 AS (SELECT *, CAST(sum(new) OVER (PARTITION BY clip_id ORDER BY source_frame) AS BIGINT) AS spell_no FROM sp0),
 sp AS (SELECT clip_id, spell_no, team, track_id, min(clip_seconds) AS start_seconds, max(clip_seconds) AS end_seconds, count(*) AS observations, arg_min(x, source_frame) AS start_x, arg_max(x, source_frame) AS end_x FROM sp1 GROUP BY ALL),
 tr AS (SELECT clip_id, CASE WHEN to_team = team THEN 'pass_candidate' ELSE 'turnover_candidate' END AS event_type, end_seconds AS clip_seconds, team, track_id AS from_track, to_track, to_start AS completion_seconds
  FROM (SELECT *, lead(track_id) OVER w AS to_track, lead(team) OVER w AS to_team, lead(start_seconds) OVER w AS to_start FROM sp WINDOW w AS (PARTITION BY clip_id ORDER BY spell_no)) WHERE to_track <> track_id AND to_start - end_seconds BETWEEN 0 AND 3)"""
views.SQL["spells"] = SPELLS


@query("possession_spells", "SELECT clip_id, spell_no, team, track_id, start_seconds, end_seconds, observations, round(start_x, 6) AS start_x, round(end_x, 6) AS end_x FROM sp", "pth", "spells")
def possession_spells(spark, d):
    return tracks.spells(views.path(spark, d), CLIP, 0.64).withColumns(r6("start_x", "end_x"))


def spell_events(spark, d):
    return tracks.transfers(tracks.spells(views.path(spark, d), CLIP, 0.64), CLIP, 3.0)


@query("spell_transfers", "SELECT * FROM tr", "pth", "spells")
def spell_transfers(spark, d):
    return spell_events(spark, d)


@query("event_counts_by_block", """SELECT clip_id, CAST(floor(coalesce(nullif(completion_seconds, 0), clip_seconds) / 5) AS BIGINT) AS block, team, count(*) FILTER (event_type = 'pass_candidate') AS pass_candidates, count(*) FILTER (event_type = 'turnover_candidate') AS turnovers_lost FROM tr GROUP BY ALL""", "pth", "spells")
def event_counts_by_block(spark, d):
    return blocks.event_counts(spell_events(spark, d), CLIP, 5.0)


@query("pilot_blocks", """, g AS (SELECT clip_id, unnest(generate_series(0, CAST(floor(greatest(max(clip_seconds), (SELECT max(t.clip_seconds) FROM tr t WHERE t.clip_id = pth.clip_id)) / 5) AS BIGINT))) AS block FROM pth GROUP BY clip_id),
 s AS (SELECT clip_id, CAST(floor(clip_seconds / 5) AS BIGINT) AS block, team, count(*) AS n FROM pth GROUP BY ALL),
 e AS (SELECT clip_id, CAST(floor(coalesce(nullif(completion_seconds, 0), clip_seconds) / 5) AS BIGINT) AS block, team, count(*) FILTER (event_type = 'pass_candidate') AS a, count(*) FILTER (event_type = 'turnover_candidate') AS b FROM tr GROUP BY ALL)
SELECT g.clip_id, g.block, k.team, coalesce(k.n, 0) AS controlled_samples, coalesce(round(100 * k.n / sum(k.n) OVER (PARTITION BY g.clip_id, g.block), 1), 0) AS possession_percent, coalesce(k.a, 0) AS pass_candidates, coalesce(k.b, 0) AS turnovers_lost, g.block * 5.0::DOUBLE AS start_seconds
 FROM g LEFT JOIN (SELECT * FROM s FULL JOIN e USING (clip_id, block, team)) k USING (clip_id, block)""", "pth", "spells")
def pilot_blocks(spark, d):
    return blocks.block_report(views.path(spark, d), spell_events(spark, d), CLIP, 5.0)


@query("player_block_metrics", """SELECT clip_id, block, track_id, round(coalesce(sum(m) FILTER (ok), 0), 2) AS distance_metres, round(coalesce(max(m / dt) FILTER (ok), 0), 2) AS maximum_speed, count(*) AS sample_count FROM (
 SELECT *, dt > 0 AND dt <= 2 AS ok FROM (SELECT clip_id, CAST(floor(clip_seconds / 5) AS BIGINT) AS block, track_id, clip_seconds - lag(clip_seconds) OVER w AS dt, sqrt(pow(x_metres - lag(x_metres) OVER w, 2) + pow(y_metres - lag(y_metres) OVER w, 2)) AS m
 FROM pp WINDOW w AS (PARTITION BY clip_id, track_id, CAST(floor(clip_seconds / 5) AS BIGINT) ORDER BY clip_seconds))) GROUP BY ALL""", "pth", "pm")
def player_block_metrics(spark, d):
    return blocks.player_metrics(on_pitch(spark, d), CLIP, 5.0, 2.0)


@query("team_heatmap", """, c AS (SELECT clip_id, CAST(floor(clip_seconds / 10) AS BIGINT) AS block, team, CAST(least(3, floor(y_metres / 68 * 4)) AS INT) AS row, CAST(least(5, floor(x_metres / 105 * 6)) AS INT) AS col, count(*) AS n FROM pp GROUP BY ALL),
 g AS (SELECT * FROM (SELECT DISTINCT clip_id, block, team FROM c), (SELECT CAST(unnest(generate_series(0, 3)) AS INT) AS row), (SELECT CAST(unnest(generate_series(0, 5)) AS INT) AS col))
SELECT clip_id, block, team, row, col AS "column", coalesce(n, 0) AS n FROM g LEFT JOIN c USING (clip_id, block, team, row, col)""", "pth", "pm")
def team_heatmap(spark, d):
    return blocks.heatmap(on_pitch(spark, d), CLIP, 10.0, *PITCH, 6, 4)


@query("static_cells", """SELECT clip_id, cell_x, cell_y, n, frames FROM (SELECT clip_id, round_even(x / 40, 0) AS cell_x, round_even(y / 400, 0) AS cell_y, count(DISTINCT source_frame) AS n FROM (SELECT clip_id, source_frame, x, y / 1 AS y FROM pth) GROUP BY ALL) JOIN (SELECT clip_id, count(DISTINCT source_frame) AS frames FROM pth GROUP BY 1) USING (clip_id) WHERE n >= 0.01 * frames""", "pth")
def static_cells(spark, d):
    return blocks.static_cells(views.path(spark, d).withColumn("y", F.col("y") / 10), CLIP, 40.0, 0.01)


@query("track_quality", """SELECT clip_id, track_id, count(*) AS points, min(source_frame) AS first_frame, max(source_frame) AS last_frame, max(clip_seconds) - min(clip_seconds) AS duration_seconds, floor(avg(c) * sqrt(count(*)) * 1e6 + 0.5) / 1e6 AS quality, floor(avg(c) * 1e6 + 0.5) / 1e6 AS mean_confidence
 FROM (SELECT *, floor(control_ratio * 64) / 64 AS c FROM pth) GROUP BY ALL HAVING avg(c) >= 0.1""", "pth")
def track_quality(spark, d):
    return blocks.track_quality(views.path(spark, d).withColumn("confidence", F.floor(F.col("control_ratio") * 64) / 64.0), CLIP, 0.1)


@query("median_colors", "SELECT label, median(b) AS median_b, median(g) AS median_g, median(r) AS median_r, count(*) AS samples FROM col GROUP BY label", "col")
def median_colors(spark, d):
    return blocks.median_colors(views.colors(spark, d), ["label"])


@query("zero_filled_counts", "SELECT team, event_type, coalesce(n, 0) AS n FROM (VALUES ('red'), ('black'), ('blue')) t(team) CROSS JOIN (VALUES ('pass_candidate'), ('turnover_candidate'), ('shot_candidate')) k(event_type) LEFT JOIN (SELECT team, event_type, count(*) AS n FROM tr GROUP BY ALL) USING (team, event_type)", "pth", "spells")
def zero_filled_counts(spark, d):
    return blocks.zero_filled(spell_events(spark, d), ["red", "black", "blue"], ["pass_candidate", "turnover_candidate", "shot_candidate"])


@query("set_fingerprint", "SELECT clip_id, CAST(sum(('0x' || substr(sha256(event_type || '|' || source_frame || '|' || track_id), 1, 13))::BIGINT) AS VARCHAR) AS fingerprint, count(*) AS n FROM pth GROUP BY clip_id", "pth")
def set_fingerprint(spark, d):
    return blocks.fingerprint(views.path(spark, d), CLIP, ["source_frame", "track_id", "event_type"])


@query("track_steps", """SELECT clip_id, track_id, source_frame, round(step, 6) AS step, round(CASE WHEN dt > 0 AND dt <= 2 THEN step / dt END, 4) AS speed FROM (SELECT *, clip_seconds - lag(clip_seconds) OVER w AS dt,
 sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS step FROM pth WINDOW w AS (PARTITION BY clip_id, track_id ORDER BY source_frame))""", "pth")
def track_steps(spark, d):
    return tracks.steps(views.path(spark, d), TRACK, 2.0).select("clip_id", "track_id", "source_frame", F.round("step", 6).alias("step"), F.round("speed", 4).alias("speed"))


@query("motion_evidence", """SELECT clip_id, track_id, source_frame, round(greatest(il / it, ol / ot), 4) AS motion_speed, round((ix * ox + iy * oy) / (il * ol), 6) AS turn_cosine FROM (SELECT *, sqrt(ix * ix + iy * iy) AS il, sqrt(ox * ox + oy * oy) AS ol FROM (
 SELECT *, x - lag(x) OVER w AS ix, y - lag(y) OVER w AS iy, clip_seconds - lag(clip_seconds) OVER w AS it, lead(x) OVER w - x AS ox, lead(y) OVER w - y AS oy, lead(clip_seconds) OVER w - clip_seconds AS ot FROM pth WINDOW w AS (PARTITION BY clip_id, track_id ORDER BY source_frame)))
 WHERE it > 0 AND ot > 0 AND il > 0 AND ol > 0""", "pth")
def motion_evidence(spark, d):
    return tracks.motion(views.path(spark, d), TRACK).select("clip_id", "track_id", "source_frame", F.round("motion_speed", 4).alias("motion_speed"), F.round("turn_cosine", 6).alias("turn_cosine"))


@query("control_islands", """SELECT clip_id, island, min(source_frame) AS start_frame, max(source_frame) AS end_frame, min(clip_seconds) AS start_seconds, max(clip_seconds) AS end_seconds, count(*) AS points FROM (SELECT *, CAST(sum(CASE WHEN i AND NOT coalesce(b, false) THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY source_frame) AS BIGINT) AS island
 FROM (SELECT *, control_ratio <= 0.5 AS i, lag(control_ratio <= 0.5) OVER (PARTITION BY clip_id ORDER BY source_frame) AS b FROM pth)) WHERE i GROUP BY clip_id, island""", "pth")
def control_islands(spark, d):
    return tracks.islands(views.path(spark, d), CLIP, F.col("control_ratio") <= 0.5)


@query("gap_interpolation", """SELECT clip_id, track_id, f AS source_frame, round(clip_seconds + (f - source_frame) / 25, 3) AS clip_seconds, round(x + (nx - x) * ((f - source_frame) / (nf - source_frame)), 6) AS x, round(y + (ny - y) * ((f - source_frame) / (nf - source_frame)), 6) AS y, round(least(c, nc) * 0.75, 6) AS confidence FROM (SELECT *, unnest(generate_series(source_frame + 5, nf - 1, 5)) AS f FROM (
 SELECT *, control_ratio AS c, lead(control_ratio) OVER w AS nc, lead(source_frame) OVER w AS nf, lead(clip_seconds) OVER w AS nt, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lag(x) OVER w AS lx, lag(y) OVER w AS ly FROM pth WINDOW w AS (PARTITION BY clip_id, track_id ORDER BY source_frame)) WHERE nf - source_frame > 5 AND nt - clip_seconds <= 1.6 + 1e-6 AND (lx IS NULL OR (x - lx) * (nx - x) + (y - ly) * (ny - y) > 0))""", "pth")
def gap_interpolation(spark, d):
    return tracks.interpolated(views.path(spark, d).withColumn("confidence", F.col("control_ratio")), TRACK, 5, 25.0, 1.6).withColumns(r6("x", "y"))


@query("debounced_releases")
def debounced_releases(spark, d):
    fast = tracks.steps(views.path(spark, d), CLIP, 0.24).where("speed >= 20000").withColumn("speed", F.round("speed", 4))
    return tracks.debounced(fast.select("clip_id", "clip_seconds", "speed"), CLIP, 1.0)


@query("coalesced_stoppages")
def coalesced_stoppages(spark, d):
    return tracks.coalesced(tracks.boundary_intervals(views.path(spark, d), CLIP, POLYGON, 5.0, 0.0), CLIP, 0.2)


@query("points_in_stoppages", f"""SELECT c.clip_id, count(*) AS n, sum(p.track_id)::BIGINT AS keys FROM (SELECT clip_id, block * 4.0 AS s, block * 4.0 + 1.5 AS e FROM (SELECT DISTINCT clip_id, CAST(floor(clip_seconds / 4) AS BIGINT) AS block FROM pth)) c JOIN pth p ON p.clip_id = c.clip_id AND p.clip_seconds >= s AND p.clip_seconds < e GROUP BY c.clip_id""", "pth")
def points_in_stoppages(spark, d):
    p = views.path(spark, d)
    stops = p.select("clip_id", F.floor(F.col("clip_seconds") / 4).alias("block")).distinct().select("clip_id", (F.col("block") * 4.0).alias("start"), (F.col("block") * 4.0 + 1.5).alias("end"))
    return joins.in_interval(p, stops, CLIP, "clip_seconds", "start", "end", 2.0).groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"), F.sum("track_id").alias("keys"))


@query("control_changes", "SELECT clip_id, source_frame, track_id, previous_track FROM (SELECT *, lag(track_id) OVER (PARTITION BY clip_id ORDER BY source_frame) AS previous_track FROM pth) WHERE previous_track IS NULL OR previous_track <> track_id", "pth")
def control_changes(spark, d):
    return tracks.control_changes(views.path(spark, d), CLIP).select("clip_id", "source_frame", "track_id", "previous_track")


@query("best_ball_per_frame", "SELECT clip_id, source_frame, l_partkey, l_suppkey, confidence FROM det WHERE class_name = 'sports ball' QUALIFY row_number() OVER (PARTITION BY clip_id, source_frame ORDER BY confidence DESC, l_partkey, l_suppkey) = 1", "det")
def best_ball_per_frame(spark, d):
    balls = views.detections(spark, d).where("class_name = 'sports ball'")
    return reports.top(balls, ["clip_id", "source_frame"], [F.desc("confidence"), F.asc("l_partkey"), F.asc("l_suppkey")], 1).select("clip_id", "source_frame", "l_partkey", "l_suppkey", "confidence")


@query("longest_tracks", "SELECT clip_id, track_id, n FROM (SELECT clip_id, track_id, count(*) AS n FROM pth GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY n DESC, track_id) <= 5", "pth")
def longest_tracks(spark, d):
    sizes = views.path(spark, d).groupBy(*TRACK).agg(F.count(F.lit(1)).alias("n"))
    return reports.top(sizes, CLIP, [F.desc("n"), F.asc("track_id")], 5).drop("rank")


@query("result_differences", """SELECT clip_id, source_frame, CASE WHEN sum(n) > 0 THEN 'missing' ELSE 'unexpected' END AS side, abs(sum(n))::BIGINT AS n FROM (SELECT clip_id, source_frame, 1 AS n FROM pth UNION ALL SELECT clip_id, source_frame, -1 FROM det WHERE class_name = 'sports ball') GROUP BY ALL HAVING sum(n) <> 0""", "pth", "det")
def result_differences(spark, d):
    """Frames of the path against those with a ball box."""
    found = views.detections(spark, d).where("class_name = 'sports ball'").select("clip_id", "source_frame")
    return reports.differences(views.path(spark, d).select("clip_id", "source_frame"), found)


@query("event_keys", "SELECT DISTINCT clip_id, event_type || ':' || printf('%.3f', clip_seconds) || ':' || team || ':' || from_track || ':' || to_track AS event_key FROM tr", "pth", "spells")
def event_keys(spark, d):
    return spell_events(spark, d).select("clip_id", reports.event_key().alias("event_key")).distinct()


@query("revision_numbers", "SELECT workflow_id, segment_id, stream, event_key, ordinal, row_number() OVER (PARTITION BY workflow_id, segment_id, stream, event_key ORDER BY ordinal) AS revision FROM his", "his")
def revision_numbers(spark, d):
    return reports.revisions(views.history(spark, d), ["workflow_id", "segment_id", "stream", "event_key"], "ordinal").select("workflow_id", "segment_id", "stream", "event_key", "ordinal", "revision")


@query("latest_revisions", "SELECT workflow_id, segment_id, stream, event_key, count(*) AS revisions, max(ordinal) AS ordinal, arg_max(payload_chars, ordinal) AS payload_chars FROM his GROUP BY ALL", "his")
def latest_revisions(spark, d):
    return reports.latest(views.history(spark, d), ["workflow_id", "segment_id", "stream", "event_key"], "ordinal", ["ordinal", "payload_chars"])


@query("claimable_jobs", "SELECT workflow_id, job_id, priority_rank, row_number() OVER (PARTITION BY workflow_id ORDER BY priority_rank, created_at, job_id) AS rank FROM job WHERE status = 'O' QUALIFY rank <= 10", "job")
def claimable_jobs(spark, d):
    return reports.claimable(views.jobs(spark, d), ["workflow_id"], 10).select("workflow_id", "job_id", "priority_rank", "rank")


@query("job_status_counts", "SELECT workflow_id, count(*) FILTER (status = 'O') AS n_o, count(*) FILTER (status = 'F') AS n_f, count(*) FILTER (status = 'P') AS n_p FROM job GROUP BY ALL", "job")
def job_status_counts(spark, d):
    return reports.status_counts(views.jobs(spark, d), ["workflow_id"], ["O", "F", "P"])


@query("replay_windows", """SELECT clip_id, i AS index, i * 4.0::DOUBLE AS window_start, least(duration, i * 4.0 + 5) AS window_end FROM (SELECT clip_id, max(clip_seconds) AS duration FROM pth GROUP BY 1), LATERAL (SELECT unnest(generate_series(0, greatest(0, CAST(ceil((duration - 5) / 4) AS BIGINT)))) AS i)""", "pth")
def replay_windows(spark, d):
    clips = views.path(spark, d).groupBy("clip_id").agg(F.max("clip_seconds").alias("duration"))
    return windows.replay_windows(clips, 5.0, 1.0).select("clip_id", "index", "window_start", "window_end")


views.SQL["asg"] = """du AS (SELECT clip_id, max(clip_seconds) AS duration FROM pth GROUP BY 1), mw AS (SELECT *, greatest(0, CAST(ceil((duration - 5) / 4) AS BIGINT)) AS lst FROM du),
 asg AS (SELECT tr.*, event_type || ':' || printf('%.3f', clip_seconds) || ':' || team || ':' || from_track || ':' || to_track AS event_key, unnest(generate_series(least(lst, greatest(0, CAST(floor((clip_seconds - 5) / 4) AS BIGINT) + 1)), least(lst, CAST(floor(clip_seconds / 4) AS BIGINT)))) AS i FROM tr JOIN mw USING (clip_id))"""


def clip_durations(spark, d):
    return views.path(spark, d).groupBy("clip_id").agg(F.max("clip_seconds").alias("duration"))


@query("replay_duplicates", "SELECT clip_id, i AS index, count(*) FILTER (k = 1) AS new_events, count(*) FILTER (k > 1) AS duplicates FROM (SELECT *, row_number() OVER (PARTITION BY clip_id, event_key ORDER BY i) AS k FROM asg) GROUP BY ALL", "pth", "spells", "asg")
def replay_duplicates(spark, d):
    events = spell_events(spark, d).withColumn("event_key", reports.event_key())
    return windows.deduplicated(events, clip_durations(spark, d), CLIP, "event_key", 5.0, 1.0)


@query("replay_progress", """, f AS (SELECT clip_id, event_key, event_type, min(i) AS i FROM asg GROUP BY ALL), w AS (SELECT clip_id, duration, lst, unnest(generate_series(0, lst)) AS i FROM mw)
SELECT clip_id, i AS index, round(CASE WHEN least(duration, i * 4.0::DOUBLE + 5) >= duration THEN duration ELSE greatest(0, i * 4.0::DOUBLE + 4) END, 3) AS finalised_through, (SELECT count(*) FROM f WHERE f.clip_id = w.clip_id AND f.i <= w.i AND event_type = 'pass_candidate') AS pass_candidate, (SELECT count(*) FROM f WHERE f.clip_id = w.clip_id AND f.i <= w.i AND event_type = 'turnover_candidate') AS turnover_candidate FROM w""", "pth", "spells", "asg")
def replay_progress(spark, d):
    events = spell_events(spark, d).withColumn("event_key", reports.event_key())
    return windows.progress(events, clip_durations(spark, d), CLIP, "event_key", ["pass_candidate", "turnover_candidate"], 5.0, 1.0)


@query("worker_backlog", """, j AS (SELECT o_custkey AS workflow_id, o_orderkey AS job_id, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS arrival, coalesce(n, 0) AS service FROM orders LEFT JOIN (SELECT l_orderkey, 8 * count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)
SELECT workflow_id, job_id, (s + max(arrival - (s - service)) OVER w)::BIGINT AS finish, (s + max(arrival - (s - service)) OVER w - service - arrival)::BIGINT AS wait FROM (SELECT *, sum(service) OVER (PARTITION BY workflow_id ORDER BY arrival, job_id) AS s FROM j) WINDOW w AS (PARTITION BY workflow_id ORDER BY arrival, job_id)""", "job")
def worker_backlog(spark, d):
    """Each customer's orders as jobs of one worker: they arrive on their day and take eight days an item."""
    items = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("job_id")).agg((8 * F.count(F.lit(1))).alias("service"))
    jobs = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("workflow_id"), F.col("o_orderkey").alias("job_id"), F.datediff("o_orderdate", F.lit("1990-01-01")).cast("long").alias("arrival"))
    chunks = jobs.join(items, "job_id", "left").fillna(0, ["service"]).withColumn("index", F.struct("arrival", "job_id"))
    return windows.backlog(chunks, ["workflow_id"]).select("workflow_id", "job_id", "finish", "wait")


@query("motion_states", """SELECT clip_id, track_id, source_frame, samples, CASE WHEN v IS NULL THEN 'unknown' WHEN v < 3 THEN 'stationary' WHEN v < 12 THEN 'walking' ELSE 'running' END AS motion_state FROM (
 SELECT clip_id, track_id, source_frame, count(*) OVER w AS samples, CASE WHEN clip_seconds > first(clip_seconds) OVER w THEN sqrt(pow(x - first(x) OVER w, 2) + pow(y - first(y) OVER w, 2)) / (clip_seconds - first(clip_seconds) OVER w) / ((h + first(h) OVER w) / 2) END AS v
 FROM (SELECT *, 40.0::DOUBLE + source_frame % 5 AS h FROM pth) WINDOW w AS (PARTITION BY clip_id, track_id ORDER BY CAST(round(clip_seconds * 1000) AS BIGINT) RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW))""", "pth")
def motion_states(spark, d):
    p = views.path(spark, d).withColumn("height", F.lit(40.0) + F.col("source_frame") % 5)
    return evidence.motion_state(p, TRACK, 1.0, 3.0, 12.0).select("clip_id", "track_id", "source_frame", "samples", "motion_state")


STEPS = "st AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS step, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) / (clip_seconds - lag(clip_seconds) OVER w) AS speed FROM pth WINDOW w AS (PARTITION BY clip_id, track_id ORDER BY source_frame))"
views.SQL["steps"] = STEPS


@query("sustained_motion", "SELECT clip_id, track_id, source_frame FROM (SELECT *, count(*) FILTER (speed >= 2000) OVER (PARTITION BY clip_id, track_id ORDER BY source_frame ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS k FROM st) WHERE k >= 2", "pth", "steps")
def sustained_motion(spark, d):
    return evidence.sustained(views.path(spark, d), TRACK, 2000.0).select("clip_id", "track_id", "source_frame")


@query("arrests", "SELECT clip_id, count(*) FILTER (speed <= 0.1 * peak) AS arrests, count(peak) AS steps FROM (SELECT *, max(speed) OVER (PARTITION BY clip_id, track_id ORDER BY CAST(round(clip_seconds * 1000) AS BIGINT) RANGE BETWEEN 2000 PRECEDING AND CURRENT ROW) AS peak FROM st) GROUP BY clip_id", "pth", "steps")
def arrests(spark, d):
    return evidence.peaks(views.path(spark, d), TRACK, 2.0, 0.1).groupBy("clip_id").agg(F.count_if("arrest").alias("arrests"), F.count("peak").alias("steps"))


@query("approaching_tracks", "SELECT clip_id, track_id, coalesce(bool_and(r - p <= 1000), true) AS monotone, count(*) AS points FROM (SELECT *, lag(r) OVER (PARTITION BY clip_id, track_id ORDER BY source_frame) AS p FROM (SELECT *, sqrt(pow(x - 200, 2) + pow(y - 300, 2)) AS r FROM pth)) GROUP BY ALL", "pth")
def approaching_tracks(spark, d):
    return evidence.approaching(views.path(spark, d), TRACK, 200.0, 300.0, 1000.0)


@query("long_tracks", "SELECT clip_id, track_id, count(*) AS n FROM pth GROUP BY ALL HAVING count(*) >= 42", "pth")
def long_tracks(spark, d):
    return evidence.long_tracks(views.path(spark, d), TRACK, 42).groupBy(*TRACK).agg(F.count(F.lit(1)).alias("n"))


@query("static_tracks", "SELECT clip_id, track_id, round(coalesce(sum(step), 0), 3) AS path, round(median(dg) FILTER (dg > 0), 6) AS median_diagonal, count(*) AS points, count(*) >= 3 AND NOT bool_or(near_feet) AND count(*) FILTER (dg > 0) > 0 AND coalesce(sum(step), 0) <= 150 * median(dg) FILTER (dg > 0) AS static FROM (SELECT *, 8.0::DOUBLE + source_frame % 9 AS dg, event_type = 'signup' AND control_ratio > 0.8 AS near_feet FROM st) GROUP BY ALL", "pth", "steps")
def static_tracks(spark, d):
    p = views.path(spark, d).withColumn("box_diagonal", F.lit(8.0) + F.col("source_frame") % 9).withColumn("near_feet", (F.col("event_type") == "signup") & (F.col("control_ratio") > 0.8))
    return evidence.static_fragments(p, TRACK, 150.0).withColumns({"path": F.round("path", 3), "median_diagonal": F.round("median_diagonal", 6)})


@query("confirmed_runs", "SELECT clip_id, source_frame FROM (SELECT *, lead(source_frame, 1) OVER w AS a, lead(source_frame, 2) OVER w AS b FROM pth WHERE event_type <> 'signup' WINDOW w AS (PARTITION BY clip_id ORDER BY source_frame)) WHERE a = source_frame + 1 AND b = source_frame + 2", "pth")
def confirmed_runs(spark, d):
    return evidence.confirmed_runs(views.path(spark, d).where("event_type <> 'signup'"), CLIP, 1).select("clip_id", "source_frame")


@query("provenance_gate", "SELECT clip_id, count(*) AS states, count(*) FILTER (event_type <> 'signup') AS eligible, round(count(*) FILTER (event_type <> 'signup') / count(*), 6) AS share, CASE WHEN count(*) FILTER (event_type <> 'signup') >= 0.8 * count(*) THEN 'passed' ELSE 'review_required' END AS status, CASE WHEN count(*) FILTER (event_type <> 'signup') >= 0.8 * count(*) THEN 'continue' ELSE 'blocked' END AS action, (SELECT string_agg(event_type || ':' || n, ',' ORDER BY event_type || ':' || n) FROM (SELECT event_type, count(*) AS n FROM pth q WHERE q.clip_id = p.clip_id GROUP BY 1)) AS by_state FROM pth p GROUP BY clip_id", "pth")
def provenance_gate(spark, d):
    return evidence.provenance_gate(views.path(spark, d).withColumn("state", F.col("event_type")), CLIP, "event_type <> 'signup'", 0.8)


@query("label_counts", "SELECT clip_id, event_type, count(*) AS n FROM pth GROUP BY ALL", "pth")
def label_counts(spark, d):
    return evidence.label_counts(views.path(spark, d), CLIP, "event_type")


@query("missing_frames", "SELECT c.clip_id, f AS source_frame FROM (SELECT clip_id, unnest(generate_series(lo, hi, 1)) AS f FROM (SELECT clip_id, min(source_frame) AS lo, max(source_frame) AS hi FROM det GROUP BY 1)) c ANTI JOIN (SELECT clip_id, source_frame AS f FROM det WHERE class_name = 'sports ball') p USING (clip_id, f)", "det")
def missing_frames(spark, d):
    boxes = views.detections(spark, d)
    clips = boxes.groupBy("clip_id").agg(F.min("source_frame").alias("first_frame"), F.max("source_frame").alias("last_frame"))
    return evidence.missing_frames(boxes.where("class_name = 'sports ball'"), clips, CLIP, 1)


@query("membership_faults", "SELECT workflow_id, event_key, job_id, ordinal, place, repeats FROM (SELECT o_custkey AS workflow_id, o_orderstatus AS event_key, o_orderkey AS job_id, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS ordinal, row_number() OVER (PARTITION BY o_custkey ORDER BY substr(o_orderpriority, 1, 1), o_orderkey) - 1 AS place, count(*) OVER (PARTITION BY o_custkey, substr(o_orderpriority, 1, 1)) AS repeats FROM orders) WHERE place <> ordinal OR repeats > 1")
def membership_faults(spark, d):
    members = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_custkey AS workflow_id", "o_orderstatus AS event_key", "o_orderkey AS job_id", "CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS ordinal")
    return evidence.membership_faults(members, ["workflow_id"], "ordinal", "job_id")


@query("audit_sequence", "SELECT workflow_id, segment_id, ordinal, row_number() OVER (PARTITION BY workflow_id ORDER BY segment_id, ordinal) AS sequence FROM his", "his")
def audit_sequence(spark, d):
    return evidence.audit_sequence(views.history(spark, d), ["workflow_id"], F.expr("segment_id DIV 64"), ["segment_id", "ordinal"]).select("workflow_id", "segment_id", "ordinal", "sequence")


@query("active_leases", "SELECT workflow_id, priority_rank, heartbeats FROM (SELECT workflow_id, priority_rank, max(created_at::DATE) AS renewed, count(*) AS heartbeats FROM job WHERE created_at::DATE <= DATE '1995-06-17' GROUP BY ALL) WHERE renewed + 2 > DATE '1995-06-17'", "job")
def active_leases(spark, d):
    return evidence.active_leases(views.jobs(spark, d), ["workflow_id", "priority_rank"], "1995-06-17", 2).drop("renewed")


@query("clip_clocks", "SELECT clip_id, source_frame, CAST(source_frame AS DOUBLE) / 25 AS clip_seconds FROM det", "det")
def clip_clocks(spark, d):
    return frames.clip_clock(views.detections(spark, d), 25.0).select("clip_id", "source_frame", "clip_seconds")


@query("evenly_sampled", """SELECT clip_id, track_id, source_frame FROM (SELECT *, row_number() OVER w - 1 AS p, count(*) OVER (PARTITION BY clip_id, track_id) AS n FROM pth WINDOW w AS (PARTITION BY clip_id, track_id ORDER BY source_frame)) WHERE n <= 8 OR round_even(round(p * 7 / (n - 1), 0) * (n - 1) / 7, 0) = p""", "pth")
def evenly_sampled(spark, d):
    return evidence.evenly_sampled(views.path(spark, d), TRACK, 8).select("clip_id", "track_id", "source_frame")


@query("contained_spells", """, o AS (SELECT clip_id, block * 4.0::DOUBLE AS s, block * 4.0::DOUBLE + 3 AS e FROM (SELECT DISTINCT clip_id, CAST(floor(clip_seconds / 4) AS BIGINT) AS block FROM pth))
SELECT sp.clip_id, spell_no, s AS outer_start FROM sp JOIN o ON o.clip_id = sp.clip_id AND start_seconds >= s + 0.5 AND end_seconds <= e - 0.5""", "pth", "spells")
def contained_spells(spark, d):
    p = views.path(spark, d)
    inner = tracks.spells(p, CLIP, 0.64).select("clip_id", "spell_no", F.col("start_seconds").alias("start"), F.col("end_seconds").alias("end"))
    outer = p.select("clip_id", F.floor(F.col("clip_seconds") / 4).alias("block")).distinct().select("clip_id", (F.col("block") * 4.0).alias("outer_start"), (F.col("block") * 4.0 + 3).alias("outer_end"))
    return joins.contained(inner, outer, CLIP, 0.5, 4.0).select("clip_id", "spell_no", "outer_start")


@query("version_conflicts", "SELECT workflow_id, segment_id, event_key, ordinal, expected_version FROM (SELECT *, coalesce(lag(ordinal) OVER (PARTITION BY workflow_id, segment_id, event_key ORDER BY ordinal), 0) + 1 AS expected_version FROM his) WHERE ordinal <> expected_version", "his")
def version_conflicts(spark, d):
    return history.version_conflicts(views.history(spark, d), ["workflow_id", "segment_id", "event_key"], "ordinal").select("workflow_id", "segment_id", "event_key", "ordinal", "expected_version")


@query("reference_sets", """, s AS (SELECT o_custkey AS set_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS revision, CASE WHEN o_orderstatus = 'F' THEN 'approved' ELSE 'draft' END AS status, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS n FROM orders)
SELECT set_id, max(revision) AS latest_revision, arg_max(status, revision) AS latest_status, nullif(max(revision) - 1, 0) AS based_on, max(revision) FILTER (status = 'approved') AS approved_revision, arg_max(n, revision) FILTER (status = 'approved') AS approved_members FROM s GROUP BY set_id""", "job")
def reference_sets(spark, d):
    w = Window.partitionBy("set_id").orderBy("o_orderkey")
    sets = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_custkey AS set_id", "o_orderkey", "CASE WHEN o_orderstatus = 'F' THEN 'approved' ELSE 'draft' END AS status", "CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS n_members")
    return history.reference_sets(sets.withColumn("revision", F.row_number().over(w).cast("long")), ["set_id"])


@query("mapping_faults", """, m AS (SELECT l_orderkey AS set_id, l_linenumber AS line, l_suppkey % 9 AS manual_key, l_partkey % 9 AS engine_key FROM lineitem), b AS (SELECT DISTINCT l_orderkey AS set_id, (l_suppkey + l_linenumber) % 9 AS manual_key FROM lineitem)
SELECT * FROM (SELECT m.*, count(*) OVER (PARTITION BY set_id, manual_key) AS manual_uses, count(*) OVER (PARTITION BY set_id, engine_key) AS engine_uses, EXISTS (SELECT 1 FROM b WHERE b.set_id = m.set_id AND b.manual_key = m.manual_key) AS member FROM m) WHERE manual_uses > 1 OR engine_uses > 1 OR NOT member""", "job")
def mapping_faults(spark, d):
    items = spark.read.parquet(f"{d}/lineitem.parquet")
    mappings = items.selectExpr("l_orderkey AS set_id", "l_linenumber AS line", "l_suppkey % 9 AS manual_key", "l_partkey % 9 AS engine_key")
    return history.mapping_faults(mappings, items.selectExpr("l_orderkey AS set_id", "(l_suppkey + l_linenumber) % 9 AS manual_key"), ["set_id"])


@query("import_status", """, l AS (SELECT l_orderkey AS job_id, max(l_linestatus) AS digest FROM lineitem GROUP BY 1), r AS (SELECT o_custkey AS workflow_id, o_orderkey AS job_id, o_orderstatus AS digest, CASE WHEN l.digest IS NULL THEN 'inserted' WHEN l.digest = o_orderstatus THEN 'unchanged' ELSE 'conflicting' END AS status FROM orders LEFT JOIN l ON l.job_id = o_orderkey)
SELECT *, count(*) FILTER (status = 'conflicting') OVER (PARTITION BY workflow_id) = 0 AS applies FROM r""", "job")
def import_status(spark, d):
    incoming = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_custkey AS workflow_id", "o_orderkey AS job_id", "o_orderstatus AS digest")
    ledger = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_orderkey AS job_id", "l_linestatus AS digest").join(incoming.select("workflow_id", "job_id"), "job_id")
    return history.import_status(incoming, ledger, ["workflow_id", "job_id"], "digest")


@query("regression_results", "SELECT l_orderkey AS run_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey, l_quantity) - 1 AS INT) AS result_no, l_suppkey AS segment, l_quantity AS value FROM lineitem QUALIFY l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def regression_results(spark, d):
    one = F.array_sort(F.collect_list(F.struct(F.col("l_suppkey").alias("segment"), F.col("l_quantity").alias("value"))))
    registry = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.to_json(F.struct(one.alias("segmentResults"))).alias("payload"))
    segments = spark.read.parquet(f"{d}/supplier.parquet").where("s_acctbal > 0").select(F.col("s_suppkey").alias("segment"))
    return history.regression_results(registry, segments)


@query("new_artifacts", "SELECT l_returnflag AS provider, l_partkey AS key, l_suppkey AS hash, min(l_orderkey) AS first_order FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem r WHERE r.l_linenumber = 1 AND r.l_returnflag = l.l_returnflag AND r.l_partkey = l.l_partkey AND r.l_suppkey = l.l_suppkey) GROUP BY ALL")
def new_artifacts(spark, d):
    items = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_returnflag AS provider", "l_partkey AS key", "l_suppkey AS hash", "l_orderkey AS first_order", "l_linenumber")
    return history.new_artifacts(items, items.where("l_linenumber = 1"), ["provider", "key", "hash"], ["first_order"])


@query("segment_states", """, s AS (SELECT o_orderkey AS job_id, o_orderkey % 11 = 0 AS running, CASE o_orderstatus WHEN 'O' THEN 'detecting' WHEN 'P' THEN CASE WHEN o_custkey % 2 = 0 THEN 'failed' ELSE 'evidence_ready' END END AS stage, o_custkey % 5 = 0 AS has_events, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS expected, coalesce(n, 0) AS processed FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)
SELECT job_id, CASE WHEN running THEN CASE WHEN stage = 'detecting' THEN 'processing' ELSE 'building' END WHEN stage = 'failed' THEN 'failed' WHEN has_events THEN 'ready' WHEN stage = 'evidence_ready' THEN 'evidence_ready' WHEN stage IS NOT NULL AND expected > 0 AND processed >= expected THEN 'building' WHEN expected > 0 AND processed >= expected THEN 'detections_ready' WHEN processed > 0 THEN 'processing' ELSE 'prepared' END AS state FROM s""", "job")
def segment_states(spark, d):
    n = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("processed"))
    s = spark.read.parquet(f"{d}/orders.parquet").join(n, "o_orderkey", "left").fillna(0, ["processed"])
    stage = F.when(F.col("o_orderstatus") == "O", "detecting").when(F.col("o_orderstatus") == "P", F.when(F.col("o_custkey") % 2 == 0, "failed").otherwise("evidence_ready"))
    state = history.segment_state(F.col("o_orderkey") % 11 == 0, stage, F.col("o_custkey") % 5 == 0, F.substring("o_orderpriority", 1, 1).cast("long"), F.col("processed"))
    return s.select(F.col("o_orderkey").alias("job_id"), state.alias("state"))
