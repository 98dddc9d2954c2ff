"""Attempts at goal: which are one, and what became of them."""

import pytest
from pyspark.sql import functions as F

from fieldtrace.operators import shots

K = ["clip_id"]
EVIDENCE = """clip_id long, attacking_goal map<string,string>, geometry map<string,struct<line:double,low:double,high:double,bar:double,unsure:double>>, duration_seconds double, initial_state string,
 states array<struct<state:string,start_seconds:double,end_seconds:double>>, samples array<struct<frame:long,x:double,y:double,z:double>>, contacts array<struct<frame:long,seconds:double,kind:string,team:string>>,
 goals array<struct<frame:long,seconds:double,team:string,side:string,valid:boolean>>, arrivals array<struct<frame:long,seconds:double,side:string,y:double,z:double,arrested:boolean>>"""
RELEASE = "clip_id long, frame long, seconds double, team string, intent string, continuation_of long"
GOAL = (0.0, 30.0, 38.0, 2.4, 0.3)


def one(spark, clip, intent="scoring_attempt", team="red", states=(("in_play", 0.0, 20.0),), samples=(), contacts=(), goals=(), arrivals=(), duration=20.0, sides=None):
    release = (clip, 10, 1.0, team, intent, None)
    evidence = (clip, {"red": "left"} if sides is None else sides, {"left": GOAL}, duration, "in_play", list(states), [(10 + k, *s) for k, s in enumerate(samples)], list(contacts), list(goals), list(arrivals))
    return release, evidence


def test_what_became_of_attempts(spark):
    toward, wide = [(20.0, 34.0, 1.0), (10.0, 34.0, 1.0)], [(20.0, 34.0, 1.0), (10.0, 50.0, 1.0)]
    over, edge = [(5.0, 34.0, 1.0), (-5.0, 50.0, 1.0)], [(20.0, 30.0, 1.0), (10.0, 30.1, 1.0)]
    keeper = lambda kind="goalkeeper", team="black": [(14, 1.4, kind, team)]
    out = (("in_play", 0.0, 2.0), ("out_of_play", 2.0, 20.0))
    arrest = lambda y, arrested=True: [(15, 1.6, "left", y, 1.0, arrested)]
    cases = {
        "valid_goal": {"goals": [(15, 1.5, "red", "left", True)]}, "unsupported_goal_claim": {"goals": [(15, 1.5, "black", "left", True)]}, "goalkeeper_save": {"samples": toward, "contacts": keeper()},
        "last_line_defender_save": {"samples": toward, "contacts": keeper("last_line_defender")}, "ordinary_block": {"samples": toward, "contacts": keeper("outfield")}, "woodwork_out": {"samples": toward, "contacts": keeper("woodwork")},
        "contact_role_unknown": {"contacts": keeper("unknown")}, "contact_team_conflict": {"samples": toward, "contacts": keeper(team="red")}, "pre_contact_path_off_target": {"samples": wide, "contacts": keeper()},
        "goal_frame_ambiguous": {"samples": edge, "contacts": keeper()}, "insufficient_observed_motion": {"samples": toward[:1]}, "wide_or_high": {"samples": over}, "flight_truncated": {"samples": toward},
        "goal_entry_without_goal_confirmation": {"samples": [(5.0, 34.0, 1.0), (-5.0, 34.0, 1.0)]}, "stopped_at_goal_face": {"arrivals": arrest(34.0)}, "outcome_not_observed": {"arrivals": arrest(34.0, False)},
        "off_frame_arrest_in_play": {"arrivals": arrest(60.0)}, "ambiguous_intent": {"intent": "ambiguous"}, "unknown_attacking_team": {"team": None}, "match_state_unknown": {"states": [("unknown", 0.0, 20.0)]},
        "release_not_in_play": {"states": [("restart_pending", 0.0, 20.0)]}, "attacking_direction_unknown": {"sides": {}}, "play_stopped_before_outcome": {"states": out, "contacts": [(80, 4.0, "goalkeeper", "black")]},
    }
    resolutions = {"valid_goal": "on_target", "goalkeeper_save": "on_target", "last_line_defender_save": "on_target", "stopped_at_goal_face": "on_target", "ordinary_block": "blocked", "woodwork_out": "off_target", "pre_contact_path_off_target": "off_target", "wide_or_high": "off_target", "release_not_in_play": "excluded"}
    both = [one(spark, k, **case) for k, case in enumerate(cases.values())]
    releases, evidence = spark.createDataFrame([r for r, _ in both], RELEASE), spark.createDataFrame([e for _, e in both], EVIDENCE)
    tries = shots.attempts(releases, releases.where("false"), K)
    got = {r["clip_id"]: (r["reason"], r["resolution"]) for r in shots.resolved(tries, evidence, K).collect()}
    assert got == {k: (reason, resolutions.get(reason, "unresolved")) for k, reason in enumerate(cases)}
    events = spark.createDataFrame([(0, "shot_on_target", 0.5, "red"), (0, "pass_candidate", 0.6, "red")], "clip_id long, event_type string, clip_seconds double, team string")
    merged = shots.merged(events, shots.resolved(tries, evidence, K), K).where("clip_id = 0").orderBy("clip_seconds").collect()
    assert [(r["event_type"], r["clip_seconds"]) for r in merged] == [("pass_candidate", 0.6), ("shot_on_target", 1.0)]


def test_attempts_seen_twice(spark):
    rows = [(5, "red", "scoring_attempt", None), (8, "red", "scoring_attempt", None), (9, "red", "ambiguous", 5), (12, "red", "scoring_attempt", None), (15, "red", "pass", None), (18, "red", "scoring_attempt", None), (20, "black", "scoring_attempt", None), (25, "black", "scoring_attempt", None)]
    releases = spark.createDataFrame([(1, f, f / 10, t, i, c) for f, t, i, c in rows], RELEASE)
    breaks = spark.createDataFrame([(1, 12), (1, 20)], "clip_id long, frame long")
    got = shots.attempts(releases, breaks, K).orderBy("frame").collect()
    # 8 is 5 seen again, 9 its continuation; 12 follows a contact, 18 a pass, 20 is another team's; 25 is 20 again.
    assert [(r["frame"], r["end_frame"]) for r in got] == [(5, 12), (12, 15), (18, 20), (20, None)]


def test_faces_and_arrests(spark):
    face = lambda y, z: spark.range(1).select(shots.face(F.lit(y), F.lit(z), *GOAL[1:])).first()[0]
    assert [face(34.0, 1.0), face(30.1, 1.0), face(29.0, 1.0), face(34.0, 2.4), face(34.0, 3.0), face(34.0, -1.0)] == ["inside", "ambiguous", "outside", "ambiguous", "outside", "ambiguous"]
    xs = [200.0, 160.0, 120.0, 60.0, 30.0, 29.0, 28.5, 28.0, 28.0]
    points = spark.createDataFrame([(1, k, k * 0.1, x, 50.0, x) for k, x in enumerate(xs)], "clip_id long, source_frame long, clip_seconds double, x double, y double, far double")
    assert [r["source_frame"] for r in shots.arrests(points, K, 40.0, 400.0).orderBy("source_frame").collect()] == [4, 5]
    assert shots.arrests(points, K, 40.0, 700.0).count() == 0
    with pytest.raises(Exception, match="far"):
        shots.arrests(points.drop("far"), K, 40.0, 400.0).count()
