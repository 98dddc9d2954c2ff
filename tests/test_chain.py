"""The chain of rules and its shared inputs, still-ball restarts and identity along chains, against plain loops."""

import collections
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from fieldtrace.operators import chain, control, restarts, rules, state
from fieldtrace.plans import play

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
CLIP = ["clip_id"]
rng = random.Random(6)


def clips(df):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r["clip_id"]].append(r.asDict(recursive=True))
    return out


def test_order_of_rules(spark):
    made = []
    inputs = chain.Inputs({"a": lambda t: made.append("a") or spark.range(3), "b": lambda t: made.append("b") or t["a"].where("id > 0")})
    keep = lambda name, after=(): chain.Rule(name, lambda e, t: e.join(t["b"], "id", "left_semi"), after)
    assert chain.run(spark.range(5), [[keep("x"), keep("y", ["x"])], [keep("z", ["x", "y"])]], inputs).count() == 2
    assert made == ["b", "a"] or made == ["a", "b"]
    for wrong in ([[keep("y", ["x"]), keep("x")]], [[keep("x")], [keep("x")]], [[keep("y", ["none"])]]):
        with pytest.raises(ValueError):
            chain.run(spark.range(5), wrong, inputs)
    names = [r.name for g in play.RULE_CHAIN for r in g]
    assert names[0] == "startup_guard" and names[-1] == "state_gate" and names.index("boundary_turnovers") < names.index("identity_switches")


def test_rule_chain(spark):
    """The chain gives what its rules give one by one, each on inputs of its own; every rule that can change something does."""
    e = control.with_fallback(play.flight_transfers(spark, DATA).unionByName(play.turning_transfers(spark, DATA)), play.control_transfers(spark, DATA), CLIP, 0.5)
    rows = lambda df: sorted(tuple(map(str, (r[c] for c in sorted(df.columns)))) for r in df.collect())
    assert rows(play.merged_transfers(spark, DATA)) == rows(e)
    obs, spells = play.observed(spark, DATA), play.controlled(spark, DATA)
    e = control.startup_guarded(e, obs, CLIP, 5.0, 0.5)
    stops = play.restarts(spark, DATA).withColumn("stoppage_kind", F.lit(None).cast("string"))
    e = e.unionByName(state.boundary_turnovers(stops, spells, e, CLIP, apart=0.5, startup=2.0))
    e = spark.createDataFrame(e.collect(), e.schema)
    before = e.count()
    e = rules.one_reception(play.follow_shirts(e, play.shared(spark, DATA)), CLIP, 0.5)
    e = spark.createDataFrame(e.collect(), e.schema)
    t = play.shared(spark, DATA)
    e = rules.without_crossing(e, obs, CLIP, 0.8, 1.2, 0.8)
    e = rules.without_transient(e, control.flat(spells, CLIP), t["motion"], t["numbered"], CLIP, sure=0.55, close=0.5)
    e = rules.without_startup(e, CLIP, 0.6, 0.1)
    e = state.gated(e, play.state_intervals(spark, DATA), play.changes_of(spark, DATA), CLIP)
    got = rows(play.rule_chain(spark, DATA))
    assert got == rows(e) and 0 < len(got) < before


def test_shared_plans(spark):
    """What several steps read is not computed again by each."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for name, most in (("gated_events", 8), ("boundary_turnovers", 24), ("merged_transfers", 13)):
        df = play.__dict__[name](spark, DATA)
        assert plan(df).count("Exchange ") <= most, name
    from fieldtrace.plans import catalog

    assert plan(catalog.QUERIES["event_comparison"](spark, DATA)).count("FlatMapGroupsInPandas") == 0


def restarts_by_hand(balls, players, slow=40.0, seconds=0.4, delay=1.5, kick=350.0, sustained=150.0, active=0.5, reacting=6, radius=8.0):
    best = {}
    for b in balls:
        if b["clip_seconds"] not in best or b["confidence"] > best[b["clip_seconds"]]["confidence"]:
            best[b["clip_seconds"]] = b
    seen = [best[t] for t in sorted(best)]
    steps = []
    for p, q in zip(seen, seen[1:], strict=False):
        dt = q["clip_seconds"] - p["clip_seconds"]
        if 0 < dt <= 0.3:
            steps.append((p["clip_seconds"], q["clip_seconds"], math.hypot(p["x"] - q["x"], p["y"] - q["y"]) / dt))
    runs, run = [], []
    for s in [*steps, (math.inf, math.inf, math.inf)]:
        if run and (s[2] > slow or abs(s[0] - run[-1][1]) > 1e-6):
            if run[-1][1] - run[0][0] >= seconds - 1e-9:
                runs.append((run[0][0], run[-1][1]))
            run = []
        if s[2] <= slow:
            run.append(s)
    tracks = collections.defaultdict(list)
    for p in players:
        tracks[p["track_id"]].append(p)
    moves = []
    for track, own in tracks.items():
        own.sort(key=lambda p: p["clip_seconds"])
        for p, q in zip(own, own[1:], strict=False):
            dt, tall = q["clip_seconds"] - p["clip_seconds"], (p["y2"] - p["y1"] + q["y2"] - q["y1"]) / 2
            ball = min(seen, key=lambda b: abs(b["clip_seconds"] - q["clip_seconds"]))  # noqa: B023
            if not 0 < dt <= 0.3 or abs(ball["clip_seconds"] - q["clip_seconds"]) > 0.11:
                continue
            c = [((r["x1"] + r["x2"]) / 2, (r["y1"] + r["y2"]) / 2) for r in (p, q)]
            if math.dist(c[1], (ball["x"], ball["y"])) / tall <= radius:
                moves.append((q["clip_seconds"], math.dist(*c) / dt / tall, track))
    out, used = [], set()
    for start, end in reversed(runs):
        release = next((s for k, s in enumerate(steps) if end - 1e-9 <= s[0] <= end + delay + 1e-9 and s[2] >= kick and sum(x[2] >= sustained for x in steps[k : k + 3]) >= 2), None)
        if release is None or release[0] in used:
            continue
        setup, react = [v for t, v, _ in moves if start <= t <= end], [(v, k) for t, v, k in moves if release[0] - 0.4 <= t <= release[0] + 0.4]
        if len(setup) < 8 or len(react) < 8:
            continue
        a, b = sum(v >= active for v in setup) / len(setup), sum(v >= active for v, _ in react) / len(react)
        who = {k for v, k in react if v >= active}
        if a <= 0.3 and b >= 0.45 and b - a >= 0.15 and len(who) >= reacting:
            used.add(release[0])
            out.append((round(start, 3), round(release[0], 3), round(end, 3), round(a, 4), round(b, 4), len(who), round(release[2], 2)))
    return sorted(out)


@pytest.mark.parametrize("given", [{}, {"slow": 15.0, "delay": 0.3}, {"seconds": 0.2, "reacting": 2, "radius": 2.0, "kick": 100.0}])
def test_stationary_restarts(spark, given):
    balls, players = play.dead_ball(spark, DATA).cache(), play.standing_players(spark, DATA).cache()
    own, who = clips(balls), clips(players)
    want = {c: restarts_by_hand(own[c], who[c], **given) for c in own}
    got = collections.defaultdict(list)
    for r in restarts.stationary_restarts(balls, players, CLIP, **given).collect():
        got[r["clip_id"]].append((r["start_seconds"], r["play_resumed_seconds"], r["stationary_end_seconds"], r["setup_active_ratio"], r["reaction_active_ratio"], r["reacting_players"], r["release_speed"]))
    assert sum(map(len, want.values())) > 5 and set(got) == {c for c, v in want.items() if v}
    for c in got:  # ratios that end in a five round up here and to the even digit there
        assert sorted(got[c]) == [pytest.approx(x, abs=1.1e-4) for x in want[c]]
    with pytest.raises(ValueError):
        restarts.stationary_restarts(balls, players, CLIP, seconds=0.0)


def test_restart_states(spark):
    """The timeline goes from play to a pending restart and back at each release."""
    found = {(r["clip_id"], r["start_seconds"], r["play_resumed_seconds"]) for r in play.stationary_restarts(spark, DATA).collect()}
    changes = play.restart_states(spark, DATA).collect()
    assert {(r["clip_id"], r["clip_seconds"]) for r in changes if r["trigger"] == "restart_kick_and_player_reaction"} == {(c, e) for c, _, e in found}
    assert {r["restart_type"] for r in changes} == {"free_kick"}


def switched(events, labels, teams, span, seconds, least):
    other = {teams[0]: teams[1], teams[1]: teams[0]}
    out, anchors = {}, []
    for e in sorted(events, key=lambda e: (e["clip_seconds"], e["event_no"])):
        own = [x["label"] for x in labels if e["to_track"] is not None and e["completion_seconds"] is not None and x["track_id"] == e["to_track"] and x["label"] and abs(x["clip_seconds"] - e["completion_seconds"]) <= seconds]
        top = collections.Counter(own).most_common(1)
        local = top[0][0] if len(own) >= least and top[0][1] / len(own) >= 0.6 else None
        lead = next((a for a in reversed(anchors) if e["from_track"] is not None and a[2] == e["from_track"] and 0 <= e["clip_seconds"] - a[3] <= span), None)
        sender = e["team"] if lead is None else lead[0] if lead[1] else other[lead[0]]
        if local is None or sender not in teams or lead is None and (e["event_type"] != "turnover_candidate" or local != sender):
            out[e["event_no"]] = (e["event_type"], e["team"], None)
            continue
        anchors.append((sender, local == sender, e["to_track"], e["completion_seconds"]))
        out[e["event_no"]] = ("pass_candidate" if local == sender else "turnover_candidate", sender, "continuity" if lead else "identity")
    return out


@pytest.mark.parametrize(("span", "least"), [(4.0, 3), (1.0, 1)])
def test_identity_switches(spark, span, least):
    events, labels = [], []
    for clip in range(12):
        shirt = {t: rng.choice(["red", "black"]) for t in range(8)}
        labels += [(clip, t, round(i * 0.1, 2), shirt[t] if rng.random() < 0.85 else rng.choice(["red", "black", None])) for t in shirt for i in range(0, 200) if rng.random() < 0.5]
        at, holder = 0.0, 0
        for n in range(20):
            to = rng.choice([t for t in shirt if t != holder])
            at += rng.uniform(0.2, 1.5)
            done = round(at + rng.uniform(0.1, 0.8), 3)
            lost = rng.random() < 0.5
            events.append((clip, n, "turnover_candidate" if lost else "pass_candidate", round(at, 3), shirt[holder] if rng.random() < 0.8 else "blue", None if rng.random() < 0.05 else holder, None if rng.random() < 0.05 else to, None if rng.random() < 0.05 else done))
            at, holder = done, to if rng.random() < 0.9 else rng.randrange(8)
    kind = "clip_id long, event_no long, event_type string, clip_seconds double, team string, from_track long, to_track long, completion_seconds double"
    a, b = spark.createDataFrame(events, kind).cache(), spark.createDataFrame(labels, "clip_id long, track_id long, clip_seconds double, label string").cache()
    own, worn = clips(a), clips(b)
    want = {(c, n): v for c in own for n, v in switched(own[c], worn[c], ("red", "black"), span, 0.8, least).items()}
    got = {(r["clip_id"], r["event_no"]): (r["event_type"], r["team"], r["corrected"]) for r in restarts.identity_switches(a, b, CLIP, ("red", "black"), span, 0.8, least).collect()}
    count = collections.Counter(v[2] for v in want.values())
    assert got == want and count["identity"] > 5 and count["continuity"] > 5


def setups_by_hand(found, spells, balls):
    best = {}
    for b in balls:
        if b["clip_seconds"] not in best or b["confidence"] > best[b["clip_seconds"]]["confidence"]:
            best[b["clip_seconds"]] = b
    seen = [best[t] for t in sorted(best)]
    steps = [(p["clip_seconds"], q["clip_seconds"], math.hypot(p["x"] - q["x"], p["y"] - q["y"]) / (q["clip_seconds"] - p["clip_seconds"])) for p, q in zip(seen, seen[1:], strict=False) if q["clip_seconds"] - p["clip_seconds"] <= 0.3]
    out = {}
    for r in found:
        release = r["play_resumed_seconds"]
        own = sorted(s for s in spells if release < s[0] <= release + 2 and s[1] - s[0] >= 1) if r["stoppage_kind"] == "stationary_ball_restart" and release is not None else []
        if not own:
            out[r["start_seconds"]] = (release, None)
            continue
        latest, start, end = None, None, None
        for k, (a, b, v) in enumerate(steps):
            if b < own[0][0] - 1e-9 or a > own[0][1] + 2 + 1e-9:
                continue
            if end is not None and a - end > 0.3:
                start = end = None
            if v <= 100:
                start, end = a if start is None else start, b
                continue
            if start is not None and end - start >= 0.4 - 1e-9 and v >= 200 and sum(x[2] >= 100 for x in steps[k : k + 3]) >= 2:
                latest = a
            start = end = None
        out[r["start_seconds"]] = (round(latest if latest is not None else own[0][1], 3), release)
    return out


def test_restarts_through_setup(spark):
    balls = play.dead_ball(spark, DATA).cache()
    found = restarts.stationary_restarts(balls, play.standing_players(spark, DATA), CLIP).cache()
    spells = [(c, s, round(s + rng.uniform(0.5, 2.5), 2)) for c in (0, 1) for s in [round(rng.uniform(0, 20), 2) for _ in range(14)]]
    table = spark.createDataFrame(spells, "clip_id long, start_seconds double, end_seconds double")
    mixed = found.unionByName(found.where("start_seconds < 3").withColumns({"stoppage_kind": F.lit(None).cast("string"), "start_seconds": F.col("start_seconds") + 0.001}))
    got = {(r["clip_id"], r["start_seconds"]): r for r in restarts.through_setup(mixed, table, balls, CLIP).collect()}
    own = clips(balls)
    want = {(c, k): v for c, rows in clips(mixed).items() for k, v in setups_by_hand(rows, [s[1:] for s in spells if s[0] == c], own[c]).items()}
    assert {k: (r["play_resumed_seconds"], r["discarded_release_seconds"]) for k, r in got.items()} == want and len(got) == mixed.count()
    changed = [r for r in got.values() if r["discarded_release_seconds"] is not None]
    assert 3 < len(changed) < len(got) and all(r["release_confidence"] == 0.75 and r["duration_seconds"] == pytest.approx(r["play_resumed_seconds"] - r["start_seconds"], abs=1e-6) for r in changed)
    assert any(r["play_resumed_seconds"] > r["setup_end_seconds"] for r in changed)


def test_handoffs(spark):
    """Boxes on each other: one track ends where the other begins; another team's shirt; tracks that only meet; boxes apart."""
    box = lambda t, f, x, team="red": (1, t, f, f / 10, team, x, 0.0, x + 10.0, 20.0)
    boxes = [box(1, f, 0.0) for f in (8, 9, 10)] + [box(2, f, 0.5) for f in (10, 11)] + [box(3, f, 100.0) for f in (10, 11, 12)] + [box(4, f, 100.5, "black" if f == 11 else "red") for f in (10, 11)] + [box(5, f, 200.0) for f in (10, 11)] + [box(6, f, 200.0, "unknown") for f in (10, 11)] + [box(7, 10, 300.0), box(8, 10, 306.0)]
    table = spark.createDataFrame(boxes, "clip_id long, track_id long, source_frame long, clip_seconds double, team string, x1 double, y1 double, x2 double, y2 double")
    kind = "clip_id long, clip_seconds double, completion_seconds double, event_type string, team string, from_track long, to_track long, confidence double"
    p = "pass_candidate"
    rows = [(1, 1.0, 1.2, p, "red", 1, 2, 0.5), (1, 2.0, 2.2, p, "red", 1, 2, 0.5), (1, 1.0, 1.2, "turnover_candidate", "red", 1, 2, 0.5), (1, 1.2, 1.3, p, "red", 3, 4, 0.5), (1, 1.0, 1.1, p, "red", 5, 6, 0.5), (1, 1.0, 1.1, p, "red", 7, 8, 0.5), (1, 1.0, None, p, "red", 1, 2, 0.5)]
    got = sorted((r["clip_seconds"], str(r["completion_seconds"]), r["event_type"], r["from_track"]) for r in rules.without_handoffs(spark.createDataFrame(rows, kind), table, CLIP).collect())
    assert got == sorted((r[1], str(r[2]), r[3], r[5]) for k, r in enumerate(rows) if k not in (0, 3))
    assert 0 < play.handoff_free_passes(spark, DATA).count() <= play.control_transfers(spark, DATA).count()


def test_controlled_turnovers(spark):
    """The clips' own transfers, and made ones where many turnovers have just the sender's team at the ball."""
    events, boxes, balls = [], [], []
    for clip in range(10):
        balls += [(clip, f, f / 25, float(rng.randint(0, 50)), 100.0) for f in range(0, 500) if rng.random() < 0.9]
        at = {f: x for c, f, _, x, _ in balls if c == clip}
        boxes += [(clip, f, rng.choice(["red", "red", "black"]), at[f] + dx - 5, 80.0, at[f] + dx + 5, 100.0) for f in at for dx in rng.choices([0.0, 200.0], k=2)]
        t = 0.0
        for n in range(25):
            t += rng.uniform(0.1, 1.2)
            events.append((clip, n, rng.choice(["turnover_candidate", "turnover_candidate", "pass_candidate"]), round(t, 3), rng.choice(["red", "black", None]), None if rng.random() < 0.1 else 5, None if rng.random() < 0.1 else round(t + 0.3, 3)))
    e = spark.createDataFrame(events, "clip_id long, event_no long, event_type string, clip_seconds double, team string, to_track long, completion_seconds double").cache()
    p = spark.createDataFrame(boxes, "clip_id long, source_frame long, team string, x1 double, y1 double, x2 double, y2 double").cache()
    b = spark.createDataFrame(balls, "clip_id long, source_frame long, clip_seconds double, x double, y double").cache()
    own, who, where = clips(e), clips(p), clips(b)
    want = set()
    for c, rows in own.items():
        team = at = None
        for r in sorted(rows, key=lambda r: (r["clip_seconds"], r["event_no"])):
            mine, again = r["team"], False
            if team is not None and r["event_type"] == "pass_candidate" and mine != team and r["clip_seconds"] - at <= 2:
                mine, again, team, at = team, True, None, None
            ball = next((x for x in sorted(where[c], key=lambda x: x["source_frame"]) if r["completion_seconds"] is not None and 0 <= x["clip_seconds"] - (r["completion_seconds"] - 0.04) <= 0.08), None)
            if r["event_type"] == "turnover_candidate" and r["to_track"] is not None and ball is not None:
                near = {x["team"] for x in who[c] if x["source_frame"] == ball["source_frame"] and math.hypot(max(x["x1"] - ball["x"], 0, ball["x"] - x["x2"]), max(x["y1"] - ball["y"], 0, ball["y"] - x["y2"])) / max(1.0, x["y2"] - x["y1"]) <= 0.25}
                if near == {r["team"]}:
                    team, at = r["team"], r["completion_seconds"]
                    continue
            want.add((c, r["event_no"], mine, again))
    got = {(r["clip_id"], r["event_no"], r["team"], r["retained"]) for r in restarts.controlled_turnovers(e, p, b, CLIP).collect()}
    assert got == want and sum(w[3] for w in want) > 3 and len(want) < len(events) - 10
    assert 0 < play.controlled_turnovers(spark, DATA).count() <= play.control_transfers(spark, DATA).count()
