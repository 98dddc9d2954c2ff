"""Folds over clips against plain loops, on what the given tables make."""

import collections
import math
import os

import pytest
from pyspark.sql import functions as F

from fieldtrace.operators import control, identity, points, reports, scoring, state
from fieldtrace.plans import measures, play

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
CLIP = ["clip_id"]


@pytest.fixture(scope="module")
def spells(spark):
    """Spells of each clip in order, and the table that they are from."""
    table = play.controlled(spark, DATA).cache()
    clips = collections.defaultdict(list)
    for r in table.orderBy("clip_id", "spell_no").collect():
        clips[r["clip_id"]].append(r["spell"].asDict(recursive=True))
    return table, clips


@pytest.fixture(scope="module")
def path(spark):
    """The ball's points (seconds, x, y) of each clip."""
    clips = collections.defaultdict(list)
    for r in play.views.balls(spark, DATA).orderBy("clip_id", "source_frame").collect():
        clips[r["clip_id"]].append((r["clip_seconds"], r["x"], r["y"]))
    return clips


def keyed(rows, *names):
    return sorted((tuple(round(r[c], 4) if isinstance(r[c], float) else r[c] for c in ("clip_id", *names)) for r in rows), key=str)


def far(a, b):
    return math.hypot(a["player_x"] - b["player_x"], a["player_y"] - b["player_y"]) / max(1.0, (a["height"] + b["height"]) / 2)


@pytest.mark.parametrize(("longest", "occluded", "speed", "turn"), [(0.6, None, 3.0, None), (0.3, 1.5, 3.0, None), (0.2, 2.5, 4.0, 0.0)])
def test_collapsed(spells, longest, occluded, speed, turn):
    table, clips = spells
    expected = []
    for clip, rows in clips.items():
        kept, k = [], 0
        while k < len(rows):
            s = dict(rows[k])
            again = next((j for j in range(k, len(rows)) if kept and rows[j]["team"] == kept[-1]["team"]), None)
            if kept and s["team"] != kept[-1]["team"] and again is not None:
                own, back = kept[-1], rows[again]
                bridge = rows[again - 1]["end_seconds"] - s["start_seconds"] <= longest and back["start_seconds"] - rows[again - 1]["end_seconds"] <= (longest if occluded is None else occluded)
                took = back["first"]["clip_seconds"] - own["last"]["clip_seconds"]
                plausible = occluded is not None and 0 < took <= occluded and far(own["last"], back["first"]) / took <= speed
                if plausible and turn is not None:
                    a = [own["last"][c] - own["before"][c] for c in ("player_x", "player_y")] if own["before"] else [0, 0]
                    b = [back["first"][c] - own["last"][c] for c in ("player_x", "player_y")]
                    plausible = math.hypot(*a) > 0 and math.hypot(*b) > 0 and a[0] * b[0] + a[1] * b[1] >= turn * math.hypot(*a) * math.hypot(*b)
                firm = any(o["observations"] >= 4 and o["close"] >= 2 for o in rows[k:again])
                if bridge or (plausible and (back["observations"] >= 2 or not firm)):
                    if own["last"]["track_id"] == back["first"]["track_id"]:
                        own.update(observations=own["observations"] + back["observations"], before=back["before"] or own["last"], last=back["last"], end_seconds=back["end_seconds"])
                        k = again + 1
                    else:
                        kept.append(dict(back))
                        k = again + 1
                    continue
            kept.append(s)
            k += 1
        expected += [dict(x, clip_id=clip) for x in kept]
    got = control.flat(control.collapsed(table, CLIP, longest, occluded, speed, turn), CLIP).collect()
    names = ("team", "track_id", "start_seconds", "end_seconds", "observations")
    assert keyed(got, *names) == keyed(expected, *names)


def deduplicated(events):
    kept = []
    for e in sorted(events, key=lambda e: (e["clip_seconds"], e["completion_seconds"], e["event_type"], e["team"], str(e["from_track"]))):
        for k, p in enumerate(kept):
            limit = 0.25 if p["from_track"] == e["from_track"] else 0.04
            if (p["event_type"], p["team"], p["to_track"]) == (e["event_type"], e["team"], e["to_track"]) and abs(p["completion_seconds"] - e["completion_seconds"]) <= limit:
                if p["from_track"] == e["from_track"]:
                    kept[k] = e
                break
        else:
            kept.append(e)
    return kept


def made(clip, kind, at, s, to, confidence, done):
    return {"clip_id": clip, "event_type": kind, "clip_seconds": round(at, 3), "team": s["team"], "from_track": s["track_id"], "to_track": to, "confidence": round(confidence, 4), "completion_seconds": round(done, 3)}


NAMES = ("event_type", "clip_seconds", "team", "from_track", "to_track", "confidence", "completion_seconds")


def speeds(pts):
    for (a, ax, ay), (b, bx, by), (c, cx, cy) in zip(pts, pts[1:], pts[2:], strict=False):
        i, o = math.hypot(bx - ax, by - ay), math.hypot(cx - bx, cy - by)
        yield b, i / (b - a), o / (c - b), ((bx - ax) * (cx - bx) + (by - ay) * (cy - by)) / (i * o) if i and o else None, (bx, by), c


def test_direction_changes(spark, spells, path):
    expected = []
    for clip, rows in spells[1].items():
        own = []
        for s, r in zip(rows, rows[1:], strict=False):
            if s["team"] == r["team"] and s["track_id"] != r["track_id"] and 0 <= r["start_seconds"] - s["end_seconds"] <= 3:
                turns = [t for at, i, o, t, _, _ in speeds(path[clip]) if s["end_seconds"] <= at <= r["start_seconds"] and min(i, o) >= 100 and t is not None and t <= 0.25]
                if turns:
                    own.append(made(clip, "pass_candidate", s["end_seconds"], s, r["track_id"], min(0.8, 0.55 + (1 - min(turns)) * 0.1), r["start_seconds"]))
        expected += deduplicated(own)
    assert keyed(play.turning_transfers(spark, DATA).collect(), *NAMES) == keyed(expected, *NAMES)


def test_flights(spark, spells):
    expected = []
    releases = collections.defaultdict(list)
    for r in play.released(spark, DATA).collect():
        releases[r["clip_id"]].append((r["clip_seconds"], r["speed"]))
    for clip, rows in spells[1].items():
        own = []
        for at, speed in sorted(releases[clip]):
            senders = [s for s in rows if s["start_seconds"] <= at and s["end_seconds"] >= at - 1]
            if senders:
                s = max(senders, key=lambda s: s["end_seconds"])
                r = next((r for r in rows if at <= r["start_seconds"] <= at + 3 and r["track_id"] != s["track_id"]), None)
                if r:
                    own.append(made(clip, "pass_candidate" if r["team"] == s["team"] else "turnover_candidate", at, s, r["track_id"], min(0.9, 0.45 + speed / 1000), r["start_seconds"]))
        expected += deduplicated(own)
    assert len(expected) > 5 and keyed(play.flight_transfers(spark, DATA).collect(), *NAMES) == keyed(expected, *NAMES)


def slowed_by_hand(spells, path):
    expected = []
    for clip, rows in spells.items():
        own = []
        for s, r in zip(rows, rows[1:], strict=False):
            found = []
            for at, i, o, _, (x, y), _ in speeds(path[clip]):
                fits = s["team"] == r["team"] and i >= 100 and o <= 0.9 * i and s["end_seconds"] < at < r["start_seconds"] and at - s["end_seconds"] <= 0.75 and 0.6 <= r["start_seconds"] - at <= 8
                again = any(b >= at + 0.6 and c <= r["start_seconds"] and out >= 300 for b, _, out, _, _, c in speeds(path[clip]))
                if fits and again and math.hypot(x - s["last"]["ball_x"], y - s["last"]["ball_y"]) / max(1.0, s["last"]["height"]) >= 0.1:
                    found.append((i / max(o, 1.0), at))
            if found:
                own.append(made(clip, "pass_candidate", s["end_seconds"], s, None, 0.6, max(found)[1]))
        expected += deduplicated(own)
    return expected


def test_decelerations(spark, spells, path):
    assert keyed(play.slowed_transfers(spark, DATA).collect(), *NAMES) == keyed(slowed_by_hand(spells[1], path), *NAMES)
    own, points = collections.defaultdict(list), collections.defaultdict(list)
    for r in play.passed_spells(spark, DATA).orderBy("clip_id", "spell_no").collect():
        own[r["clip_id"]].append(r["spell"].asDict(recursive=True))
    for r in play.passed_ball(spark, DATA).orderBy("clip_id", "source_frame").collect():
        points[r["clip_id"]].append((r["clip_seconds"], r["x"], r["y"]))
    expected = slowed_by_hand(own, points)
    assert keyed(play.slowed_flights(spark, DATA).collect(), *NAMES) == keyed(expected, *NAMES) and len(expected) > 5


def test_with_fallback(spark):
    first = [r.asDict() for q in (play.flight_transfers, play.turning_transfers) for r in q(spark, DATA).collect()]
    second = [r.asDict() for r in play.control_transfers(spark, DATA).collect()]
    expected = []
    order = lambda e: (e["clip_seconds"], e["completion_seconds"], e["event_type"], e["team"], e["from_track"])
    for clip in {e["clip_id"] for e in first + second}:
        kept = [e for e in first if e["clip_id"] == clip]
        for e in sorted((e for e in second if e["clip_id"] == clip), key=order):
            if all(abs(e["clip_seconds"] - p["clip_seconds"]) > 0.5 for p in kept):
                kept.append(e)
        expected += deduplicated(kept)
    assert keyed(play.merged_transfers(spark, DATA).collect(), *NAMES) == keyed(expected, *NAMES)


def test_confirmed_control(spark):
    """A team that had the ball keeps a high or passing ball that the same player controls soon after."""
    box = lambda frame, track, team, x, y: (1, frame, frame / 25, track, team, x - 10.0, y - 50.0, x + 10.0, y)
    players = [box(f, 1, "red", 100.0, 100.0) for f in range(10)] + [box(f, 2, "black", 300.0, 100.0) for f in range(10)]
    spots = [(100, 99), (100, 60), (104, 62), (100, 99), (300, 99), (300, 50), (302, 50), (306, 52), (310, 54), (400, 400)]
    balls = [(1, f, f / 25, 1, float(x), float(y)) for f, (x, y) in enumerate(spots)]
    p = spark.createDataFrame(players, "clip_id long, source_frame long, clip_seconds double, track_id long, team string, x1 double, y1 double, x2 double, y2 double")
    b = spark.createDataFrame(balls, "clip_id long, source_frame long, clip_seconds double, track_id long, x double, y double")
    frames = lambda **kw: [(r["source_frame"], r["team"]) for r in control.control_observations(p, b, CLIP, 1.2, ground=0.4, aerial_turn=-1.0, **kw).orderBy("source_frame").collect()]
    assert frames() == [(0, "red"), (3, "red"), (4, "black")]
    assert frames(confirm=0.2) == [(0, "red"), (1, "red"), (2, "red"), (3, "red"), (4, "black")]
    with pytest.raises(ValueError):
        control.control_observations(p, b, CLIP, 1.2, confirm=-1.0)


def test_spells_of_returning_tracks(spark):
    """Two tracks that take turns are two players, even where one stands where the other stood."""
    rows = [(1, k, k * 0.2, "red", t, 10.0, 10.0, 40.0, 10.0, 10.0, 0.2) for k, t in enumerate([1, 2, 1, 2, 3])]
    o = spark.createDataFrame(rows, "clip_id long, " + ", ".join(f.replace(":", " ") for f in control.OBSERVATION[7:-1].split(",")))
    count = lambda apart: control.spells(control.spell_numbers(o, CLIP, 0.64, 0.75, apart), CLIP).count()
    assert (count(0.0), count(0.5), count(0.1)) == (1, 4, 1)


def test_boundary_turnovers(spark, spells):
    lost = [r.asDict() for r in play.control_transfers(spark, DATA).collect() if r["event_type"] == "turnover_candidate"]
    expected = []
    for clip, rows in spells[1].items():
        own = []
        for i in sorted((r for r in play.restarts(spark, DATA).collect() if r["clip_id"] == clip and not r["starts_outside"]), key=lambda r: r["start_seconds"]):
            owners = [s for s in rows if i["start_seconds"] - 2 <= s["end_seconds"] <= i["start_seconds"]]
            if not owners:
                continue
            s = max(owners, key=lambda s: s["end_seconds"])
            back = i["play_resumed_seconds"] if i["play_resumed_seconds"] is not None else i["resumed_seconds"]
            if back is not None and (s["held"] >= 2 or i["start_seconds"] <= 2):
                takers = [r for r in rows if back <= r["start_seconds"] <= back + 8 and r["track_id"] != s["track_id"]]
                if takers and min(takers, key=lambda r: r["start_seconds"])["team"] == s["team"]:
                    continue
            if any(e["clip_id"] == clip and e["team"] == s["team"] and abs(e["clip_seconds"] - i["start_seconds"]) <= 0.5 for e in lost + own):
                continue
            own.append(made(clip, "turnover_candidate", i["start_seconds"], s, None, min(0.8, 0.5 + (i["end_seconds"] - i["start_seconds"]) / 20), i["start_seconds"]))
        expected += own
    assert keyed(play.boundary_turnovers(spark, DATA).collect(), *NAMES) == keyed(expected, *NAMES)


def test_state_gate(spark):
    """Restart passes always, a turnover just when the ball goes out, all else only in play."""
    changes = spark.createDataFrame([(1, 1, 2.0, "out_of_play", 5.0, "in_play"), (1, 2, 3.0, "in_play", 5.0, "in_play")], "clip_id long, transition_no int, clip_seconds double, state string, duration_seconds double, initial_state string")
    clips = spark.createDataFrame([(1, 5.0)], "clip_id long, duration_seconds double")
    stretches = state.state_intervals(changes, clips, CLIP)
    assert [tuple(r)[1:] for r in stretches.orderBy("start_seconds").collect()] == [("in_play", 0.0, 2.0), ("out_of_play", 2.0, 3.0), ("in_play", 3.0, 5.0)]
    events = [(1, "pass_candidate", 1.0, 1.5), (1, "pass_candidate", 1.5, 2.5), (1, "turnover_candidate", 2.0, 2.0), (1, "turnover_candidate", 2.2, None), (1, "restart_pass_candidate", 2.5, 2.6), (1, "pass_candidate", 4.0, 5.0), (1, "pass_candidate", 3.0, None)]
    e = spark.createDataFrame(events, "clip_id long, event_type string, clip_seconds double, completion_seconds double")
    assert sorted(r["clip_seconds"] for r in state.gated(e, stretches, changes, CLIP).collect()) == [1.0, 2.0, 2.5, 3.0, 4.0]


def test_causal_labels(spark):
    labels = ["unknown", "red", "black", "black", "red", "red", "unknown", "black", "black", "black", "red"]
    df = spark.createDataFrame([(1, 1, k, x) for k, x in enumerate(labels)], "clip_id long, track_id long, source_frame long, label string")
    seen, now, expected = collections.deque(maxlen=5), "unknown", []
    for x in labels:
        if x != "unknown":
            seen.append(x)
        counts = collections.Counter(seen)
        leaders = [t for t in counts if counts[t] == max(counts.values())]
        if leaders and now not in leaders:
            now = next(t for t in reversed(seen) if t in leaders)
        expected.append(now)
    assert [r["stable_label"] for r in identity.causal_labels(df, ["clip_id", "track_id"], 5).orderBy("source_frame").collect()] == expected


def test_association(spark):
    """Tracks of boxes against a loop over frames, with and without overlap in the cost."""
    rows = play.views.players(spark, DATA).where("clip_id = 0").select("clip_id", "source_frame", "clip_seconds", (F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("point_no"), "x1", "y1", "x2", "y2")
    frames = collections.defaultdict(list)
    for r in rows.orderBy("source_frame", "point_no").collect():
        frames[r["source_frame"]].append(r)
    foot = lambda r: ((r["x1"] + r["x2"]) / 2, r["y2"])
    for heights, overlap, least in ((0.8, 0.25, 25.0), (0.0, 0.0, 35.0)):
        tracks = []
        for f in sorted(frames):
            own = frames[f]
            active = [t for t in tracks if own[0]["clip_seconds"] - t[-1]["clip_seconds"] <= 0.4]
            pairs = []
            for i, t in enumerate(active):
                took = own[0]["clip_seconds"] - t[-1]["clip_seconds"]
                x, y = foot(t[-1])
                if len(t) > 1:
                    (a, b), step = foot(t[-2]), t[-1]["clip_seconds"] - t[-2]["clip_seconds"]
                    x, y = (x + (x - a) / step * took, y + (y - b) / step * took) if step > 0 else (x, y)
                gate = max(least, heights * max(1.0, t[-1]["y2"] - t[-1]["y1"]) + 300 * took)
                for j, p in enumerate(own):
                    d = math.hypot(foot(p)[0] - x, foot(p)[1] - y)
                    if d <= gate:
                        q = t[-1]
                        both = max(0, min(p["x2"], q["x2"]) - max(p["x1"], q["x1"])) * max(0, min(p["y2"], q["y2"]) - max(p["y1"], q["y1"]))
                        area = lambda b: (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])
                        pairs.append(((d / gate if heights else d) - overlap * both / (area(p) + area(q) - both), i, j))
            done_i, done_j = set(), set()
            for _, i, j in sorted(pairs):
                if i not in done_i and j not in done_j:
                    done_i.add(i)
                    done_j.add(j)
                    active[i].append(own[j])
            tracks += [[p] for j, p in enumerate(own) if j not in done_j]
        expected = {(p["source_frame"], p["point_no"]): k + 1 for k, t in enumerate(tracks) for p in t}
        got = points.associated(rows, CLIP, 0.4, 300.0, least, heights, overlap).collect()
        assert {(r["source_frame"], r["point_no"]): r["track_id"] for r in got} == expected
        assert len(tracks) < len(expected)


def test_event_scores(spark):
    a = [(1, "pass", 1.0, 1), (1, "pass", 1.2, 2), (1, "pass", 9.0, 3), (1, "shot", 4.0, 4)]
    b = [(1, "pass", 1.1, 1), (1, "pass", 1.3, 2), (1, "pass", 5.0, 3), (1, "goal", 4.0, 4)]
    kind = "clip_id long, event_type string, seconds double, event_no long"
    got = {r["event_type"]: r for r in scoring.event_scores(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), CLIP, 0.5).collect()}
    told = lambda t: tuple(got[t][c] for c in ("tp", "fp", "fn", "precision", "recall"))
    assert (told("pass"), told("shot"), told("goal")) == ((2, 1, 1, 0.6667, 0.6667), (0, 1, 0, 0.0, 0.0), (0, 0, 1, 0.0, 0.0))


def test_spaced(spark):
    rows = [r.asDict() for r in measures.views.detections(spark, DATA).where("clip_id = 0").collect()]
    expected = set()
    for f in {r["source_frame"] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r["source_frame"] == f), key=lambda r: (-r["confidence"], r["l_partkey"], r["l_linenumber"])):
            if all(math.hypot(r["x1"] - p["x1"], r["y1"] - p["y1"]) > 120 for p in kept):
                kept.append(r)
        expected |= {(f, r["l_partkey"], r["l_linenumber"]) for r in kept}
    assert {(r["source_frame"], r["l_partkey"], r["l_linenumber"]) for r in measures.spaced_candidates(spark, DATA).where("clip_id = 0").collect()} == expected


def test_alignment_in_stretches(spark):
    """The alignment of a clip in stretches is that of the whole clip: most matches, then the least difference."""
    import itertools
    import random

    own = random.Random(6)
    for _ in range(3):
        sides = [sorted(round(own.uniform(0, 12), 2) for _ in range(6)) for _ in range(2)]
        dfs = [spark.createDataFrame([(1, k, s, "a", "red") for k, s in enumerate(x)], "clip_id long, event_no long, seconds double, event_type string, team string") for x in sides]
        got = reports.aligned(*dfs, CLIP, 1.0).collect()
        best = (0, 0.0)
        for n in range(7):
            for i in itertools.combinations(range(6), n):
                for j in itertools.combinations(range(6), n):
                    gaps = [abs(sides[0][a] - sides[1][b]) for a, b in zip(i, j, strict=True)]
                    if all(x <= 1.0 for x in gaps):
                        best = max(best, (n, -sum(gaps)))
        assert len(got) == best[0] and sum(r["difference"] for r in got) == pytest.approx(-best[1])


def test_predictions(spark):
    """The filter of seven numbers against one of matrices."""
    import numpy as np

    rows = [(r["source_frame"], r["x"], r["y"]) if r["state"] in ("click", "view") else (r["source_frame"], None, None) for r in measures.views.balls(spark, DATA).where("clip_id = 0").orderBy("source_frame").collect()]
    n = points.NOISE
    state, expected = None, []
    for frame, x, y in rows:
        if state is None:
            if x is not None:
                state, cov, last = np.array([x, y, 0, 0.0]), np.diag([n["first_position"]] * 2 + [n["first_velocity"]] * 2), frame
            continue
        move = np.eye(4)
        move[0, 2] = move[1, 3] = (frame - last) / 25
        state, cov, last = move @ state, move @ cov @ move.T + np.diag([n["position"]] * 2 + [n["velocity"]] * 2), frame
        if x is None:
            expected.append((frame, *state[:2], min(140.0, max(12.0, 2.5 * math.sqrt(np.linalg.eigvalsh(cov[:2, :2]).max())))))
        else:
            see = np.eye(2, 4)
            gain = cov @ see.T @ np.linalg.inv(see @ cov @ see.T + np.eye(2) * n["measured"])
            state, cov = state + gain @ (np.array([x, y]) - see @ state), (np.eye(4) - gain @ see) @ cov
    got = [tuple(r)[1:] for r in measures.ball_predictions(spark, DATA).where("clip_id = 0").orderBy("source_frame").collect()]
    assert len(got) > 50 and np.allclose(np.array(got), np.array(expected), atol=1e-6)


def test_boxes_that_the_order_leaves_open(spark, tmp_path):
    """Two boxes of one track, as near and as tall: the SQL's ORDER BY leaves open which counts, and spells hang on it. The query takes the one farther left, in whatever order they come."""
    duckdb = pytest.importorskip("duckdb")
    from fieldtrace.plans import catalog

    sql, order = catalog.SQL["control_spells"], "ORDER BY dist, track_id, dist / height"
    assert sql.count(order) == 1
    boxes = [(424, 207, 223, 4), (424, 177, 43, 4), (425, 160, 1, 4)]
    for k, rows in enumerate((boxes, boxes[::-1])):
        d = str(tmp_path / str(k))
        spark.createDataFrame([(424, 26, "view", 1.0), (425, 0, "view", 1.0)], "event_id long, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{d}/events.parquet")
        spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").coalesce(1).write.parquet(f"{d}/lineitem.parquet")
        con = duckdb.connect()
        for t in ("events", "lineitem"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
        left, right = (sorted(con.execute(sql.replace(order, f"{order}, player_x {way}")).fetchall()) for way in ("ASC", "DESC"))
        assert [len(left), len(right)] == [1, 2]
        columns = ["clip_id", "spell_no", "team", "track_id", "start_seconds", "end_seconds", "observations", "close", "first_ball_x", "last_ball_x"]
        assert sorted(map(tuple, play.control_spells(spark, d).select(*columns).collect())) == left


@pytest.mark.parametrize("name, left, right", [
    ("single_touch_senders", [(0, 1, "black", 7, 2)], []),
    ("stable_spells", [(0, 1, "black", 7, 2)], [(0, 2, "black", 1, 1)]),
])
def test_rows_that_hang_on_an_open_order(spark, tmp_path, name, left, right):
    """The same two boxes: the rows of the SQL hang on the one it takes, which its ORDER BY leaves open. The query's are those for the one farther left, in whatever order boxes come and however they are dealt to tasks."""
    duckdb = pytest.importorskip("duckdb")
    from fieldtrace.plans import catalog

    sql, order = catalog.SQL[name], "ORDER BY dist, track_id, dist / height"
    assert sql.count(order) == 1
    boxes = [(424, 207, 223, 4), (424, 177, 43, 4), (425, 160, 1, 4)]
    for k, rows in enumerate((boxes, boxes[::-1])):
        d = str(tmp_path / str(k))
        spark.createDataFrame([(424, 26, "view", 1.0), (425, 0, "view", 1.0)], "event_id long, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{d}/events.parquet")
        spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").repartition(1 + 2 * k).write.parquet(f"{d}/lineitem.parquet")
        con = duckdb.connect()
        for t in ("events", "lineitem"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
        assert [sorted(con.execute(sql.replace(order, f"{order}, player_x {way}")).fetchall()) for way in ("ASC", "DESC")] == [left, right]
        assert sorted(con.execute(sql).fetchall()) in (left, right)
        assert sorted(map(tuple, catalog.QUERIES[name](spark, d).select("clip_id", "spell_no", "team", "track_id", "observations").collect())) == left
