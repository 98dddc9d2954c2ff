"""Goal faces against linear systems solved by numpy, shots, changes of detections and slowed transfers against plain loops."""

import collections
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtrace.operators import goals, scoring, shots, tracks
from fieldtrace.plans import measures, paths, play

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
CLIP = ["clip_id"]


def along(p, line):
    line = line if line[0][1] <= line[-1][1] else line[::-1]
    best, before = (math.inf, 0.0), 0.0
    for a, b in zip(line, line[1:], strict=False):
        d = np.subtract(b, a)
        t = min(1.0, max(0.0, float(np.dot(np.subtract(p, a), d)) / float(d @ d)))
        off = math.dist(p, np.add(a, t * d))
        if off < best[0]:
            best = off, before + t * float(np.hypot(*d))
        before += float(np.hypot(*d))
    return best


def solved(image):
    """The homography from image to goal by a linear system."""
    world = [(goals.LOW, 0.0), (goals.HIGH, 0.0), (goals.HIGH, goals.BAR), (goals.LOW, goals.BAR)]
    rows, right = [], []
    for (x, y), (u, v) in zip(image, world, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1.0).reshape(3, 3)


def shown(m, p):
    w = m @ np.array([*p, 1.0])
    return w[:2] / w[2]


def calibrated(polygon, line):
    if len(polygon) != 4:
        return "goal mouth needs four corners"
    ranked = sorted(polygon, key=lambda p: along(p, line)[0])
    bases, bars = sorted(ranked[:2], key=lambda p: along(p, line)[1]), ranked[2:]
    if max(along(p, line)[0] for p in bases) > 15:
        return "post base is off the goal line"
    own = [min(bars, key=lambda q: math.dist(p, q)) for p in bases]  # noqa: B023
    if own[0] == own[1]:
        return "crossbar ends cannot be paired to posts"
    if any(q[1] >= p[1] for p, q in zip(bases, own, strict=True)):
        return "crossbar corner is below its post base"
    image = [*bases, own[1], own[0]]
    m, probes, worst = solved(image), [*image, tuple(np.mean(image, axis=0))], 0.0
    for k in range(4):
        for dx, dy in ((4, 0), (-4, 0), (0, 4), (0, -4)):
            moved = list(image)
            moved[k] = image[k][0] + dx, image[k][1] + dy
            h = solved(moved)
            worst = max(worst, *(math.dist(shown(h, p), shown(m, p)) for p in probes))
    return image, m, worst + 0.25


def test_goal_faces(spark):
    xy = lambda ps: [(p["x"], p["y"]) for p in ps]
    given = paths.cameras(spark, DATA)
    extra = [(900, "left", [(0.0, 100.0), (50.0, 100.0), (52.0, 60.0), (53.0, 60.0)], [(-10.0, 100.0), (90.0, 100.0)]), (901, "right", [(0.0, 100.0), (50.0, 130.0), (50.0, 60.0), (0.0, 50.0)], [(60.0, 136.0), (-10.0, 94.0)]), (902, "left", None, None)]
    given = given.unionByName(spark.createDataFrame(extra, "camera_id long, side string, polygon array<struct<x:double,y:double>>, goal_line array<struct<x:double,y:double>>"))
    reasons = collections.Counter()
    for r in goals.goal_faces(given).collect():
        want = "goal mouth needs four corners" if r["polygon"] is None else calibrated(xy(r["polygon"]), xy(r["goal_line"]))
        reasons[want if isinstance(want, str) else "ok"] += 1
        if isinstance(want, str):
            assert (r["rejected_as"], r["matrix"], r["uncertainty"]) == (want, None, None)
            continue
        assert r["rejected_as"] is None and xy(r["corners"]) == want[0] and r["uncertainty"] == pytest.approx(want[2], rel=1e-6)
        for p in [*want[0], (12.0, 34.0)]:
            m = np.array(r["matrix"]).reshape(3, 3)
            assert shown(m, p) == pytest.approx(shown(want[1], p), rel=1e-6, abs=1e-6)
        assert r["goal_line_x"] == (0.0 if r["side"] == "left" else 105.0) and (r["post_low"], r["post_high"]) == (30.34, 37.66)
    assert len(reasons) >= 4 and reasons["ok"] > 5


def test_image_distance(spark):
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 4.0), (0.0, 4.0)]
    rows = spark.createDataFrame([(square, (5.0, 1.0), -1.0), (square, (5.0, 7.0), 3.0), (square, (13.0, 8.0), 5.0), (square, (10.0, 2.0), 0.0)], "c array<struct<x:double,y:double>>, p struct<x:double,y:double>, want double")
    assert [r[0] for r in rows.select(F.abs(goals.image_distance(F.col("p"), F.col("c")) - F.col("want")) < 1e-9).collect()] == [True] * 4
    seen = collections.Counter(r["face"] for r in paths.calibrated_faces(spark, DATA).collect())
    assert set(seen) >= {"outside", "ambiguous"}


def rows_of(df):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r["clip_id"]].append(r.asDict(recursive=True))
    return out


def test_shot_events(spark):
    """Debounced steps, none before a spell of its receiver, with the team of the last event, else of the last spell."""
    found = tracks.debounced(measures.shot_steps(spark, DATA).select("clip_id", "clip_seconds", "speed"), CLIP, 2.0)
    spells, prior, steps = rows_of(play.controlled(spark, DATA)), rows_of(play.control_transfers(spark, DATA)), rows_of(found)
    want = []
    for clip, own in steps.items():
        for s in own:
            t = s["clip_seconds"]
            if any(x["spell"]["observations"] >= 2 and 0 <= x["spell"]["start_seconds"] - t <= 0.1 for x in spells[clip]):
                continue
            told = [e for e in prior[clip] if e["team"] in ("red", "black") and 0 <= t - e["clip_seconds"] <= 3]
            held = [x["spell"] for x in spells[clip] if 0 <= t - x["spell"]["end_seconds"] <= 3]
            team = None
            if told:
                last = max(told, key=lambda e: e["clip_seconds"])
                team, track = last["team"], last["to_track"] if last["to_track"] is not None else last["from_track"]
            elif held:
                last = max(held, key=lambda x: x["end_seconds"])
                team, track = last["team"], last["track_id"]
            want.append((clip, round(t, 3), team, None if team is None else track, round(min(0.95, 0.45 + s["speed"] / 1200), 4)))
    got = shots.events(found, play.controlled(spark, DATA), play.control_transfers(spark, DATA), CLIP, ["red", "black"], receiver=0.1).collect()
    order = lambda r: (r[0], r[1])
    got = sorted(((r["clip_id"], r["clip_seconds"], r["team"], r["from_track"], r["confidence"]) for r in got), key=order)
    assert [g[:4] for g in got] == [w[:4] for w in sorted(want, key=order)] and len(want) > 3
    assert [g[4] for g in got] == pytest.approx([w[4] for w in sorted(want, key=order)], abs=2e-4)


def test_detection_changes(spark):
    found = measures.detected_with_key(spark, DATA)
    before, after = found.where("confidence < 0.5"), found.where("confidence >= 0.5")
    frames = collections.defaultdict(lambda: ([], []))
    for k, df in enumerate((before, after)):
        for r in df.collect():
            frames[r["clip_id"], r["source_frame"]][k].append(r)
    want = {}
    for key, (a, b) in frames.items():
        free, matched = list(b), 0
        pairs = sorted((math.hypot(p["x"] - q["x"], p["y"] - q["y"]), p["box_no"], q["box_no"]) for p in a for q in b)
        # Each box of before in the order of its number takes its nearest free one.
        for p in sorted(a, key=lambda r: r["box_no"]):
            near = [(d, q) for d, n, q in pairs if n == p["box_no"] and d <= 60 and any(f["box_no"] == q for f in free)]
            if near:
                matched += 1
                free = [f for f in free if f["box_no"] != min(near)[1]]
        status = "GAINED" if not a else "MISSING" if not b else "MATCH" if matched == len(a) == len(b) else "CHANGED"
        want[key] = len(a), len(b), matched, status
    got = {(r["clip_id"], r["source_frame"]): (r["before"], r["after"], r["matched"], r["status"]) for r in scoring.detection_changes(before, after, CLIP, 60.0).collect()}
    assert got == want and {w[3] for w in want.values()} == {"GAINED", "MISSING", "MATCH", "CHANGED"}
