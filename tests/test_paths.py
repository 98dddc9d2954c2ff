"""The ball's trajectory against plain loops, on what the given tables make and on random tracks."""

import collections
import itertools
import math
import os
import random
import statistics

import pytest
from pyspark.sql import functions as F

from fieldtrace.operators import trajectory
from fieldtrace.plans import paths

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
CLIP = ["clip_id"]
POINT = "clip_id long, track_id long, source_frame long, clip_seconds double, x double, y double, confidence double, box_diagonal double, direct boolean, temporal_score double"
rng = random.Random(3)


def clips(df):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r["clip_id"]].append(r.asDict(recursive=True))
    return out


def far(a, b):
    return math.hypot(a["x"] - b["x"], a["y"] - b["y"])


def wandering(n, step=5, jumps=0.2, missing=0.1, one=True):
    """Points of a track that moves evenly, with jumps and gaps; some stand still."""
    rows = []
    for clip in range(n):
        x, y, vx, vy = rng.uniform(100, 900), rng.uniform(100, 400), rng.choice([0, 0, rng.uniform(-30, 30)]), rng.choice([0, 0, rng.uniform(-20, 20)])
        for i in range(40):
            x, y = x + vx + rng.uniform(-3, 3), y + vy + rng.uniform(-3, 3)
            if rng.random() < missing:
                continue
            jump = rng.random() < jumps
            dx, dy = (rng.uniform(-350, 350), rng.uniform(-200, 200)) if jump else (0, 0)
            rows.append((clip, 1, i * step, i * step / 25, x + dx, y + dy, round(rng.uniform(0.1, 1), 3), rng.choice([0.0, 6.0, 8.0]), not jump and rng.random() < 0.7, rng.choice([None, 0.5, 1.5])))
    return rows


def step_ok(last, before, c, speed, most=trajectory.ACCELERATION):
    if last is None:
        return True
    took = c["clip_seconds"] - last["clip_seconds"]
    if took <= 0 or far(c, last) / took > speed:
        return False
    if before is None:
        return True
    came = last["clip_seconds"] - before["clip_seconds"]
    v = [(c[k] - last[k]) / took - (last[k] - before[k]) / came for k in "xy"]
    return came > 0 and math.hypot(*v) / ((came + took) / 2) <= most


@pytest.mark.parametrize(("pause", "speed"), [(1.0, 900.0), (0.3, 250.0)])
def test_single(spark, pause, speed):
    table = paths.all_points(spark, DATA).cache()
    expected = set()
    for clip, rows in clips(table).items():
        tracks = collections.defaultdict(list)
        for r in rows:
            tracks[r["track_id"]].append(r)
        mean = {k: sum(r["confidence"] for r in v) / len(v) for k, v in tracks.items()}
        quality = {k: mean[k] * math.sqrt(len(v)) for k, v in tracks.items() if mean[k] >= 0.1}
        frames = collections.defaultdict(list)
        for r in sorted(rows, key=lambda r: r["track_id"]):
            if r["track_id"] in quality:
                frames[r["source_frame"]].append(r)
        kept = []
        for _, options in sorted(frames.items()):
            last, before = (kept[-1] if kept else None), (kept[-2] if len(kept) > 1 else None)
            own = [c for c in options if last and c["track_id"] == last["track_id"] and step_ok(last, before, c, speed)]
            if own:
                kept.append(own[0])
            elif not last or options[0]["clip_seconds"] - last["clip_seconds"] > pause:
                some = [c for c in options if not last or len(tracks[c["track_id"]]) >= 3]
                kept += [max(some, key=lambda c: (quality[c["track_id"]], c["confidence"]))] if some else []
            else:
                reach = lambda c: max(35.0, speed * (c["clip_seconds"] - last["clip_seconds"]))  # noqa: E731, B023
                some = [c for c in options if far(c, last) <= reach(c) and step_ok(last, before, c, speed)]  # noqa: B023
                kept += [max(some, key=lambda c: (quality[c["track_id"]] - far(c, last) / reach(c), c["confidence"]))] if some else []  # noqa: B023
        expected |= {(clip, r["source_frame"], r["track_id"]) for r in kept}
    got = {(r["clip_id"], r["source_frame"], r["track_id"]) for r in trajectory.single(table, CLIP, pause, speed).collect()}
    assert got == expected and len(expected) > 300 and (speed < 900 or {t >= 100 for *_, t in expected} == {True, False})


@pytest.mark.parametrize("speed", [900.0, 200.0])
def test_path_plausible(spark, speed):
    table = paths.all_points(spark, DATA).cache()
    trusted, others = clips(table.where("direct")), clips(table.where("NOT direct"))
    expected = collections.Counter()
    for clip, rows in others.items():
        own = sorted(trusted[clip], key=lambda r: (r["source_frame"], r["x"]))
        for r in rows:
            gap = lambda t: t["source_frame"] - r["source_frame"]  # noqa: E731, B023
            before, after = [t for t in own if -20 <= gap(t) < 0][-2:], [t for t in own if 0 < gap(t) <= 20][:2]
            path = [*before, r, *after]
            ok = len(path) > 1
            for k in range(1, len(path)):
                ok = ok and step_ok({**path[k - 1], "clip_seconds": path[k - 1]["source_frame"] / 25}, {**path[k - 2], "clip_seconds": path[k - 2]["source_frame"] / 25} if k > 1 else None, {**path[k], "clip_seconds": path[k]["source_frame"] / 25}, speed)
            expected[clip, r["source_frame"], r["track_id"], ok] += 1
    got = collections.Counter((r["clip_id"], r["source_frame"], r["track_id"], r["plausible"]) for r in trajectory.path_plausible(table.where("NOT direct"), table.where("direct"), CLIP, 5, 25.0, speed).collect())
    assert got == expected and min(sum(n for k, n in expected.items() if k[3] is v) for v in (True, False)) > 20


def excursion(p):
    for m in range(2, len(p) - 2):
        a, b, c, d, e = p[m - 2 : m + 3]
        sizes = [q["box_diagonal"] for q in (a, b, c, d, e) if q["box_diagonal"] > 0]
        size = statistics.median(sizes) if sizes else 1.0
        if c["direct"] or d["clip_seconds"] - b["clip_seconds"] > 2 or max(far(a, b), far(b, d), far(d, e)) > max(15, 3 * size) or d["source_frame"] <= b["source_frame"]:
            continue
        s = (c["source_frame"] - b["source_frame"]) / (d["source_frame"] - b["source_frame"])
        if math.hypot(*(c[k] - b[k] - (d[k] - b[k]) * s for k in "xy")) >= max(100, 10 * size):
            return m
    return None


def drops(rows, fps, speed, most):
    """A plain loop: one point of the first conflict goes, until there is none."""
    left, gone = sorted(rows, key=lambda r: (r["source_frame"], r["x"], r["y"])), []

    def velocity(a, b):
        t = (b["source_frame"] - a["source_frame"]) / fps
        return ((b["x"] - a["x"]) / t, (b["y"] - a["y"]) / t, t) if t > 0 else None

    def fits(a, b):
        v = velocity(a, b)
        return v is not None and math.hypot(*v[:2]) <= speed

    while len(left) > 1:
        found, why = None, None
        if (m := excursion(left)) is not None:
            found, why = (m - 1, m, m + 1), "return_excursion"
        for k in range(len(left) - 1) if found is None else ():
            v = velocity(left[k], left[k + 1])
            if v is None or math.hypot(*v[:2]) > speed:
                found, why = (k, k + 1), "time" if v is None else "speed"
                break
        for k in range(len(left) - 2) if found is None else ():
            v, u = velocity(left[k], left[k + 1]), velocity(left[k + 1], left[k + 2])
            if math.hypot(u[0] - v[0], u[1] - v[1]) / ((u[2] + v[2]) / 2) > most:
                found, why = (k, k + 1, k + 2), "acceleration"
                break
        if found is None:
            break
        if len(found) == 3 and fits(left[found[0]], left[found[2]]):
            k = found[1]
        else:
            helps = [i for i in found if i in (0, len(left) - 1) or fits(left[i - 1], left[i + 1])]
            k = min(helps or found, key=lambda i: (left[i]["confidence"], left[i]["temporal_score"] or 0.0))
        r = left.pop(k)
        gone.append((r["source_frame"], r["x"], why))
    return gone


@pytest.mark.parametrize(("speed", "most"), [(900.0, 12000.0), (300.0, 400.0)])
def test_repaired(spark, speed, most):
    rows = wandering(40) + wandering(1, jumps=0)
    rows += [(90, 1, 5, 0.2, 1.0, 1.0, 0.5, 5.0, True, None), (90, 1, 5, 0.2, 2.0, 1.0, 0.4, 5.0, True, None), (91, 1, 0, 0.0, 1.0, 1.0, 0.5, 5.0, True, None)]
    table = spark.createDataFrame(rows, POINT)
    got = trajectory.repaired(table, CLIP, 25.0, speed, most).collect()
    assert len(got) == len(rows)
    reasons = collections.Counter()
    for clip, own in clips(table).items():
        expected = drops(own, 25.0, speed, most)
        reasons.update(w for *_, w in expected)
        mine = sorted((r["drop_no"], r["source_frame"], r["x"], r["dropped_as"]) for r in got if r["clip_id"] == clip and r["dropped_as"])
        assert [r[1:] for r in mine] == expected and [r[0] for r in mine] == list(range(1, len(mine) + 1))
    assert set(reasons) >= {"return_excursion", "speed", "time"} and sum(reasons.values()) > 50
    with pytest.raises(ValueError):
        trajectory.repaired(table, CLIP, 0.0, speed)
    flagged = {(r["clip_id"], r["source_frame"]) for r in trajectory.return_excursions(table, CLIP).where("excursion").collect()}
    first = {(c, sorted(own, key=lambda r: r["source_frame"])[m]["source_frame"]) for c, own in clips(table).items() if len(own) > 4 and (m := excursion(sorted(own, key=lambda r: r["source_frame"]))) is not None}
    assert first and first <= flagged


def test_state_estimates_outside(spark):
    """Before the first and after the last point, within the frame, at most so fast; a clip without points has no states; points off the grid tell, but get no row."""
    points = spark.createDataFrame([(1, 1, f, f / 25, x, 50.0, 0.8, 4.0, d, None) for f, x, d in ((50, 100.0, True), (55, 120.0, False), (57, 130.0, True))] + [(2, 1, 10, 0.4, 5.0, 5.0, 0.4, 0.0, True, None)], POINT)
    frames = spark.createDataFrame([(c, f) for c in (1, 2, 3) for f in range(0, 105, 5)], "clip_id long, source_frame long")
    got = {(r["clip_id"], r["source_frame"]): r for r in trajectory.state_estimates(frames, points, CLIP, 25.0, 5, 140, 100, 50.0).collect()}
    assert {c for c, _ in got} == {1, 2} and len(got) == 42 and (1, 57) not in got
    assert got[1, 50]["state"] == "observed" and got[1, 55]["state"] == "visually_reacquired" and got[1, 55]["eligible"]
    last = got[1, 60]
    assert (last["state"], last["x"], last["confidence"], last["uncertainty"], last["eligible"]) == ("trajectory_estimated_forward", 136.0, round(0.49, 6), 6.4, False)
    assert got[1, 100]["x"] == 139.0 and got[1, 45]["state"] == "trajectory_estimated_backward" and got[2, 100]["x"] == 5.0
    assert got[1, 45]["confidence"] == 0.49 and got[1, 0]["confidence"] == round(0.8 * 0.8**10, 6)
    with pytest.raises(ValueError):
        trajectory.state_estimates(frames, points, CLIP, 25.0, 0, 140, 100, 50.0)


@pytest.mark.parametrize(("speed", "margin"), [(900.0, 0.08), (250.0, 0.0)])
def test_bridged(spark, speed, margin):
    rule = trajectory.Bridge(margin=margin)
    points = paths.points(spark, DATA).where("event_type IN ('click', 'view', 'purchase') AND user_id % 2 = 0")
    found = trajectory.gaps(points, CLIP, 5).cache()
    table = paths.candidates(spark, DATA).withColumn("score", F.col("visual_score")).cache()
    options = collections.defaultdict(list)
    for r in table.where(F.col("score") >= 0.5).collect():
        options[r["clip_id"], r["source_frame"]].append(r.asDict())
    worth = lambda r: r["score"] + 0.05 * r["attention"]
    expected = {}
    for g in found.collect():
        a, b = g["a"], g["b"]
        frames = list(range(int(a["source_frame"]) + 5, int(b["source_frame"]), 5))
        if b["source_frame"] - a["source_frame"] > 20 or len(frames) < 3:
            continue
        layers = []
        for f in frames:
            kept = []
            for r in sorted(options[g["clip_id"], f], key=lambda r: (-worth(r), r["candidate_no"])):
                if len(kept) < 6 and all(far(r, q) > 0.75 * (a["box_diagonal"] + b["box_diagonal"]) / 2 for q in kept):
                    kept.append(r)
            layers.append(kept)
        ranked = []
        for path in itertools.product(*layers):
            timed = [{"x": p["x"], "y": p["y"], "clip_seconds": p["source_frame"] / 25} for p in (a.asDict(), *path, b.asDict())]
            if all(step_ok(timed[k - 1], timed[k - 2] if k > 1 else None, timed[k], speed) for k in range(1, len(timed))):
                ranked.append((sum(map(worth, path)) - 0.08 * sum(p["mode"] != q["mode"] for p, q in zip(path, path[1:], strict=False)), [p["candidate_no"] for p in path]))
        ranked.sort(key=lambda p: -p[0])
        if ranked and (len(ranked) == 1 or ranked[0][0] - ranked[1][0] >= margin):
            expected[g["clip_id"], g["gap_no"]] = ranked[0]
    got = collections.defaultdict(list)
    for r in trajectory.bridged(table, found, CLIP, 5, 25.0, speed, rule=rule).orderBy("source_frame").collect():
        got[r["clip_id"], r["gap_no"]].append(r)
    assert len(expected) > 5 and set(got) == set(expected)
    for k, (score, path) in expected.items():
        assert abs(got[k][0]["path_score"] - score) < 1e-9 and (margin == 0 or [r["candidate_no"] for r in got[k]] == path)


def beam_by_hand(rows, history, fps, step, size, speed, rule):
    """Every path as a list of candidates."""
    seed = history[-1]
    recent = [h for h in history if seed[0] - h[0] <= round(rule.history * fps)]
    steps = [((q[1] - p[1]) * fps / (q[0] - p[0]), (q[2] - p[2]) * fps / (q[0] - p[0])) for p, q in zip(recent, recent[1:], strict=False)]
    vx, vy = (statistics.median(s[k] for s in steps) if steps else 0.0 for k in (0, 1))
    if math.hypot(vx, vy) > speed:
        vx, vy = vx * speed / math.hypot(vx, vy), vy * speed / math.hypot(vx, vy)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["source_frame"]].append(r)
    use, done = [], []
    for f in sorted(by):
        t = (f - seed[0]) / fps
        radius = min(max(size * rule.radius, 0.5 * size * rule.kick * t * t), speed * t + size * rule.radius)
        for c in by[f] if f <= seed[0] + round(rule.wait * fps) else ():
            out, off = math.hypot(c["x"] - seed[1], c["y"] - seed[2]), math.hypot(c["x"] - seed[1] - vx * t, c["y"] - seed[2] - vy * t)
            if out >= rule.launch * size and off <= radius and out <= speed * t:
                use.append(([c], c["visual_score"] - 0.03 * (f - seed[0] - 1) - off / max(1, radius), None))
    for f in sorted(by):
        grown = []
        for p, s, v in use:
            gap = f - p[-1]["source_frame"]
            if gap > max(1, round(rule.pause * fps)):
                done.append((p, s, v))
                continue
            grown.append((p, s, v))
            for c in by[f] if gap > 0 else ():
                u, reach = ((c["x"] - p[-1]["x"]) / gap, (c["y"] - p[-1]["y"]) / gap), speed * gap / fps
                if far(c, p[-1]) > reach:
                    continue
                if v and (math.hypot(u[0] - v[0], u[1] - v[1]) / gap > rule.acceleration / fps**2 or min(math.hypot(*u), math.hypot(*v)) > rule.moving and u[0] * v[0] + u[1] * v[1] < 0):
                    continue
                grown.append(([*p, c], s + c["visual_score"] - 0.8 * far(c, p[-1]) / max(1, reach) - 0.25 * (gap - 1), u))
        cells = {}
        for x in sorted(grown, key=lambda x: -x[1]):
            p, _, v = x
            cells.setdefault((p[-1]["source_frame"], round(p[-1]["x"] / 8), round(p[-1]["y"] / 8), *(round(w / 8) for w in v or (0, 0))), x)
        use = list(cells.values())[: rule.paths]
    done += use
    least = max(3, round(rule.flight * fps))
    long = [(p, s / len(p)) for p, s, _ in done if len(p) >= least and (n := p[-1]["source_frame"] - p[0]["source_frame"]) >= least - 1 and far(p[0], p[-1]) / (n / fps) >= rule.progress * size]
    if not long:
        return []
    last = max(p[-1]["source_frame"] for p, _ in long)
    long = sorted((x for x in long if x[0][-1]["source_frame"] == last), key=lambda x: -x[1])
    near = [p for p, s in long if s >= long[0][1] - rule.near][: rule.judges]
    out = []
    for f in sorted(by):
        own = [next((c for c in p if c["source_frame"] == f), None) for p in near]
        if f % step == 0 and all(own) and own[0]["visual_score"] >= rule.visual and all(far(c, own[0]) <= rule.agree * size for c in own):
            out.append((f, own[0]["x"], own[0]["y"], round(long[0][1], 6)))
    return out


@pytest.mark.parametrize("rule", [trajectory.Beam(), trajectory.Beam(paths=7, near=0.2, agree=2.0)])
def test_beam_consensus(spark, rule):
    points, rows, want = [], [], {}
    kind = "clip_id long, source_frame long, x double, y double, width double, height double, visual_score double"
    for clip in range(25):
        vx, vy = rng.uniform(6, 14), rng.uniform(-6, 6)
        at = lambda f: (300 + vx * f, 300 + vy * f)  # noqa: E731, B023
        history = [(f, *at(f)) for f in range(0, 35, 5)]
        points += [(clip, 1, f, f / 25, x, y, 0.9, 6.0, True, None) for f, x, y in history] + [(clip, 1, 75, 3.0, *at(75), 0.9, 6.0, True, None)]
        own = []
        for f in range(31, 75):
            for k in range(rng.randint(0, 4)):
                x, y = at(f)
                noise = 1.5 if k == 0 else rng.choice([3, 15, 80])
                own.append({"source_frame": f, "x": round(x + rng.uniform(-noise, noise), 3), "y": round(y + rng.uniform(-noise, noise), 3), "visual_score": round(rng.uniform(0.3, 1) + (0.2 if k == 0 else 0), 4)})
        own.sort(key=lambda r: (r["source_frame"], r["x"], r["y"]))
        rows += [(clip, r["source_frame"], r["x"], r["y"], 4.0, 5.0, r["visual_score"]) for r in own]
        for r in beam_by_hand(own, history, 25.0, 5, 6.0, 900.0, rule):
            want[clip, r[0]] = r[1:]
    got = trajectory.beam_consensus(spark.createDataFrame(rows, kind), spark.createDataFrame(points, POINT), CLIP, 5, 25.0, 900.0, rule).collect()
    assert {(r["clip_id"], r["source_frame"]): (r["x"], r["y"], r["temporal_score"]) for r in got} == want and len(want) > 30


def test_decisive(spark):
    rows = spark.createDataFrame([(4, 1.0, 1, 0.2, True), (3, 1.0, 1, 0.2, False), (4, 0.9, 1, 0.2, False)], "a long, b double, c long, d double, want boolean")
    assert rows.where(trajectory.decisive((F.col("a"), F.col("b")), (F.col("c"), F.col("d"))) == F.col("want")).count() == 3
