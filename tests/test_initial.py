"""Kits, keepers, sides and officials against a plain loop, with clips that abstain."""

import collections
import itertools
import math
import random
import statistics

from pyspark.sql import functions as F

from fieldtrace.operators import initial, rules

CLIP = ["clip_id"]
KIND = "clip_id long, track_id long, sample_count long, duration_seconds double, b int, g int, r int, positions array<struct<x:double,y:double>>"
rng = random.Random(8)


def tracks_of(clip):
    """Tracks of one clip: two kits (at times alike, or with too few players), keepers, officials and strays."""
    alike, few = clip % 6 == 4, clip % 6 == 5
    kits = [(35, 35, 190), (40, 40, 180) if alike else (170, 70, 25)]
    rows, number = [], itertools.count(1)

    def add(color, x, y, n=None, seconds=None):
        n = n or rng.randint(3, 12)
        spots = [(min(1.0, max(0.0, rng.gauss(*x))), min(1.0, max(0.0, rng.gauss(*y)))) for _ in range(n)]
        b, g, r = (min(255, max(0, c + rng.randint(-12, 12))) for c in color)
        rows.append((clip, next(number), n, seconds or round(rng.uniform(1.6, 30), 2), b, g, r, spots))

    for k in range(2 if few else 12):
        add(kits[k % 2], (0.35 if k % 2 else 0.6, 0.08), (0.5, 0.2))
    add((40, 210, 220), (0.06, 0.01), (0.5, 0.02), seconds=20.0)
    add((220, 220, 220), (0.95, 0.01 if clip % 4 else 0.2), (0.5, 0.02), seconds=12.0)
    add((45, 140, 45), (0.95, 0.02), (0.5, 0.02), seconds=9.0)
    add((10, 10, 10), (0.5, 0.05), (0.5, 0.05), seconds=15.0)
    add((25, 25, 25), (0.5, 0.3), (0.5, 0.3), n=2)
    rng.shuffle(rows)
    return rows


def lab_of(spark, colors):
    table = spark.createDataFrame(sorted(colors), "b int, g int, r int")
    out = table.select("b", "g", "r", *[c.alias(n) for n, c in zip("xyz", rules.lab(F.col("b"), F.col("g"), F.col("r")), strict=True)])
    return {(r["b"], r["g"], r["r"]): (r["x"], r["y"], r["z"]) for r in out.collect()}


def color(t):
    return t["b"], t["g"], t["r"]


def weighted(group, values):
    w = [min(20.0, max(1.0, t["duration_seconds"])) for t in group]
    return tuple(sum(a * b for a, b in zip(w, [v[k] for v in values], strict=True)) / sum(w) for k in range(3))


def split(tracks, lab):
    some = sorted((t for t in tracks if t["sample_count"] >= 3 and t["duration_seconds"] >= 1.5), key=lambda t: t["track_id"])
    best = None
    for a, b in itertools.combinations(some, 2) if len(some) >= 4 else ():
        x, y = lab[color(a)], lab[color(b)]
        if math.dist(x, y) < 18:
            continue
        sides = [[t for t in some if (math.dist(lab[color(t)], x) <= math.dist(lab[color(t)], y)) is first] for first in (True, False)]
        if min(map(len, sides)) < 2:
            continue
        centers = [weighted(s, [lab[color(t)] for t in s]) for s in sides]
        within = sum(math.dist(lab[color(t)], c) for s, c in zip(sides, centers, strict=True) for t in s) / len(some)
        score = math.dist(*centers) * min(map(len, sides)) / max(map(len, sides)) / (1 + within)
        if best is None or score > best[0] + 1e-12:
            best = score, sides, centers
    if best is None:
        return None
    out = []
    for s, c in zip(*best[1:], strict=True):
        far = [math.dist(lab[color(t)], c) for t in s]
        out.append([t for t, f in zip(s, far, strict=True) if f <= max(18, min(55, statistics.median(far) * 2.5))])
    return out if min(map(len, out)) >= 2 else None


def test_initialization(spark):
    rows = [r for clip in range(24) for r in tracks_of(clip)]
    tracks = spark.createDataFrame(rows, KIND).cache()
    clips = spark.createDataFrame([(c, 1 + c % 2, 0.0, c % 5 != 3) for c in range(26)], "clip_id long, half int, source_start_seconds double, starts_at_kickoff boolean")
    got = {r["clip_id"]: r for r in initial.initialization(clips, tracks, CLIP).collect()}
    assert len(got) == 26
    by = collections.defaultdict(list)
    for r in tracks.collect():
        by[r["clip_id"]].append(r.asDict(recursive=True))
    lab = lab_of(spark, {color(t) for own in by.values() for t in own} | {tuple(round(v) for v in weighted(s, [color(t) for t in s])) for own in by.values() for s in split(own, lab_of(spark, {color(t) for t in own})) or ()} | set(initial.KITS.values()))
    seen = collections.Counter()
    for clip in range(26):
        sides, r = split(by[clip], lab), got[clip]
        teams = {}
        if sides:
            centers = [tuple(round(v) for v in weighted(s, [color(t) for t in s])) for s in sides]
            apart, far = math.dist(*(lab[c] for c in centers)), [math.dist(lab[color(t)], lab[c]) for s, c in zip(sides, centers, strict=True) for t in s]
            sure = round(min(1, apart / (apart + statistics.median(far) + 1e-6) * min(map(len, sides)) / max(map(len, sides))), 3)
            names = [min(sorted(initial.KITS), key=lambda n: math.dist(lab[c], lab[initial.KITS[n]])) for c in centers]  # noqa: B023
            names = ["team_a", "team_b"] if names[0] == names[1] else names
            if sure >= 0.42:
                teams = {n: (c, sorted(t["track_id"] for t in s), sure) for n, c, s in zip(names, centers, sides, strict=True)}
        assert {t["team"]: ((t["color"]["b"], t["color"]["g"], t["color"]["r"]), t["track_ids"], t["confidence"]) for t in r["teams"]} == teams
        if not teams:
            assert (r["status"], r["abstention_reasons"], r["directions"], r["goalkeepers"], r["official_track_ids"]) == ("abstained", [initial.NO_TEAMS], [], [], [])
            seen["abstained"] += 1
            continue
        team_of = {k: n for n, (_, ids, _) in teams.items() for k in ids}
        middles = sorted((statistics.median(p["x"] for t in by[clip] if team_of.get(t["track_id"]) == n for p in t["positions"]), n) for n in teams)
        stands = {"left": middles[0][1], "right": middles[1][1]} if middles[1][0] - middles[0][0] >= 0.08 else {}
        keepers = {}
        for t in sorted(by[clip], key=lambda t: t["track_id"]):
            xs = [p["x"] for p in t["positions"]]
            left, right = sum(x <= 0.24 for x in xs), sum(x >= 0.76 for x in xs)
            side, share = ("left", left / len(xs)) if left >= right and left else ("right", right / len(xs)) if right else (None, 0)
            look = min(math.dist(lab[color(t)], lab[c]) for c, *_ in teams.values())
            if t["track_id"] in team_of or t["duration_seconds"] < 6 or share < 0.6 or look < 24:
                continue
            score = 0.55 * share * max(0, 1 - (max(xs) - min(xs)) / 0.35) + 0.45 * min(1, look / 70)
            if score >= 0.58 and score > keepers.get(side, (0,))[0]:
                keepers[side] = score, t["track_id"]
        assert {(k["side"], k["track_id"], k["team"], k["confidence"]) for k in r["goalkeepers"]} == {(s, t, stands.get(s), round(c, 3)) for s, (c, t) in keepers.items()}
        kept = {t for _, t in keepers.values()}
        central = [t["track_id"] for t in by[clip] if t["track_id"] not in team_of and t["track_id"] not in kept and t["duration_seconds"] >= 4 and sum(0.2 < p["x"] < 0.8 and 0.15 < p["y"] < 0.9 for p in t["positions"]) >= 0.55 * len(t["positions"])]
        assert r["official_track_ids"] == sorted(central)
        whole = len(keepers) == 2 and len(stands) == 2
        reasons = [initial.NO_KICKOFF] if not r["starts_at_kickoff"] else [] if whole else [initial.NO_KEEPERS]
        assert (r["status"], r["abstention_reasons"]) == ("partial" if reasons else "complete", reasons)
        assert [(d["team"], d["defends_goal"], d["attacks_towards"]) for d in r["directions"]] == ([] if reasons else sorted((stands[s], s, "right" if s == "left" else "left") for s in ("left", "right")))
        seen[r["status"]] += 1
        seen["officials"] += bool(central)
    assert min(seen[k] for k in ("abstained", "partial", "complete", "officials")) > 1


def test_side_switch(spark):
    team = "team string, defends_goal string, attacks_towards string, confidence double"
    row = lambda m, h, *d: (m, h, [(t, g, "x", 0.9) for t, g in d])
    rows = [row(1, 1, ("a", "left"), ("b", "right")), row(1, 2, ("a", "right"), ("b", "left")), row(2, 1, ("a", "left"), ("b", "right")), row(2, 2, ("a", "left"), ("b", "right"))]
    rows += [row(3, 1, ("a", "left"), ("b", "right")), row(3, 2, ("a", "left"), ("c", "right")), row(4, 1, ("a", "left"), ("b", "right")), row(4, 2), row(5, 2, ("a", "left"), ("b", "right"))]
    halves = spark.createDataFrame(rows, f"match_id long, half int, directions array<struct<{team.replace(' ', ':').replace(',:', ',')}>>")
    assert {r["match_id"]: r["side_switch_detected"] for r in initial.side_switch(halves, ["match_id"]).collect()} == {1: True, 2: False, 3: None, 4: None, 5: None}
