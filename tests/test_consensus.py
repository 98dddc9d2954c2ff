"""Agreement of detections and restored points against plain loops."""

import collections
import math
import os
import random

import pytest

from fieldtrace.operators import consensus
from fieldtrace.plans import paths

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
CLIP = ["clip_id"]
rng = random.Random(4)


def groups_of(rows, radius, weight):
    groups = []
    for d in sorted(rows, key=lambda r: (-r["score"], r["x"], r["y"])):
        for group in groups:
            w = sum(weight(r) for r in group)
            if math.hypot(d["x"] - sum(r["x"] * weight(r) for r in group) / w, d["y"] - sum(r["y"] * weight(r) for r in group) / w) <= radius:
                group.append(d)
                break
        else:
            groups.append([d])
    return groups


def by_keys(df, *names):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[tuple(r[n] for n in names)].append(r.asDict())
    return out


def test_consensus(spark):
    made = [(c, n, str(rng.randint(0, 4)), rng.gauss(100, 10), rng.gauss(50, 10), round(rng.uniform(0.1, 1), 3), 100.0, 50.0, 6.0, 9.0) for c in range(60) for n in range(rng.randint(0, 14))]
    made += [(99, 0, "a", 1.0, 1.0, 0.5, 1.0, 1.0, 0.0, 9.0), (98, 0, "a", 5.0, 5.0, 0.5, 1.0, 1.0, 6.0, 9.0), (98, 1, "a", 5.0, 5.0, 0.5, 1.0, 1.0, 6.0, 9.0)]
    own = spark.createDataFrame(made, "clip_id long, no long, variant string, x double, y double, score double, expected_x double, expected_y double, diameter double, radius double").selectExpr("*", "0L AS sample")
    for table, keys in ((own, ["clip_id", "sample"]), (paths.spots(spark, DATA).selectExpr("*"), ["clip_id", "sample"])):
        table = table.cache()
        first, second = {}, {}
        for key, rows in by_keys(table, *keys).items():
            e, size = (rows[0]["expected_x"], rows[0]["expected_y"]), rows[0]["diameter"]
            near = [r for r in rows if math.dist((r["x"], r["y"]), e) <= 7 * size] if size > 0 else []
            middle = lambda q: (sum(r["x"] for r in q) / len(q), sum(r["y"] for r in q) / len(q))
            good = [q for q in groups_of(near, 1.5 * size, lambda r: 1.0) if len({r["variant"] for r in q}) >= 3]
            if good:
                first[key] = {r["no"] for r in max(good, key=lambda q: (-math.dist(middle(q), e), len({r["variant"] for r in q}), sum(r["score"] for r in q)))}  # noqa: B023
            second[key] = {r["no"] for r in max(groups_of(rows, 9.0, lambda r: r["score"]), key=lambda q: (len(q), sum(r["score"] for r in q)))}
        told = lambda df: {k: {r["no"] for r in v} for k, v in by_keys(df, *keys).items()}  # noqa: B023, E731
        assert told(consensus.variant_consensus(table, keys)) == first and len(first) > 10
        assert told(consensus.weighted_consensus(table.drop("variant"), keys)) == second


def round_even(v):
    return round(v)


def test_restored(spark):
    spots, sure = paths.detector_spots(spark, DATA).cache(), paths.trusted_spots(spark, DATA).cache()
    cell = lambda r: (round_even(r["x"] / 20), round_even(r["y"] / 20))
    want = set()
    trust = by_keys(sure, "clip_id")
    for (clip,), rows in by_keys(spots, "clip_id").items():
        own = sorted(trust[clip,], key=lambda r: r["source_frame"])
        feet, back, held = collections.defaultdict(set), collections.defaultdict(set), collections.Counter(cell(t) for t in own if t["direct"])
        for r in rows:
            back[cell(r)].add(r["source_frame"])
            if r["near_feet"]:
                feet[cell(r)].add(r["source_frame"])
        confirmed = {c for c in feet if len(feet[c]) >= 2 and held[c] >= 3 and len(back[c]) >= 2}
        seen = {t["source_frame"] for t in own}
        for (frame,), some in by_keys(spots.where(f"clip_id = {clip}"), "source_frame").items():
            if frame in seen:
                continue
            hits = [r for r in some if cell(r) in confirmed]
            if len(hits) == 1:
                want.add((clip, frame, hits[0]["track_id"], "anchor"))
            elif len(some) == 1:
                gap = [t["source_frame"] - frame for t in own]
                if not (any(abs(d) <= 5 for d in gap) or any(-20 <= d < 0 for d in gap) and any(0 < d <= 20 for d in gap)):
                    continue
                path = [*[t for t in own if -20 <= t["source_frame"] - frame < 0][-2:], some[0], *[t for t in own if 0 < t["source_frame"] - frame <= 20][:2]]
                legs = [((b["source_frame"] - a["source_frame"]) / 25, b["x"] - a["x"], b["y"] - a["y"]) for a, b in zip(path, path[1:], strict=False)]
                ok = all(math.hypot(x, y) / t <= 900 for t, x, y in legs) and all(math.hypot(q[1] / q[0] - p[1] / p[0], q[2] / q[0] - p[2] / p[0]) / ((p[0] + q[0]) / 2) <= 12000 for p, q in zip(legs, legs[1:], strict=False))
                if ok:
                    want.add((clip, frame, some[0]["track_id"], "path"))
    got = {(r["clip_id"], r["source_frame"], r["track_id"], r["restored_as"]) for r in consensus.restored(spots, sure, CLIP, 5, 25.0, 900.0).collect()}
    kinds = collections.Counter(k for *_, k in want)
    assert got == want and min(kinds["anchor"], kinds["path"]) > 5
