"""Rules on inferred events against plain loops and worked cases."""

import pytest
from pyspark.sql import functions as F

from fieldtrace.operators import rules
from fieldtrace.operators.control import NAMES

K = ["clip_id"]
KIND = "clip_id long, clip_seconds double, completion_seconds double, event_type string, team string, from_track long, to_track long, confidence double"


def told(rows):
    return sorted((r["clip_id"], r["clip_seconds"], r["to_track"]) for r in rows)


def test_one_reception(spark):
    p = "pass_candidate"
    rows = [(1, 0.0, 1.0, p, "red", 1, 2, 0.5), (1, 0.1, 1.3, p, "red", 1, 3, 0.7), (1, 0.2, 1.6, p, "red", 1, 4, 0.6), (1, 0.3, 1.7, p, "red", None, 5, 0.9), (1, 0.4, 1.75, p, "black", 1, 6, 0.9), (1, 0.5, 1.2, "turnover_candidate", "red", 1, 7, 0.9), (1, 0.6, 2.2, p, "red", 1, 8, 0.6)]
    kept = []
    for e in sorted(rows, key=lambda e: e[2]):
        at = next((k for k, q in enumerate(kept) if e[3] == q[3] == p and e[4] == q[4] and e[5] is not None and e[5] == q[5] and abs(e[2] - q[2]) <= 0.5), None)
        if at is None:
            kept.append(e)
        elif e[7] > kept[at][7]:
            kept[at] = e
    got = rules.one_reception(spark.createDataFrame(rows, KIND), K).collect()
    assert told(got) == sorted((e[0], e[1], e[6]) for e in kept) and len(kept) == 5


def test_unreturned_passes(spark):
    p = "pass_candidate"
    rows = [(1, 0.0, 1.0, p, "red", 1, 2, 0.5), (1, 2.0, 1.9, p, "red", 2, 1, 0.5), (1, 5.0, 4.9, p, "red", 3, 4, 0.5), (1, 5.0, 4.9, "turnover_candidate", "red", 3, 5, 0.5), (1, 9.0, 8.0, p, "red", 2, 1, 0.5)]
    assert told(rules.without_unreturned(spark.createDataFrame(rows, KIND), K).collect()) == [(1, 0.0, 2), (1, 2.0, 1), (1, 5.0, 5)]


def test_openings(spark):
    p = "pass_candidate"
    rows = [(1, 0.0, 1.0, p, "red", 1, 2, 0.4), (1, 0.5, None, p, "red", 2, 3, 0.5), (1, 6.0, 7.0, p, "red", 3, 4, 0.6), (2, 0.0, 1.0, p, "red", 1, 2, 0.4), (2, 3.0, 4.0, p, "red", 2, 3, 0.9), (3, 0.0, 1.0, p, "red", 1, 2, 0.4)]
    assert told(rules.without_startup(spark.createDataFrame(rows, KIND), K).collect()) == [(1, 6.0, 4), (2, 0.0, 2), (2, 3.0, 3), (3, 0.0, 2)]
    assert NAMES[0] == "clip_seconds"


def test_lab(spark):
    """White, black and the primaries have published values."""
    known = {(255, 255, 255): (255, 128, 128), (0, 0, 0): (0, 128, 128), (0, 0, 255): (136, 208, 195), (0, 255, 0): (224, 42, 211), (255, 0, 0): (82, 207, 20)}
    df = spark.createDataFrame([tuple(float(v) for v in c) for c in known], "b double, g double, r double")
    got = [tuple(r) for r in df.select(*[c.alias(n) for c, n in zip(rules.lab(F.col("b"), F.col("g"), F.col("r")), "xyz", strict=True)]).collect()]
    assert got == [pytest.approx(v, abs=1) for v in known.values()]
    palette = {"red": (35, 35, 190), "blue": (170, 70, 25), "white": (220, 220, 220)}
    assert [r[0] for r in df.select(rules.nearest_name(F.col("b"), F.col("g"), F.col("r"), palette)).collect()][::2] == ["white", "red", "blue"]
