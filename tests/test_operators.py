"""Cases worked out by hand, and operators that SQL cannot express against plain loops."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from fieldtrace.functions import geometry as g
from fieldtrace.operators import blocks, frames, joins, reports, tracks
from fieldtrace.streaming import replay, windows

K = ["clip_id"]


def test_windows_of_a_minute(spark):
    got = windows.replay_windows(spark.createDataFrame([(1, 60.0)], "clip_id long, duration double"), 20.0, 2.0).orderBy("index").collect()
    assert [(r["window_start"], r["window_end"]) for r in got] == [(0, 20), (18, 38), (36, 56), (54, 60)]


def test_duplicates_of_overlapping_windows(spark):
    events = spark.createDataFrame([(1, "a", 19.0), (1, "b", 40.0)], "clip_id long, event_key string, clip_seconds double")
    clips = spark.createDataFrame([(1, 60.0)], "clip_id long, duration double")
    got = windows.deduplicated(events, clips, K, "event_key", 20.0, 2.0).agg(F.sum("new_events"), F.sum("duplicates")).first()
    assert tuple(got) == (2, 1)


def test_one_boundary_interval(spark):
    points = [(1, k, k * 0.2, x, 50.0) for k, x in enumerate([50.0, 120.0, 125.0, 130.0, 50.0])]
    df = spark.createDataFrame(points, "clip_id long, source_frame long, clip_seconds double, x double, y double")
    (one,) = tracks.boundary_intervals(df, K, [(0, 0), (100, 0), (100, 100), (0, 100)], 5.0, 0.4).collect()
    assert (one["start_seconds"], round(one["end_seconds"], 6), one["resumed_seconds"], one["starts_outside"]) == (0.2, 0.6, 0.8, False)
    assert one["minimum_signed_distance"] == pytest.approx(-30)


def test_block_metrics(spark):
    seen = spark.createDataFrame([(1, 0.1, "blue"), (1, 0.2, "white"), (1, 0.3, "blue")], "clip_id long, clip_seconds double, team string")
    share = {r["team"]: r["possession_percent"] for r in blocks.possession_share(seen, K, 300.0).collect()}
    assert share == {"blue": 66.7, "white": 33.3}
    points = spark.createDataFrame([(1, 7, 0.0, 10.0, 10.0), (1, 7, 1.0, 13.0, 14.0)], "clip_id long, track_id long, clip_seconds double, x_metres double, y_metres double")
    (one,) = blocks.player_metrics(points, K, 300.0, 2.0).collect()
    assert (one["distance_metres"], one["maximum_speed"], one["sample_count"]) == (5.0, 5.0, 2)


def test_one_pass_between_spells(spark):
    rows = [(1, 0, 0.0, "blue", 1, 100.0), (1, 1, 0.1, "blue", 1, 102.0), (1, 10, 1.0, "blue", 2, 300.0), (1, 11, 1.1, "blue", 2, 302.0)]
    df = spark.createDataFrame(rows, "clip_id long, source_frame long, clip_seconds double, team string, track_id long, x double")
    (one,) = tracks.transfers(tracks.spells(df, K, 0.64), K, 3.0).collect()
    assert (one["event_type"], one["from_track"], one["to_track"]) == ("pass_candidate", 1, 2)


def test_comparison_of_events(spark):
    schema = "clip_id long, event_no long, seconds double, event_type string, team string"
    manual = spark.createDataFrame([(1, 1, 5.1, "completed_pass", "red"), (1, 2, 8.0, "turnover", "black")], schema)
    predicted = spark.createDataFrame([(1, 1, 5.0, "completed_pass", "red"), (1, 2, 8.1, "turnover", "red")], schema)
    assert [(r["manual_no"], r["predicted_no"]) for r in reports.aligned(manual, predicted, K, 0.25).collect()] == [(1, 1)]


def test_whole_comparison_of_events(spark):
    schema = "clip_id long, event_no long, seconds double, event_type string, team string"
    manual = [(1, 1, 5.0, "completed_pass", "red"), (1, 2, 10.0, "completed_pass", "red"), (1, 3, 20.0, "turnover", "black"), (1, 4, 40.0, "turnover", "red")]
    predicted = [(1, 11, 5.5, "completed_pass", "red"), (1, 12, 12.5, "completed_pass", "red"), (1, 13, 20.25, "turnover", "red"), (1, 14, 60.0, "completed_pass", "black")]
    out = reports.event_comparison(spark.createDataFrame(manual, schema), spark.createDataFrame(predicted, schema), K, 1.0, 3.0, ["red", "black"], ["completed_pass", "turnover"]).collect()
    of = lambda kind, *columns: sorted(tuple(r[c] for c in columns) for r in out if r["kind"] == kind)
    assert of("match", "manual_no", "predicted_no", "difference") == [(1, 11, 0.5)]
    assert of("review_match", "manual_no", "predicted_no", "difference") == [(2, 12, 2.5)]
    assert of("unmatched_manual", "manual_no") == [(2,), (3,), (4,)]
    assert of("unmatched_predicted", "predicted_no") == [(12,), (13,), (14,)]
    assert of("unresolved_manual", "manual_no") == [(3,), (4,)]
    assert of("nearby_disagreement", "manual_no", "predicted_no", "difference") == [(3, 13, 0.25)]
    counts = of("count", "team", "event_type", "n_manual", "n_predicted", "n_matched", "n_review")
    assert counts == [("black", "completed_pass", 0, 1, 0, 0), ("black", "turnover", 1, 0, 0, 0), ("red", "completed_pass", 2, 2, 1, 1), ("red", "turnover", 1, 1, 0, 0)]


def test_alignment_against_all_choices(spark):
    rng = random.Random(2)
    schema = "clip_id long, event_no long, seconds double, event_type string, team string"
    sides = [[(c, k, round(rng.random() * 4, 2), "p", rng.choice("ab")) for c in range(12) for k in range(5)] for _ in range(2)]
    got = reports.aligned(*(spark.createDataFrame(s, schema) for s in sides), K, 0.8).collect()
    for c in range(12):
        a, b = (sorted((r for r in s if r[0] == c), key=lambda r: (r[2], r[1])) for s in sides)
        best = (0, 0.0)
        for n in range(1, 6):
            for i in itertools.combinations(range(5), n):
                for j in itertools.combinations(range(5), n):
                    pairs = [(a[x], b[y]) for x, y in zip(i, j, strict=True)]
                    if all(abs(p[2] - q[2]) <= 0.8 and p[4] == q[4] for p, q in pairs):
                        best = max(best, (n, -sum(abs(p[2] - q[2]) for p, q in pairs)))
        mine = [r for r in got if r["clip_id"] == c]
        assert (len(mine), -sum(r["difference"] for r in mine)) == pytest.approx(best)


def test_suppression(spark):
    rng = random.Random(4)
    rows = [(1, f, "person", round(rng.random(), 2), *(lambda x, y: (x, y, x + rng.randint(5, 30), y + rng.randint(5, 30)))(float(rng.randint(0, 60)), float(rng.randint(0, 60))), k) for f in range(6) for k in range(15)]
    df = spark.createDataFrame([(*r[:6], float(r[6]), float(r[7]), r[8]) for r in rows], "clip_id long, source_frame long, class_name string, confidence double, x1 double, y1 double, x2 double, y2 double, k long")
    got = {(r["source_frame"], r["k"]) for r in frames.suppressed(df, K, ["k"], 0.5).collect()}

    def iou(a, b):
        w, h = min(a[6], b[6]) - max(a[4], b[4]), min(a[7], b[7]) - max(a[5], b[5])
        both = max(0, w) * max(0, h)
        return both / ((a[6] - a[4]) * (a[7] - a[5]) + (b[6] - b[4]) * (b[7] - b[5]) - both)

    kept = []
    for r in sorted(rows, key=lambda r: (r[1], -r[3], r[8])):
        if all(k[1] != r[1] or iou(k, r) < 0.5 for k in kept):
            kept.append(r)
    assert got == {(r[1], r[8]) for r in kept}


def test_greedy_matches(spark):
    rng = random.Random(6)
    rows = [(c, m, p, round(rng.random(), 3)) for c in range(4) for m in range(8) for p in range(6) if rng.random() < 0.5]
    got = {(r["clip_id"], r["m"], r["p"]) for r in joins.greedy_matches(spark.createDataFrame(rows, "clip_id long, m long, p long, d double"), K, "m", "p", "d").collect()}
    used, expected = set(), set()
    for c, m in sorted({r[:2] for r in rows}):
        free = sorted((r[3], r[2]) for r in rows if r[:2] == (c, m) and (c, r[2]) not in used)
        if free:
            used.add((c, free[0][1]))
            expected.add((c, m, free[0][1]))
    assert got == expected


def test_debounce_and_coalesce(spark):
    rows = [(1, 0.0, 5.0), (1, 0.5, 9.0), (1, 1.2, 7.0), (1, 1.6, 3.0), (1, 5.0, 1.0)]
    got = tracks.debounced(spark.createDataFrame(rows, "clip_id long, clip_seconds double, speed double"), K, 1.0).collect()
    assert [(r["clip_seconds"], r["speed"]) for r in sorted(got, key=lambda r: r["clip_seconds"])] == [(0.5, 9.0), (1.6, 3.0), (5.0, 1.0)]
    stops = [(1, 0.0, 1.0, 1.5, True, -8.0), (1, 2.0, 3.0, 3.2, False, -9.5), (1, 3.9, 4.0, None, False, -7.0), (1, 9.0, 9.5, 9.6, False, -6.0)]
    got = tracks.coalesced(spark.createDataFrame(stops, "clip_id long, start_seconds double, end_seconds double, resumed_seconds double, starts_outside boolean, minimum_signed_distance double"), K, 1.0).collect()
    assert sorted((r["start_seconds"], r["end_seconds"], r["merged"], r["minimum_signed_distance"]) for r in got) == [(0.0, 4.0, 3, -9.5), (9.0, 9.5, 1, -6.0)]


def test_homography(spark):
    h = g.homography([(0, 0), (100, 0), (100, 50), (0, 50)], [(0, 0), (10, 0), (10, 5), (0, 5)])
    row = spark.range(1).select(*[c.alias(n) for c, n in zip(g.projected(F.lit(40.0), F.lit(20.0), h), "uv", strict=True)]).first()
    assert (row["u"], row["v"]) == pytest.approx((4.0, 2.0))
    with pytest.raises(ValueError, match="four"):
        g.homography([(0, 0)], [(0, 0)])


def test_stream_counts_each_key_once(spark, tmp_path):
    schema = "event_time timestamp, event_key string, event_type string"
    for k, minute in enumerate((0, 0, 1)):
        spark.sql(f"SELECT make_timestamp(2024, 1, 1, 0, {minute}, 5) AS event_time, 'k{minute}' AS event_key, 'pass' AS event_type").write.mode("append").parquet(f"{tmp_path}/in")
        del k
    stream = windows.stream_of_keys(spark, f"{tmp_path}/in", schema)
    run = stream.writeStream.format("memory").queryName("counts").outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {r["n"] for r in spark.sql("SELECT * FROM counts").collect()} == {1}


def test_last_window_is_closed(spark):
    clips = spark.createDataFrame([(1, 20.0)], "clip_id long, duration double")
    events = spark.createDataFrame([(1, t) for t in (4.0, 5.0, 20.0)], "clip_id long, clip_seconds double")
    got = sorted((r["clip_seconds"], r["index"]) for r in windows.assigned(events, clips, K, 5.0, 1.0).collect())
    assert got == [(4.0, 0), (4.0, 1), (5.0, 1), (20.0, 4)]


def test_replay_as_a_stream(spark, tmp_path):
    """Chunks that overlap: the stream, ended and taken up again, gives what the batch gives; other settings start anew; the team that a chunk inherits is that of the chunk before."""
    schema = "clip_id long, chunk_no long, start_seconds double, team string, event_time timestamp, event_key string"

    def write(chunk):
        rows = [(c, chunk, float(s), "red" if (s + c) % 3 else "black", s, f"{c}:{s}") for c in (1, 2) for s in range(chunk * 4, chunk * 4 + 5)]
        df = spark.createDataFrame(rows, "clip_id long, chunk_no long, start_seconds double, team string, s long, event_key string")
        df.withColumn("event_time", F.timestamp_seconds(F.col("s") + 1_700_000_000)).drop("s").select(*[c.split()[0] for c in schema.split(", ")]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    settings = {"length": 5, "overlap": 1}
    for chunk in range(3):
        write(chunk)
        stream = replay.chunks(spark, f"{tmp_path}/in", schema)
        replay.run(replay.once(stream, "10 seconds"), f"{tmp_path}/out", f"{tmp_path}/state", settings)
    batch = spark.read.parquet(f"{tmp_path}/in")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == batch.select("event_key").distinct().count() < batch.count()
    assert reports.differences(out.select("event_key"), batch.select("event_key").distinct()).count() == 0
    assert replay.checkpoint_of("x", settings) != replay.checkpoint_of("x", settings | {"overlap": 2})
    replay.run(replay.inherited(replay.chunks(spark, f"{tmp_path}/in", schema)), f"{tmp_path}/teams", f"{tmp_path}/state", settings | {"of": "teams"})
    last = {(r["clip_id"], r["chunk_no"]): r["team"] for r in batch.groupBy("clip_id", "chunk_no").agg(F.max_by("team", "start_seconds").alias("team")).collect()}
    got = {(r["clip_id"], r["chunk_no"]): r["initial_team"] for r in spark.read.parquet(f"{tmp_path}/teams").collect()}
    assert got == {(c, k): last.get((c, k - 1)) for c, k in last}
