"""File scans and sinks on small files."""

import hashlib
import json

from pyspark.sql import functions as F

from fieldtrace.sources import files


def test_detection_cache(spark, tmp_path):
    box = {"class_name": "person", "confidence": 0.5, "x1": 1.0, "y1": 2.0, "x2": 3.0, "y2": 4.0}
    lines = [{"type": "metadata", "manifest_sha256": "a"}, {"type": "frame", "source_frame": 2, "clip_seconds": 0.08, "detections": [box, box | {"x1": 9.0}]}, {"type": "frame", "source_frame": 1, "clip_seconds": 0.04, "detections": []}]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, lines)))
    meta, boxes = files.detection_cache(spark, str(tmp_path))
    assert [(r["source_frame"], r["ordinal"], r["x1"]) for r in boxes.orderBy("ordinal").collect()] == [(2, 0, 1.0), (2, 1, 9.0)]
    good, bad = (spark.createDataFrame([("c.jsonl", h)], "file string, manifest_sha256 string") for h in "ab")
    assert (files.foreign(meta, good).count(), files.foreign(meta, bad).count()) == (0, 1)


def test_manifests(spark, tmp_path):
    good = {"match_id": "m", "clip_id": 1, "fps": 25.0, "start_frame": 0, "end_frame": 10, "start_seconds": 3.0}
    (tmp_path / "a.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "b.json").write_text(json.dumps(good | {"clip_id": 2, "fps": 0.0, "end_frame": 0, "events": ["x"], "labels": []}))
    leaks = {"action_counts": {"pass": 3}, "manual_reference": "ref-7", "actions": [{"label": "pass"}], "labels": 0, "annotations": False}
    (tmp_path / "c.json").write_text(json.dumps(good | {"clip_id": 3} | leaks))
    (tmp_path / "d.json").write_text(json.dumps(good | {"clip_id": 4, "action_counts": {}, "manual_reference": "", "actions": [], "events": None}))
    got = {r["clip_id"]: r for r in files.manifests(spark, str(tmp_path)).collect()}
    assert sorted(got[3]["reasons"]) == sorted(f"leak:{c}" for c in leaks) and got[4]["reasons"] == []
    assert got[1]["reasons"] == [] and got[1]["starts_at_kickoff"] is True
    assert got[2]["reasons"] == ["fps", "end_frame", "leak:events"]


def test_coordinates_and_truth(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "part2.txt").write_text("0 1.5 2.5 z\n\n0 3 4\n")
    got = files.coordinates(spark, str(tmp_path / "t")).orderBy("source_frame").collect()
    assert [tuple(r) for r in got] == [(150, 1.5, 2.5), (152, 3.0, 4.0)]
    (tmp_path / "g.csv").write_text("frame,ball_x,ball_y\n3,1.0,\n")
    assert [tuple(r) for r in files.ground_truth(spark, str(tmp_path / "g.csv")).collect()] == [(3, 1.0, None)]


def test_tracks_round_trip(spark, tmp_path):
    rows = [(1, 7, "player", "red", 2, 0.08, 1.0, 2.0), (1, 7, "player", "red", 1, 0.04, 0.0, 0.0), (1, 8, "player", "green", 1, 0.04, 5.0, 5.0)]
    points = spark.createDataFrame(rows, "clip_id long, track_id long, role string, team string, source_frame long, clip_seconds double, x double, y double")
    files.write_tracks(points.drop("role"), str(tmp_path / "out"), ["clip_id"], ["clip_id"])
    schema = "clip_id long, track_id long, role string, team string, points array<struct<source_frame:long,clip_seconds:double,team:string,x:double,y:double>>"
    got = files.tracks(spark, str(tmp_path / "out"), schema, ["red"]).orderBy("source_frame").collect()
    assert [(r["track_id"], r["source_frame"], r["x"]) for r in got] == [(7, 1, 0.0), (7, 2, 1.0)]
    files.write_rows(points.select("track_id", "x"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).where("x = '5.00'").count() == 1


def test_checksums(spark, tmp_path):
    (tmp_path / "f").mkdir()
    for name in ("a", "b", "c"):
        (tmp_path / "f" / name).write_text(name)
    sha = {n: hashlib.sha256(n.encode()).hexdigest() for n in "abd"}
    (tmp_path / "SUMS").write_text(f"{sha['a']} *a\n{sha['a']} *b\n{sha['d']} *d\n# note\n")
    got = {r["name"]: r["status"] for r in files.checksums(spark, str(tmp_path / "SUMS"), str(tmp_path / "f")).collect()}
    assert got == {"a": "ok", "b": "mismatch", "c": "unlisted", "d": "absent"}
    (tmp_path / "f" / "in").mkdir()
    (tmp_path / "f" / "in" / "a").write_text("b")
    (tmp_path / "SUMS").write_text(f"{sha['a']} *a\n{sha['b']} *./in/a\n")
    got = {r["name"]: r["status"] for r in files.checksums(spark, str(tmp_path / "SUMS"), str(tmp_path / "f")).collect()}
    assert got == {"a": "ok", "in/a": "ok", "b": "unlisted", "c": "unlisted"}


def test_camera_streams(spark, tmp_path):
    cams = lambda *ids: [{"camera_id": i, "video": "v", "time_offset_seconds": 0.5} for i in ids]
    cases = {"a": {"video": "x.mp4"}, "b": {"camera_streams": cams("one", " two ")}, "c": {"camera_streams": cams("one", "one", " ")}, "d": {"camera_streams": []}, "e": {"camera_streams": cams("one"), "primary_camera_id": "three"}}
    for name, case in cases.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(case))
    rows = files.camera_streams(spark, str(tmp_path)).collect()
    got = {r["file"][0]: r["reasons"] for r in rows}
    assert got == {"a": [], "b": [], "c": ["blank camera_id", "repeated camera_id"], "d": ["no camera", "primary"], "e": ["primary"]}
    assert [(r["camera_id"], r["primary_camera_id"], r["video"]) for r in rows if r["file"] == "a.json"] == [("primary", "primary", "x.mp4")]
    points = spark.createDataFrame([(1, "one", 2.0)], "clip_id long, camera_id string, clip_seconds double")
    clock = files.on_clip_clock(points, spark.createDataFrame([(1, "one", 0.5)], "clip_id long, camera_id string, time_offset_seconds double"), ["clip_id"])
    assert clock.first()["clip_seconds"] == 2.5


def test_labelled_actions(spark, tmp_path):
    action = lambda **kw: {"gameTime": "1 - 00:05", "position": "5000", "label": "PASS", "team": "left"} | kw
    (tmp_path / "a.json").write_text(json.dumps({"actions": [action(), action(gameTime="2 - 01:00", position="60000", label=" High  Pass! "), action(gameTime="2 - 01:00", position="2760000"), action(gameTime="x", label="dance", team="up", position="-1")]}))
    (tmp_path / "b.json").write_text(json.dumps({"annotations": [action(label="goal", team=None)]}))
    rows = files.labelled_actions(spark, str(tmp_path)).orderBy("file", "action_no").collect()
    assert [(r["label"], r["half_seconds"], r["match_seconds"], r["clock_seconds"]) for r in rows[:3]] == [("pass", 5.0, 5.0, 5), ("high_pass", 60.0, 2760.0, 60), ("pass", 60.0, 2760.0, 60)]
    assert [r["reasons"] for r in rows] == [[], [], [], ["gameTime", "position", "label", "team"], []]


def test_ingest_bundles_and_runs(spark, tmp_path):
    frames = spark.createDataFrame([("f", k) for k in range(4)], "file string, source_frame long")
    written = spark.createDataFrame([("f", 0, "s1"), ("f", 1, "s2")], "file string, source_frame long, settings string")
    assert sorted(r["source_frame"] for r in files.to_process(frames, written, "s1").collect()) == [1, 2, 3]
    for folder, body in {"a": {"segment_id": "seg-1", "paths": ["x/y.json"]}, "b": {"segment_id": "seg-2", "paths": ["../out"]}, "c": {"segment_id": "seg 3"}, "d": {"segment_id": "seg-1"}}.items():
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "segment.json").write_text(json.dumps(body))
    got = [(r["segment_id"], r["reasons"]) for r in files.bundles(spark, str(tmp_path)).collect()]
    assert sorted(got) == [("seg 3", ["segment_id"]), ("seg-1", ["repeated"]), ("seg-1", ["repeated"]), ("seg-2", ["path"])]
    runs = [("r1", True, False, False, "passed", "ref"), ("r2", True, False, False, "passed", None), ("r3", True, True, False, "done", None), ("r4", True, False, False, "done", None), ("r5", True, False, False, "done", None)]
    df = spark.createDataFrame(runs, "run_id string, cold boolean, cache_reused boolean, prior_artifacts boolean, status string, reference_id string")
    assert sorted(r["run_id"] for r in files.publishable(df, df.where("run_id = 'r5'")).collect()) == ["r1", "r4"]
    files.write_events(spark.range(3).select(F.lit("m").alias("match_id"), (F.col("id") % 2).alias("clip_id"), "id"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("clip_id = 0").count() == 2
