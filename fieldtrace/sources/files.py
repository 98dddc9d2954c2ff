"""Scans and sinks of detection caches, manifests, coordinates and tracks (2A). All go through Spark's readers and writers."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BOX = "struct<class_name:string,confidence:double,x1:double,y1:double,x2:double,y2:double>"
CACHE = f"type string, manifest_sha256 string, source_frame long, clip_seconds double, detections array<{BOX}>"
#: Fields of a manifest that would leak what is to be predicted.
LABELS = ("actions", "action_counts", "annotations", "events", "labels", "ball_ground_truth", "manual_reference")
MANIFEST = "match_id string, clip_id long, fps double, start_frame long, end_frame long, half int, start_seconds double, starts_at_kickoff boolean, " + ", ".join(f"{c} string" for c in LABELS)


def detection_cache(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A1: metadata and boxes of JSON lines; a frame's boxes keep their order as `ordinal`. The file names the clip."""
    lines = spark.read.schema(CACHE).json(path).withColumn("file", F.col("_metadata.file_name"))
    frames = lines.where("type = 'frame'").select("file", "source_frame", "clip_seconds", F.posexplode("detections").alias("ordinal", "box"))
    return lines.where("type = 'metadata'").select("file", "manifest_sha256"), frames.select("file", "source_frame", "clip_seconds", "ordinal", "box.*")


def foreign(metadata: DataFrame, manifests: DataFrame) -> DataFrame:
    """A2: files made under another manifest than any of those given (file, manifest_sha256)."""
    return metadata.join(manifests, ["file", "manifest_sha256"], "left_anti")


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifests with the reasons to reject them, none for a valid one. Labels are read as text, whatever their type: only null, an empty text, list or
    object may stand there."""
    rows = spark.read.schema(MANIFEST).json(path, multiLine=True)
    rows = rows.withColumn("starts_at_kickoff", F.coalesce("starts_at_kickoff", F.col("start_seconds") <= 5.0))
    faults = [F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in (("fps", F.col("fps") > 0), ("start_frame", F.col("start_frame") >= 0), ("end_frame", F.col("end_frame") > F.col("start_frame")))]
    leaks = [F.when(F.regexp_replace(c, r"\s", "").isin("", "[]", "{}") == F.lit(False), F.lit(f"leak:{c}")) for c in LABELS]
    return rows.withColumn("reasons", F.array_compact(F.array(*faults, *leaks))).drop(*LABELS)


def coordinates(spark: SparkSession, path: str, per_file: int = 75) -> DataFrame:
    """Line n of file s is frame s * per_file + n, with columns `_ x y`; the number in a file's name is s. A line that isn't there has no row."""
    files = spark.read.text(path, wholetext=True).withColumn("part", F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)", 1).cast("long"))
    lines = files.select("part", F.posexplode(F.split(F.rtrim("value"), "\n")).alias("line", "text"))
    fields = F.split(F.trim("text"), r"\s+")
    return lines.select((F.col("part") * per_file + F.col("line")).alias("source_frame"), F.get(fields, 1).try_cast("double").alias("x"), F.get(fields, 2).try_cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """CSV with frame, ball_x, ball_y."""
    return spark.read.csv(path, header=True, schema="frame long, ball_x double, ball_y double")


def write_tracks(points: DataFrame, path: str, keys: Sequence[str], by: Sequence[str]) -> None:
    """A document for each track with its ordered points, in folders by clip."""
    fields = [c for c in points.columns if c not in (*keys, "track_id")]
    per = points.groupBy(*keys, "track_id").agg(F.array_sort(F.collect_list(F.struct("source_frame", *[c for c in fields if c != "source_frame"]))).alias("points"))
    per.write.mode("append").partitionBy(*by).json(path)


def tracks(spark: SparkSession, path: str, schema: str, teams: Sequence[str]) -> DataFrame:
    """Points of track documents, those of known teams; a point without a team has its track's."""
    rows = spark.read.schema(schema).json(path).withColumn("point", F.explode("points"))
    team = F.coalesce(F.col("point.team"), F.col("team"))
    return rows.select("clip_id", "track_id", "role", team.alias("team"), "point.source_frame", "point.clip_seconds", "point.x", "point.y").where(team.isin(*teams))


def write_rows(objects: DataFrame, path: str) -> None:
    """Object rows as CSV with fixed decimals."""
    fixed = [F.format_string("%.2f", c).alias(c) if t == "double" else F.col(c) for c, t in objects.dtypes]
    objects.select(*fixed).write.mode("append").csv(path, header=True)


def checksums(spark: SparkSession, manifest: str, folder: str) -> DataFrame:
    """Files of a folder, and of those in it, against lines `sha256 *path`, path being that under the folder: ok, mismatch, absent or unlisted; a path listed twice is a duplicate.
    Files of one name in two folders are two files. A file is read into one cell."""
    line = r"^([0-9a-f]{64}) [ *](?:\./)?(.+)$"
    listed = spark.read.text(manifest).select(F.regexp_extract("value", line, 1).alias("expected"), F.regexp_extract("value", line, 2).alias("name")).where("expected != ''")
    listed = listed.withColumn("times", F.count(F.lit(1)).over(Window.partitionBy("name")))
    base = re.escape(re.sub("^[a-z]+:/*", "/", folder.rstrip("/")))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.regexp_replace("path", f"^.*?{base}/", "").alias("name"), F.sha2("content", 256).alias("actual"))
    status = F.when(F.col("times") > 1, "duplicate").when(F.col("expected").isNull(), "unlisted").when(F.col("actual").isNull(), "absent").when(F.col("actual") != F.col("expected"), "mismatch").otherwise("ok")
    return listed.join(found, "name", "full_outer").select("name", status.alias("status"))


STREAMS = "array<struct<camera_id:string,video:string,time_offset_seconds:double>>"


def camera_streams(spark: SparkSession, path: str) -> DataFrame:
    """A4: the cameras of each manifest (file), with the reasons to reject it: a blank or repeated camera_id, an offset that is no finite number, a primary camera that is not declared, an empty
    list. A manifest without cameras has one, "primary", with its video. The primary camera is the first, unless another is named."""
    rows = spark.read.schema(f"video string, primary_camera_id string, camera_streams {STREAMS}").json(path, multiLine=True).withColumn("file", F.col("_metadata.file_name"))
    alone = F.array(F.struct(F.lit("primary").alias("camera_id"), F.col("video"), F.lit(0.0).alias("time_offset_seconds"))).cast(STREAMS)
    rows = rows.withColumn("cameras", F.coalesce("camera_streams", alone))
    named = F.transform("cameras", lambda c: F.coalesce(F.trim(c["camera_id"]), F.lit("")))
    offsets = F.transform("cameras", lambda c: F.coalesce(c["time_offset_seconds"], F.lit(0.0)))
    primary = F.coalesce(F.nullif(F.trim("primary_camera_id"), F.lit("")), F.get(named, 0))
    faults = {
        "no camera": F.size("cameras") == 0, "blank camera_id": F.array_contains(named, ""), "repeated camera_id": F.size(F.array_distinct(named)) < F.size(named),
        "offset": F.exists(offsets, lambda o: F.isnan(o) | (F.abs(o) == float("inf"))), "primary": ~F.coalesce(F.array_contains(named, primary), F.lit(False)),
    }
    reasons = F.array_compact(F.array(*[F.when(f, F.lit(n)) for n, f in faults.items()]))
    one = rows.select("file", reasons.alias("reasons"), primary.alias("primary_camera_id"), F.explode_outer("cameras").alias("c"))
    return one.select("file", "reasons", "primary_camera_id", F.trim("c.camera_id").alias("camera_id"), "c.video", F.coalesce("c.time_offset_seconds", F.lit(0.0)).alias("time_offset_seconds"))


def on_clip_clock(points: DataFrame, cameras: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A5: points of cameras (camera_id, clip_seconds) on the clip's clock."""
    own = cameras.select(*keys, "camera_id", "time_offset_seconds")
    return points.join(own, [*keys, "camera_id"]).withColumn("clip_seconds", F.col("clip_seconds") + F.col("time_offset_seconds")).drop("time_offset_seconds")


#: The labels of the annotation format.
ACTION_LABELS = ["ball_player_block", "cross", "drive", "free_kick", "goal", "header", "high_pass", "out", "pass", "player_successful_tackle", "shot", "throw_in"]
ACTION = "array<struct<gameTime:string,position:string,label:string,team:string,player_id:string,visibility:string>>"
HALF_SECONDS = 45 * 60


def normalized_label(label: Column) -> Column:
    """H1: lower case, with one underscore for each run of other characters, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(F.trim(label)), "[^a-z0-9]+", "_"), F.lit("_"))


def labelled_actions(spark: SparkSession, path: str) -> DataFrame:
    """Actions (or annotations) of JSON files: half, seconds on the clock, in the half and in the match, normalised label, team; with the reasons to reject one. A position in
    the second half counts from the start of the match if it is past the first 45 minutes, else from the start of the half."""
    rows = spark.read.schema(f"actions {ACTION}, annotations {ACTION}").json(path, multiLine=True).withColumn("file", F.col("_metadata.file_name"))
    a = rows.select("file", F.posexplode(F.coalesce("actions", "annotations")).alias("action_no", "a")).select("file", "action_no", "a.*")
    clock = lambda k: F.regexp_extract("gameTime", r"^\s*(\d+)\s*-\s*(\d+):(\d{2})\s*$", k).try_cast("int")
    seconds = F.col("position").try_cast("long") / 1000
    a = a.withColumns({"half": clock(1), "clock_seconds": clock(2) * 60 + clock(3), "seconds_": seconds, "label": normalized_label(F.coalesce("label", F.lit(""))), "team": F.lower("team")})
    start = (F.col("half") - 1) * HALF_SECONDS
    absolute = (F.col("half") > 1) & (F.col("seconds_") >= start)
    a = a.withColumns({"half_seconds": F.when(absolute, F.col("seconds_") - start).otherwise(F.col("seconds_")), "match_seconds": F.when(absolute, F.col("seconds_")).otherwise(F.col("seconds_") + start)})
    faults = {"gameTime": F.col("half").isNull(), "half": ~F.col("half").isin(1, 2), "position": F.col("seconds_").isNull() | (F.col("seconds_") < 0), "label": ~F.col("label").isin(*ACTION_LABELS), "team": ~F.col("team").isin("left", "right")}
    return a.withColumn("reasons", F.array_compact(F.array(*[F.when(f, F.lit(n)) for n, f in faults.items()]))).drop("gameTime", "position", "seconds_")


def write_events(events: DataFrame, path: str) -> None:
    """Events, spells or states as Parquet in folders by match and clip."""
    events.write.mode("append").partitionBy("match_id", "clip_id").parquet(path)


def to_process(frames: DataFrame, written: DataFrame, settings: str) -> DataFrame:
    """Frames (file, source_frame) that are not yet written under the same settings; those written under others don't count."""
    done = written.where(F.col("settings") == settings).select("file", "source_frame")
    return frames.join(done, ["file", "source_frame"], "left_anti").withColumn("settings", F.lit(settings))


def bundles(spark: SparkSession, path: str) -> DataFrame:
    """Segments of JSON files below a folder, by segment_id, with the reasons to reject one: an id of other characters than letters, digits, dot, dash and underscore, an absolute path or one that
    leaves the folder, an id that another file has."""
    rows = spark.read.schema("segment_id string, title string, paths array<string>").json(path, multiLine=True, recursiveFileLookup=True, pathGlobFilter="segment.json").withColumn("file", F.col("_metadata.file_path"))
    times = F.count(F.lit(1)).over(Window.partitionBy("segment_id"))
    safe = F.coalesce(F.forall("paths", lambda p: ~p.rlike(r"^/|(^|/)\.\.(/|$)|^$")), F.lit(True))
    faults = {"segment_id": ~F.coalesce(F.col("segment_id").rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$"), F.lit(False)), "path": ~safe, "repeated": times > 1}
    return rows.withColumn("reasons", F.array_compact(F.array(*[F.when(f, F.lit(n)) for n, f in faults.items()]))).orderBy("segment_id")


def publishable(runs: DataFrame, published: DataFrame) -> DataFrame:
    """Runs that may be published: cold, without reused caches or earlier artifacts, not passed without a reference, and new."""
    cold = runs.where("cold AND NOT cache_reused AND NOT prior_artifacts AND (status <> 'passed' OR reference_id IS NOT NULL)")
    return cold.join(published.select("run_id"), "run_id", "left_anti")
