"""Overlapping replay windows: in batch and as a stream (2N)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def replay_windows(clips: DataFrame, length: float, overlap: float) -> DataFrame:
    """Windows of `length` seconds of clips (duration), each starting at the end of the one before less the overlap; the last one ends with the clip."""
    step = length - overlap
    more = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("duration") - length) / step))
    out = clips.withColumn("index", F.explode(F.sequence(F.lit(0).cast("long"), more))).withColumn("window_start", F.col("index") * step)
    return out.withColumn("window_end", F.least(F.col("duration"), F.col("window_start") + length))


def assigned(events: DataFrame, clips: DataFrame, keys: Sequence[str], length: float, overlap: float) -> DataFrame:
    """The windows that an event falls into, from its time and the clip's duration alone: half-open, but the last one, which is closed."""
    step = length - overlap
    rows = events.join(clips.select(*keys, F.col("duration").alias("duration_")), list(keys))
    last = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("duration_") - length) / step))
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.col("clip_seconds") - length) / step) + 1)
    return rows.withColumn("index", F.explode(F.sequence(F.least(first, last), F.least(F.floor(F.col("clip_seconds") / step), last)))).drop("duration_")


def deduplicated(events: DataFrame, clips: DataFrame, keys: Sequence[str], event: str, length: float, overlap: float) -> DataFrame:
    """For each window the events that are new in it and those that an earlier window had."""
    rows = assigned(events, clips, keys, length, overlap)
    first = F.row_number().over(Window.partitionBy(*keys, event).orderBy("index")) == 1
    return rows.withColumn("new", first).groupBy(*keys, "index").agg(F.count_if("new").alias("new_events"), F.count_if(~F.col("new")).alias("duplicates"))


def progress(events: DataFrame, clips: DataFrame, keys: Sequence[str], event: str, types: Sequence[str], length: float, overlap: float) -> DataFrame:
    """After each window of a clip how far its results are final (the end less the overlap; the duration after the last one), and the events of each type so far."""
    spans = replay_windows(clips, length, overlap).withColumn("last_", F.col("window_end") >= F.col("duration"))
    final = F.when(F.col("last_"), F.col("duration")).otherwise(F.greatest(F.lit(0.0), F.col("window_end") - overlap))
    first = assigned(events, clips, keys, length, overlap).groupBy(*keys, event, "event_type").agg(F.min("index").alias("index"))
    new = first.groupBy(*keys, "index").agg(*[F.count_if(F.col("event_type") == t).alias(t) for t in types])
    w = Window.partitionBy(*keys).orderBy("index")
    rows = spans.join(new, [*keys, "index"], "left")
    return rows.select(*keys, "index", F.round(final, 3).alias("finalised_through"), *[F.coalesce(F.sum(t).over(w), F.lit(0)).alias(t) for t in types])


def backlog(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chunks (index, arrival, service) of one worker: when each is finished, and how long it waited. Finish is the running service plus the largest slack so far."""
    w = Window.partitionBy(*keys).orderBy("index")
    chunks = chunks.withColumn("served", F.sum("service").over(w)).withColumn("slack", F.col("arrival") - (F.col("served") - F.col("service")))
    chunks = chunks.withColumn("finish", F.col("served") + F.max("slack").over(w))
    return chunks.withColumn("wait", F.col("finish") - F.col("service") - F.col("arrival")).drop("served", "slack")


def stream_of_keys(spark: SparkSession, folder: str, schema: str, delay: str = "10 seconds") -> DataFrame:
    """N3, N4 as a stream: files of events (event_time, event_key, event_type), each key once within the watermark, counted by type and minute."""
    events = spark.readStream.schema(schema).parquet(folder)
    once = events.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["event_key"])
    return once.groupBy(F.window("event_time", "1 minute"), "event_type").agg(F.count(F.lit(1)).alias("n"))
