"""Replay of clips as a stream of chunks: state that a chunk hands to the next, resumption, and the comparison with the batch (2N)."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def checkpoint_of(root: str, settings: dict) -> str:
    """The checkpoint folder of these settings: other settings never meet its state."""
    return f"{root.rstrip('/')}/{hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()[:16]}"


def chunks(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Files of chunks, one a trigger, in order of their time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def once(events: DataFrame, delay: str) -> DataFrame:
    """N3 as a stream: events (event_time, event_key), each key once while the watermark keeps it; `delay` is the chunks' overlap or more."""
    return events.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["event_key"])


def inherited(spells: DataFrame) -> DataFrame:
    """Of spells (clip_id, chunk_no, start_seconds, team) the team that each chunk of a clip inherits from the chunk before it, null for the first. A clip's state is that team alone."""

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        team = state.get[0] if state.exists else None
        rows = pd.concat(frames).sort_values(["chunk_no", "start_seconds"])
        made = []
        for chunk, own in rows.groupby("chunk_no", sort=True):
            made.append((key[0], chunk, team))
            team = own["team"].iloc[-1]
        state.update((team,))
        yield pd.DataFrame(made, columns=["clip_id", "chunk_no", "initial_team"])

    return spells.groupBy("clip_id").applyInPandasWithState(follow, "clip_id long, chunk_no long, initial_team string", "team string", "append", GroupStateTimeout.NoTimeout)


def run(rows: DataFrame, sink: str, root: str, settings: dict) -> None:
    """What is there to read, into Parquet; a later call goes on where this one ended, as long as the settings are the same."""
    rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint_of(root, settings)).outputMode("append").trigger(availableNow=True).start().awaitTermination()
