"""Review history: snapshots, reference sets, mappings, imports, artifacts and the state of segments (2O). All are append-only logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def version_conflicts(log: DataFrame, by: Sequence[str], version: str) -> DataFrame:
    """O3: entries whose version does not follow the one before it (expected: 1 for the first)."""
    w = Window.partitionBy(*by).orderBy(version)
    expected = F.coalesce(F.lag(version).over(w), F.lit(0)) + 1
    return log.withColumn("expected_version", expected).where(F.col(version) != F.col("expected_version"))


def reference_sets(sets: DataFrame, by: Sequence[str]) -> DataFrame:
    """Of revisions (revision, status, n_members) of reference sets the latest and the latest approved one, each draft being based on the revision before it."""
    w = Window.partitionBy(*by).orderBy("revision")
    rows = sets.withColumn("based_on", F.lag("revision").over(w))
    approved = F.col("status") == "approved"
    return rows.groupBy(*by).agg(
        F.max("revision").alias("latest_revision"), F.max_by("status", "revision").alias("latest_status"), F.max_by("based_on", "revision").alias("based_on"),
        F.max(F.when(approved, F.col("revision"))).alias("approved_revision"), F.max_by("n_members", F.when(approved, F.col("revision"))).alias("approved_members"),
    )


def mapping_faults(mappings: DataFrame, members: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mappings (manual_key, engine_key) that share a key with another one of their set, or whose manual_key is no member (manual_key) of it."""
    n = {c: F.count(F.lit(1)).over(Window.partitionBy(*by, c)) for c in ("manual_key", "engine_key")}
    rows = mappings.withColumns({"manual_uses": n["manual_key"], "engine_uses": n["engine_key"]})
    known = members.select(*by, "manual_key", F.lit(True).alias("member")).distinct()
    rows = rows.join(known, [*by, "manual_key"], "left").withColumn("member", F.coalesce("member", F.lit(False)))
    return rows.where((F.col("manual_uses") > 1) | (F.col("engine_uses") > 1) | ~F.col("member"))


def import_status(incoming: DataFrame, ledger: DataFrame, keys: Sequence[str], digest: str) -> DataFrame:
    """Incoming records as unchanged (the ledger has the key with this digest), conflicting (with another one) or inserted; `applies` tells whether their group may be
    written, which it may only as a whole, without any conflict in it (keys[:-1] is the group)."""
    own = ledger.groupBy(*keys).agg(F.max(digest).alias("known_"))
    rows = incoming.join(own, list(keys), "left")
    status = F.when(F.col("known_").isNull(), "inserted").when(F.col("known_") == F.col(digest), "unchanged").otherwise("conflicting")
    rows = rows.withColumn("status", status).drop("known_")
    conflict = rows.groupBy(*keys[:-1]).agg((F.count_if(F.col("status") == "conflicting") == 0).alias("applies"))
    return rows.join(conflict, list(keys[:-1]))


def regression_results(registry: DataFrame, segments: DataFrame) -> DataFrame:
    """A row for each result in the JSON of a run (run_id, payload: {"segmentResults": [{"segment": .., "value": ..}]}), those of known segments."""
    kind = "struct<segmentResults:array<struct<segment:bigint,value:double>>>"
    rows = registry.select("run_id", F.posexplode(F.from_json("payload", kind)["segmentResults"]).alias("result_no", "r"))
    return rows.select("run_id", "result_no", F.col("r.segment").alias("segment"), F.col("r.value").alias("value")).join(segments.select("segment").distinct(), "segment", "left_semi")


def new_artifacts(found: DataFrame, registered: DataFrame, by: Sequence[str], first: Sequence[str]) -> DataFrame:
    """Artifacts not yet registered, each (by: provider, key, hash) once, with the smallest of `first`."""
    once = found.groupBy(*by).agg(F.min(F.struct(*first)).alias("f_")).select(*by, "f_.*")
    return once.join(registered.select(*by).distinct(), list(by), "left_anti")


def segment_state(running: Column, stage: Column, has_events: Column, expected: Column, processed: Column) -> Column:
    """What a segment is up to, from its run (running, its stage) and what it has made."""
    done = (expected > 0) & (processed >= expected)
    return (
        F.when(running, F.when(stage == "detecting", "processing").otherwise("building")).when(stage == "failed", "failed").when(has_events, "ready")
        .when(stage == "evidence_ready", "evidence_ready").when(stage.isNotNull() & done, "building").when(done, "detections_ready").when(processed > 0, "processing").otherwise("prepared")
    )
