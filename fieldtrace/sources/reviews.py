"""Saved review states: JSON of any shape, checked against a manifest and their own identity, and the history records that they hold."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values of the format: the fields that may hold an event's key, in order, and what a key looks like.
KEY_FIELDS = ("event_key", "eventKey", "proposal_key", "proposalKey", "id")
KEY = r"^[{stream}][1-9][0-9]*$"
SUFFIX = "-review-state.json"


def canonical(value: Column) -> Column:
    """H9: a JSON value (variant) as text with sorted keys and no spaces."""
    return F.to_json(value)


def canonical_hash(value: Column) -> Column:
    """The SHA-256 of that text."""
    return F.sha2(canonical(value), 256)


def text_at(value: Column, field: str) -> Column:
    """A field that holds a text; null for other types."""
    part = F.try_variant_get(value, f"$.{field}", "variant")
    return F.when(F.schema_of_variant(part) == "STRING", F.try_variant_get(value, f"$.{field}", "string"))


def kind_of(value: Column) -> Column:
    return F.substring_index(F.regexp_replace(F.schema_of_variant(value), r"[<(].*", ""), " ", 1)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(logical_key, expected, times): lines `sha256 [*]path`; empty lines and comments are left out, and so are lines of another form, which manifest_faults() tells."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "^﻿", "")).alias("line"))
    rows = lines.select(F.lower(F.regexp_extract("line", r"^([0-9a-fA-F]{64})\s+\*?(.+)$", 1)).alias("expected"), F.regexp_extract("line", r"^([0-9a-fA-F]{64})\s+\*?(.+)$", 2).alias("name")).where("expected != ''")
    key = F.regexp_replace(F.replace("name", F.lit("\\"), F.lit("/")), r"^\./", "")
    return rows.groupBy(key.alias("logical_key")).agg(F.max("expected").alias("expected"), F.count(F.lit(1)).alias("times"))


def manifest_faults(spark: SparkSession, path: str) -> DataFrame:
    """(fault, line): lines that are no entry, and keys that are listed twice."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "^﻿", "")).alias("line")).where("line != '' AND line NOT LIKE '#%'")
    odd = lines.where(~F.col("line").rlike(r"^[0-9a-fA-F]{64}\s+\*?.+$")).select(F.lit("no entry").alias("fault"), "line")
    return odd.unionByName(manifest(spark, path).where("times > 1").select(F.lit("listed twice").alias("fault"), F.col("logical_key").alias("line")))


def review_states(spark: SparkSession, root: str, sums: str, workflows: dict[str, tuple[str, str]]) -> DataFrame:
    """A row for each `<segment>-review-state.json` in the folders under root that `workflows` names (folder: workflow and canvas id): workflow_id, logical_key, digest, n_bytes, segment_id, state (variant, missing ids
    filled in), canonicalized (which ones), and reason: why it is rejected, null if it is not.

    A file must be in the manifest with its digest, be a JSON object, and name its workflow, canvas and segment. Files are matched by their whole path under root, so files of one name in two folders don't meet. A state is read into one cell.
    """
    base = root.rstrip("/")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{SUFFIX}").load([f"{base}/{f}" for f in workflows])
    key = F.regexp_replace("path", f"^.*?{re.escape(re.sub('^[a-z]+:/*', '/', base))}/", "")
    rows = read.select(key.alias("logical_key"), "content", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("digest"))
    folder, file = F.regexp_replace("logical_key", r"/[^/]*$", ""), F.element_at(F.split("logical_key", "/"), -1)
    ids = F.create_map(*[x for f, (w, c) in workflows.items() for x in (F.lit(f), F.struct(F.lit(w).alias("workflow"), F.lit(c).alias("canvas")))])
    rows = rows.withColumn("ids", ids[folder]).where("ids IS NOT NULL").withColumn("segment_id", F.regexp_replace(file, f"{re.escape(SUFFIX)}$", ""))
    listed = manifest(spark, sums)
    rows = rows.join(listed, "logical_key", "left")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.regexp_replace(F.col("content").cast("string"), "^﻿", ""))
    rows = rows.withColumn("parsed", F.try_parse_json(text))
    own = {"workflowId": F.col("ids.workflow"), "canvasId": F.col("ids.canvas")}
    blank = {f: kind_of(F.col(f"at_{f}")).isNull() | kind_of(F.col(f"at_{f}")).isin("VOID") | F.coalesce(text_at(F.col("parsed"), f) == "", F.lit(False)) for f in own}
    rows = rows.withColumns({f"at_{f}": F.try_variant_get("parsed", f"$.{f}", "variant") for f in own})
    rows = rows.withColumns({f"no_{f}": F.coalesce(b, F.lit(True)) for f, b in blank.items()})
    wrong = F.array_compact(F.array(*[F.when(~F.col(f"no_{f}") & ~F.coalesce(text_at(F.col("parsed"), f) == v, F.lit(False)), f) for f, v in own.items()], F.when(~F.coalesce(text_at(F.col("parsed"), "segment") == F.col("segment_id"), F.lit(False)), "segment")))
    reason = (
        F.when(F.col("expected").isNull(), "absent from the manifest").when(F.col("times") > 1, "listed twice in the manifest").when(F.col("expected") != F.col("digest"), "checksum mismatch")
        .when(F.col("parsed").isNull(), "invalid JSON").when(kind_of(F.col("parsed")) != "OBJECT", "not a JSON object").when(F.size(wrong) > 0, F.concat(F.lit("identity mismatch: "), F.array_join(wrong, ", ")))
    )
    filled = F.array_compact(F.array(*[F.when(F.col(f"no_{f}"), f) for f in own]))
    fields = F.expr("try_cast(parsed AS map<string, variant>)")
    known = F.expr("CAST(parse_json(to_json(named_struct('workflowId', ids.workflow, 'canvasId', ids.canvas))) AS map<string, variant>)")
    missing = lambda k: F.array_contains(F.col("canonicalized"), k)
    whole = F.map_concat(F.map_filter(fields, lambda k, _: ~missing(k)), F.map_filter(known, lambda k, _: missing(k)))
    rows = rows.withColumn("reason", reason).withColumn("canonicalized", F.when(F.col("reason").isNull(), filled).otherwise(F.array().cast("array<string>")))
    state = F.when(F.col("reason").isNull(), F.parse_json(F.to_json(whole)))
    return rows.select(F.col("ids.workflow").alias("workflow_id"), "logical_key", "digest", "n_bytes", "segment_id", state.alias("state"), "canonicalized", "reason")


def explicit_key(value: Column, stream: str) -> Column:
    """The first field of an object that holds a key of the stream."""
    fields = [text_at(value, f) for f in KEY_FIELDS]
    return F.coalesce(*[F.when(f.rlike(KEY.format(stream=stream)), f) for f in fields])


def history_records(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, stream, place, event_key, proposal_key, type, payload, fingerprint) of what states (keys, state: variant) hold: proposals (C) and predictions (E) with explicit keys, decisions, the
    conversation (activity) and verdicts.

    Predictions are those of the state after the run, or before it if it has no list of them. A decision without a key of its own goes by its name, a number by its index. A payload is the object with its identity, any other value under
    `value`; it is canonical text, and fingerprint its SHA-256. Lists and maps of any shape are read as variants, so one element of another type does not spoil the rest; what is no list or map holds nothing.
    """
    at = lambda path, kind: F.try_variant_get("state", path, kind)
    lists = {"C": at("$.additionalProposals", "array<variant>"), "E": F.coalesce(at("$.engineAfter.predictions", "array<variant>"), at("$.engineBefore.predictions", "array<variant>")), "activity": at("$.conversation", "array<variant>")}
    maps = {"decision": at("$.decisions", "map<string,variant>"), "verdict": at("$.engineEventReviews", "map<string,variant>")}
    nothing = F.lit(None).cast("string")
    rows = None
    for stream, values in {**lists, **maps}.items():
        if stream in lists:
            one = states.select(*keys, F.posexplode(values).alias("place", "value")).withColumn("name", nothing)
        else:
            one = states.select(*keys, F.explode(values).alias("name", "value")).withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("name")) - 1)
        value, name = F.col("value"), F.col("name")
        if stream in "CE":
            one = one.withColumn("event_key", explicit_key(value, stream)).where("event_key IS NOT NULL").withColumn("proposal_key", nothing).withColumn("type", nothing)
        elif stream == "activity":
            one = one.withColumns({"event_key": nothing, "proposal_key": nothing, "type": F.lit("conversation")})
        else:
            told = F.when(kind_of(value) == "OBJECT", F.try_variant_get(value, "$.status", "string"))
            other = "decision" if stream == "decision" else "reviewed"
            index = F.when(name.rlike("^[0-9]+$"), F.concat(F.lit("decision-index:"), name)).otherwise(name)
            own = {"event_key": nothing, "proposal_key": F.coalesce(explicit_key(value, "C"), index)} if stream == "decision" else {"event_key": name, "proposal_key": nothing}
            one = one.withColumns({**own, "type": F.coalesce(told, F.lit(other))})
        one = one.select(*keys, F.lit(stream).alias("stream"), F.col("place").cast("long").alias("place"), "event_key", "proposal_key", "type", "value")
        rows = one if rows is None else rows.unionByName(one)
    identity = F.parse_json(F.to_json(F.struct("event_key", "proposal_key", "type", F.lit(True).alias("imported"))))
    added = F.map_filter(identity.cast("map<string,variant>"), lambda _, v: v.isNotNull())
    fields = F.when(kind_of(F.col("value")) == "OBJECT", F.expr("try_cast(value AS map<string, variant>)")).otherwise(F.create_map(F.lit("value"), F.col("value")))
    own = F.map_filter(fields, lambda k, _: ~F.array_contains(F.map_keys(F.col("added")), k))
    payload = F.parse_json(F.to_json(F.map_concat(own, F.col("added"))))
    rows = rows.withColumn("added", added).withColumn("body", payload)
    return rows.select(*keys, "stream", "place", "event_key", "proposal_key", "type", canonical(F.col("body")).alias("payload"), canonical_hash(F.col("body")).alias("fingerprint"))


#: How an import of one file can end.
STATUSES = ("inserted", "unchanged", "conflicting", "rejected")


def regression_registries(spark: SparkSession, root: str, sums: str, registries: dict[str, str], ledger: DataFrame) -> DataFrame:
    """The registry files under root that `registries` names (path: workflow): workflow_id, logical_key, digest, n_bytes, registry (variant), fingerprint (of its canonical JSON), verified (the manifest lists it), status (inserted, unchanged or
    rejected) and reason, null unless it is rejected.

    A registry is a JSON list, or an object that names its workflow; the manifest need not list it, but must not contradict it. It is unchanged if the ledger (workflow_id, logical_key, digest, status) has it inserted. A file that is
    not there is rejected.
    """
    base = root.rstrip("/")
    wanted = spark.createDataFrame([(k, w) for k, w in registries.items()], "logical_key string, workflow_id string")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    found = read.select(F.regexp_replace("path", f"^.*?{re.escape(re.sub('^[a-z]+:/*', '/', base))}/", "").alias("logical_key"), "content", F.col("length").alias("n_bytes"))
    rows = wanted.join(found.where(F.col("logical_key").isin(*registries)), "logical_key", "left").join(manifest(spark, sums), "logical_key", "left").withColumn("digest", F.sha2("content", 256))
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    rows = rows.withColumn("registry", F.try_parse_json(text)).withColumn("kind", kind_of(F.col("registry")))
    reason = (
        F.when(F.col("content").isNull(), "cannot be read").when(F.col("expected") != F.col("digest"), "checksum mismatch").when(F.col("registry").isNull(), "invalid JSON").when(~F.col("kind").isin("OBJECT", "ARRAY"), "neither an object nor a list")
        .when((F.col("kind") == "OBJECT") & ~F.coalesce(text_at(F.col("registry"), "workflow") == F.col("workflow_id"), F.lit(False)), "workflow mismatch")
    )
    known = ledger.where("status = 'inserted'").select("workflow_id", "logical_key", "digest").distinct().withColumn("known", F.lit(True))
    rows = rows.withColumn("reason", reason).join(known, ["workflow_id", "logical_key", "digest"], "left")
    status = F.when(F.col("reason").isNotNull(), "rejected").when(F.col("known"), "unchanged").otherwise("inserted")
    kept = F.when(F.col("reason").isNull(), F.col("registry"))
    return rows.select("workflow_id", "logical_key", "digest", "n_bytes", kept.alias("registry"), F.when(F.col("reason").isNull(), canonical_hash(F.col("registry"))).alias("fingerprint"), (F.col("expected").isNotNull() & F.col("reason").isNull()).alias("verified"), status.alias("status"), "reason")


def import_report(outcomes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Outcomes (status) of imports as one row: how many of each status, 0 where there are none, and whether none is conflicting or rejected."""
    counts = outcomes.groupBy(*keys).agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
    return counts.withColumn("succeeded", (F.col("conflicting") == 0) & (F.col("rejected") == 0))
