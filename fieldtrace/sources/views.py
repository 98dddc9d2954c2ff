"""Domain tables over the given tables: detections, a path, colours, history, jobs. Every column is a plain projection, so that
filters and pruning reach the Parquet scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey DIV 500 AS clip_id", "l_orderkey % 500 AS source_frame", "CASE WHEN l_returnflag = 'R' THEN 'sports ball' ELSE 'person' END AS class_name",
        "CAST(l_partkey % 100 AS DOUBLE) / 100 AS confidence", "CAST(l_partkey % 1000 AS DOUBLE) AS x1", "CAST((l_suppkey * 7) % 500 AS DOUBLE) AS y1",
        "CAST(l_partkey % 1000 AS DOUBLE) + 10 + l_quantity AS x2", "CAST((l_suppkey * 7) % 500 AS DOUBLE) + 20 + l_linenumber * 10 AS y2",
        "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice",
    )


def path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").selectExpr(
        "event_id DIV 500 AS clip_id", "event_id % 500 AS source_frame", "CAST(event_id % 500 AS DOUBLE) / 25 AS clip_seconds", "user_id % 12 AS track_id",
        "CASE WHEN user_id % 2 = 0 THEN 'red' ELSE 'black' END AS team", "value * 4 AS x", "CAST(user_id * 3 AS DOUBLE) AS y", "event_type", "value / 100 AS control_ratio",
    )


def colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    channel = lambda k: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(127.5 + 300 * F.col("embedding")[k].cast("double")))).cast("long")
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("track_id"), "label", channel(0).alias("b"), channel(1).alias("g"), channel(2).alias("r"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").selectExpr("conv_id % 2 AS workflow_id", "conv_id AS segment_id", "turn AS ordinal", "CASE WHEN role = 'user' THEN 'M' ELSE 'E' END AS stream", "role AS event_key", "CAST(length(text) AS BIGINT) AS payload_chars")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").selectExpr("o_orderkey AS job_id", "o_custkey % 5 AS workflow_id", "o_orderstatus AS status", "CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority_rank", "o_orderdate AS created_at")


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of tracked players with shares of colours on their shirts."""
    return _table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey DIV 500 AS clip_id", "l_orderkey % 500 AS source_frame", "CAST(l_orderkey % 500 AS DOUBLE) / 25 AS clip_seconds", "l_suppkey % 12 AS track_id", "CASE WHEN l_suppkey % 2 = 0 THEN 'red' ELSE 'black' END AS team",
        "CAST(l_partkey % 400 - 16 AS DOUBLE) AS x1", "CAST(l_suppkey * 7 % 300 - 40 - l_linenumber * 10 AS DOUBLE) AS y1", "CAST(l_partkey % 400 + 16 AS DOUBLE) AS x2", "CAST(l_suppkey * 7 % 300 AS DOUBLE) AS y2",
        "CAST((l_partkey + l_suppkey) % 8 AS DOUBLE) / 16 AS dark", "CAST(l_partkey % 5 AS DOUBLE) / 16 AS warm", "CAST(l_partkey % 7 AS DOUBLE) / 16 AS white", "CAST(l_suppkey % 9 AS DOUBLE) / 16 AS yellow", "CAST(l_suppkey % 7 AS DOUBLE) / 16 AS blue",
        "l_partkey", "l_linenumber",
    )


def balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ball a frame, moving back and forth; estimated where the event is a signup."""
    return _table(spark, sf_dir, "events").selectExpr(
        "event_id DIV 500 AS clip_id", "event_id % 500 AS source_frame", "CAST(event_id % 500 AS DOUBLE) / 25 AS clip_seconds", "1L AS track_id",
        "CAST(abs((event_id % 500 * 7 + user_id % 32) % 800 - 400) AS DOUBLE) AS x", "CAST(abs((event_id % 500 * 5 + user_id % 16) % 600 - 300) AS DOUBLE) AS y",
        "event_type <> 'signup' AS eligible", "event_type AS state", "value AS uncertainty", "user_id",
    )


#: The same as SQL.
SQL = {
    "det": """det AS (SELECT l_orderkey // 500 AS clip_id, l_orderkey % 500 AS source_frame, CASE WHEN l_returnflag = 'R' THEN 'sports ball' ELSE 'person' END AS class_name,
      CAST(l_partkey % 100 AS DOUBLE) / 100 AS confidence, CAST(l_partkey % 1000 AS DOUBLE) AS x1, CAST((l_suppkey * 7) % 500 AS DOUBLE) AS y1,
      CAST(l_partkey % 1000 AS DOUBLE) + 10 + l_quantity AS x2, CAST((l_suppkey * 7) % 500 AS DOUBLE) + 20 + l_linenumber * 10 AS y2, l_partkey, l_suppkey, l_linenumber, l_extendedprice FROM lineitem)""",
    "pth": """pth AS (SELECT event_id // 500 AS clip_id, event_id % 500 AS source_frame, CAST(event_id % 500 AS DOUBLE) / 25 AS clip_seconds, user_id % 12 AS track_id,
      CASE WHEN user_id % 2 = 0 THEN 'red' ELSE 'black' END AS team, value * 4 AS x, CAST(user_id * 3 AS DOUBLE) AS y, event_type, value / 100 AS control_ratio FROM events)""",
    "col": """col AS (SELECT vec_id AS track_id, label, CAST(greatest(0, least(255, floor(127.5 + 300 * CAST(embedding[1] AS DOUBLE)))) AS BIGINT) AS b,
      CAST(greatest(0, least(255, floor(127.5 + 300 * CAST(embedding[2] AS DOUBLE)))) AS BIGINT) AS g, CAST(greatest(0, least(255, floor(127.5 + 300 * CAST(embedding[3] AS DOUBLE)))) AS BIGINT) AS r FROM embeddings)""",
    "his": "his AS (SELECT conv_id % 2 AS workflow_id, conv_id AS segment_id, turn AS ordinal, CASE WHEN role = 'user' THEN 'M' ELSE 'E' END AS stream, role AS event_key, length(text) AS payload_chars FROM conversations)",
    "pla": """pla AS (SELECT l_orderkey // 500 AS clip_id, l_orderkey % 500 AS source_frame, CAST(l_orderkey % 500 AS DOUBLE) / 25 AS clip_seconds, l_suppkey % 12 AS track_id, CASE WHEN l_suppkey % 2 = 0 THEN 'red' ELSE 'black' END AS team,
      CAST(l_partkey % 400 - 16 AS DOUBLE) AS x1, CAST(l_suppkey * 7 % 300 - 40 - l_linenumber * 10 AS DOUBLE) AS y1, CAST(l_partkey % 400 + 16 AS DOUBLE) AS x2, CAST(l_suppkey * 7 % 300 AS DOUBLE) AS y2,
      CAST((l_partkey + l_suppkey) % 8 AS DOUBLE) / 16 AS dark, CAST(l_partkey % 5 AS DOUBLE) / 16 AS warm, CAST(l_partkey % 7 AS DOUBLE) / 16 AS white, CAST(l_suppkey % 9 AS DOUBLE) / 16 AS yellow, CAST(l_suppkey % 7 AS DOUBLE) / 16 AS blue, l_partkey, l_linenumber FROM lineitem)""",
    "bal": """bal AS (SELECT event_id // 500 AS clip_id, event_id % 500 AS source_frame, CAST(event_id % 500 AS DOUBLE) / 25 AS clip_seconds, 1::BIGINT AS track_id,
      CAST(abs((event_id % 500 * 7 + user_id % 32) % 800 - 400) AS DOUBLE) AS x, CAST(abs((event_id % 500 * 5 + user_id % 16) % 600 - 300) AS DOUBLE) AS y, event_type <> 'signup' AS eligible, event_type AS state, value AS uncertainty, user_id FROM events)""",
    "job": "job AS (SELECT o_orderkey AS job_id, o_custkey % 5 AS workflow_id, o_orderstatus AS status, CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority_rank, o_orderdate AS created_at FROM orders)",
}
