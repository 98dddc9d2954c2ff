"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldtrace.llm.common import WORD, cut, packed, ranked, unpacked

ADDED = ["size", "source_size", "target", "copies", "taken"]
#: Rows of one source and size are numbered in this many buckets by document number.
BUCKETS = 1024
#: Offsets drawn for each source.
DRAWS = 32


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeat: int = 3, seed: int = 7, keep: Sequence[str] | None = None) -> DataFrame:
    """How often a mix takes each document: docs (doc_id, text, source, ...) plus size, source_size, target, copies, taken.

    size counts the words of the text. Sources in code point order, null last, weigh `weights` in turn
    and share all sizes; no target exceeds max_repeat times its source, and what is over goes to the others
    by weight. Within a source every document expects target / source_size copies. Documents stand in the
    order of size, so that the systematic sample is also spread over sizes and the words taken stay within
    one document of the target; the prefix sums of expected copies, plus one random offset per source, give
    a copy at each integer they cross. The offset is the best of 32 drawn from the seed.

    keep names the columns of docs to return, all unless given; texts that aren't kept are not shuffled.
    Null or empty texts have size 0 and take 0 words. A source without words gets target 0. Null sources
    form one source, null doc_ids one bucket. Repeated rows are sampled one by one. Columns of docs named
    like an added column are replaced. An empty table gives an empty table.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = packed(
        docs, keep, size=size, source_=F.struct(F.col("source").isNull().alias("missing"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("name")),
        bucket_=F.coalesce(F.pmod(F.col("doc_id"), F.lit(BUCKETS)), F.lit(0)), doc_=F.col("doc_id"),
    )
    counted = cut(rows.groupBy("source_", "size", "bucket_").agg(F.count(F.lit(1)).alias("n")))
    sized = counted.groupBy("source_", "size").agg(F.sum("n").alias("n"))

    # One row a source from here to `targets`.
    order = Window.orderBy("source_")
    sources = sized.groupBy("source_").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = sources.withColumn("weight", weight.cast("long")).withColumn("cap", max_repeat * F.col("source_size"))
    tightest = Window.orderBy(F.col("cap") / F.col("weight"), "source_")
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(tightest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum("weight").over(tightest.rowsBetween(0, Window.unboundedFollowing))
    targets = sources.withColumn("level", level).withColumn("level", F.max("level").over(Window.partitionBy()))
    targets = targets.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")))
    targets = targets.select("source_", "source_size", "target", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)).alias("rate"))

    smaller = Window.partitionBy("source_").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(sized.select("source_", "size", "n", F.coalesce(F.sum("n").over(smaller), F.lit(0)).alias("smaller")).join(targets, "source_"))
    # Of a few drawn offsets the one whose sample comes nearest to the target: the rows of one source and size
    # stand together, so that a table of sizes tells what each offset would take.
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("draw").cast("string"), F.lit(":"), F.col("source_.name"))), 1, 3), 16, 10).cast("double") / 4096
    tried = starts.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(DRAWS)))).withColumn("offset", drawn)
    crossed = F.floor((F.col("smaller") + F.col("n")) * F.col("rate") + F.col("offset")) - F.floor(F.col("smaller") * F.col("rate") + F.col("offset"))
    tried = tried.groupBy("source_", "draw", "offset", "target").agg(F.sum(crossed * F.col("size")).alias("takes"))
    best = tried.groupBy("source_").agg(F.min_by("offset", F.struct(F.abs(F.col("takes") - F.col("target")), "draw")).alias("offset"))
    starts = starts.join(best, "source_")
    placed = ranked(rows, ["source_", "size"], "bucket_", [F.col("doc_")], "own").join(starts, ["source_", "size"])
    at = F.col("smaller") + F.col("own")
    crossed = F.floor((at + 1) * F.col("rate") + F.col("offset")) - F.floor(at * F.col("rate") + F.col("offset"))
    placed = placed.withColumn("copies", F.least(crossed, F.ceil("rate")).cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    return unpacked(placed, docs.columns if keep is None else keep, ADDED)


def repeated(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each row of mix() as often as it is taken."""
    return mixed.where("copies > 0").withColumn("copy_", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs, keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken", "copies")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source
), w AS (
  SELECT *, i % 3 + 1 AS weight, 3 * source_size AS cap, row_number() OVER (ORDER BY 3 * source_size / (i % 3 + 1), i) AS k FROM s
), l AS (
  SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT
    / (sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level FROM w
), t AS (
  SELECT source, source_size, least(cap::DOUBLE, weight * (SELECT max(level) FROM l)) AS target FROM l
), r AS (
  SELECT d.doc_id, d.size, t.source, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id % 1024, d.doc_id) - 1 AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), o AS (
  SELECT source, draw, shift, abs(sum(size * (floor((pos + 1) * rate + shift) - floor(pos * rate + shift))) - any_value(target)) AS miss
  FROM (SELECT *, ('0x' || substr(md5('7:' || draw || ':' || coalesce(source, '')), 1, 3))::BIGINT / 4096.0::DOUBLE AS shift FROM r, range(1, 33) AS x(draw))
  GROUP BY source, draw, shift
), b AS (
  SELECT source, shift FROM o QUALIFY row_number() OVER (PARTITION BY source ORDER BY miss, draw) = 1
)
SELECT doc_id, size, source_size, target,
  size * least(floor((pos + 1) * rate + shift) - floor(pos * rate + shift), ceil(rate))::BIGINT AS taken,
  least(floor((pos + 1) * rate + shift) - floor(pos * rate + shift), ceil(rate))::BIGINT AS copies
FROM r JOIN b ON r.source IS NOT DISTINCT FROM b.source
"""
