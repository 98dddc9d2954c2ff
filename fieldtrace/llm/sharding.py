"""Sharding by vector bin packing: bytes, words and rows balanced together."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrace.llm.common import WORD, cut, packed, ranked, unpacked

ADDED = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
LOADS = ["bytes", "words", "rows"]
#: What a load counts for in the dot product: the law is that of bytes.
WEIGHTS = np.array([1.0, 0.5, 0.5])
#: A group of equal texts with more than 1 / (shards * FINE) of any total is cut into pieces of about that share.
FINE = 64
#: Groups that one task packs, about.
BLOCK = 50_000


def place(loads: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The bin of each item: largest items first, each where its load's dot product with the bins' room is highest."""
    unit = np.maximum(room.sum(axis=0), 1e-12)
    loads, left = loads / unit * WEIGHTS, room / unit * WEIGHTS
    bins = np.empty(len(loads), np.int32)
    for i in np.lexsort((np.arange(len(loads)), -loads.max(axis=1))) if len(loads) else ():
        bins[i] = best = int(np.argmax(left @ loads[i]))
        left[best] -= loads[i]
    return bins


def shard(docs: DataFrame, shards: int = 24, keep: Sequence[str] | None = None) -> DataFrame:
    """docs (doc_id, text, ...) plus size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    Equal texts form a group and stay together, unless the group holds more than 1/64 of a shard: then it is cut
    into pieces by a hash of doc_id. Those large pieces are few (at most 3 * 64 * shards and one for each heavy
    group) and are packed first, in one task; the others are packed in blocks of about 50,000 groups, each
    block into its share of the room that is left. So no step holds more than a block, and the shards' sizes differ
    by about one small document for each block.

    size is the text's UTF-8 bytes plus 8. A null text counts as an empty one: 8 bytes, crc32 0, one group.
    Rows with equal texts and a null doc_id share a piece. Repeated rows are placed one by one. An empty table gives an
    empty table. Columns of docs named like an added column are replaced. slot numbers the rows of a shard from 0.
    keep names the columns of docs to return, all unless given; texts that aren't kept are not shuffled.
    """
    text = F.coalesce("text", F.lit(""))
    rows = packed(
        docs, keep, size=F.octet_length(text) + F.lit(8).cast("long"), words=F.regexp_count(text, F.lit(WORD)).cast("long"), text_crc32=F.crc32(text.cast("binary")),
        group=F.xxhash64(text), spread=F.coalesce(F.xxhash64("doc_id"), F.lit(0)),
    )
    keyed = cut(rows.select("group", "spread", "size", "words"))
    sums = [F.sum("size").alias("bytes"), F.sum("words").alias("words"), F.count(F.lit(1)).alias("rows")]
    total = keyed.agg(*sums, F.count_distinct(F.pmod("group", F.lit(1 << 20))).alias("seen")).first()
    if not total["rows"]:
        total = {"bytes": 1, "words": 1, "rows": 1, "seen": 1}
    whole = np.array([max(1, total[c] or 0) for c in LOADS], float)
    share = F.greatest(*[F.col(c) / float(w) for c, w in zip(LOADS, whole, strict=True)]) * (shards * FINE)
    groups = cut(keyed.groupBy("group").agg(*sums))
    # At most 3 * shards * FINE rows by construction, so their broadcast has a bound.
    heavy = F.broadcast(groups.where(share > 1).select("group", F.ceil(share).cast("long").alias("pieces")))

    def with_piece(df: DataFrame) -> DataFrame:
        return df.join(heavy, "group", "left").withColumn("piece", F.when(F.col("pieces").isNotNull(), F.pmod("spread", "pieces")).otherwise(F.lit(-1))).drop("pieces")

    pieces = cut(keyed.join(heavy.select("group"), "group", "left_semi").transform(with_piece).groupBy("group", "piece").agg(*sums))
    small = groups.join(heavy.select("group"), "group", "left_anti").withColumn("piece", F.lit(-1).cast("long"))

    def first_pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(frames)).sort_values(["group", "piece"])
        yield pdf.assign(shard=place(pdf[LOADS].to_numpy(float), np.tile(whole / shards, (shards, 1))))

    schema = "group long, piece long, bytes long, words long, rows long, shard int"
    packed_first = cut(pieces.coalesce(1).mapInPandas(first_pack, schema)) if pieces.head(1) else pieces.withColumn("shard", F.lit(0)).limit(0)
    used = np.zeros((shards, 3))
    for r in packed_first.groupBy("shard").agg(*[F.sum(c).alias(c) for c in LOADS]).collect():  # a row a shard
        used[r["shard"]] = [r[c] for c in LOADS]
    room = np.maximum(whole / shards - used, 1e-9)

    blocks = max(1, round(max(total["seen"], total["rows"] / 8 if total["seen"] > 1 << 19 else 0) / BLOCK))

    def pack_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["group", "piece"])
        loads = pdf[LOADS].to_numpy(float)
        own = room / room.sum(axis=0) * np.maximum(loads.sum(axis=0), 1e-9)
        turn = int(pdf["group"].iloc[0]) % shards  # blocks break ties at different bins
        bins = (place(loads, np.roll(own, -turn, axis=0)) + turn) % shards
        return pdf[["group", "piece"]].assign(shard=bins.astype(np.int32))

    rest = small.groupBy(F.pmod(F.xxhash64(F.lit("block"), "group"), F.lit(blocks))).applyInPandas(pack_block, "group long, piece long, shard int")
    placed = cut(packed_first.select("group", "piece", "shard").unionByName(rest))
    sharded = with_piece(rows).join(placed, ["group", "piece"])
    sharded = ranked(sharded.withColumn("bucket", F.pmod("spread", F.lit(4096))), ["shard"], "bucket", [F.col("spread"), F.col("group")], "slot")
    sharded = sharded.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))
    return unpacked(sharded, docs.columns if keep is None else keep, ADDED)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard(docs, keep=["doc_id"]).select("doc_id", *ADDED)
