"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word, for every operator whose contract counts words.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local runs one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = folder.get() if folder.isDefined() else tempfile.mkdtemp(prefix="spark-shared-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


WRITTEN: list[str] = []


def stored(df: DataFrame, name: str, times: int = 1) -> DataFrame | list[DataFrame]:
    """df, written once as a table in the shared folder and read from there: smaller than a checkpoint, and pruned by column. release() deletes it.

    With times above 1 as many frames that read it, which can be cogrouped with each other.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    WRITTEN.append(path)
    read = [df.sparkSession.read.schema(df.schema).parquet(path) for _ in range(times)]
    return read[0] if times == 1 else read


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Deletes what stored() has written in this session; for use when the results made of it have been read."""
    while WRITTEN:
        delete(spark, WRITTEN.pop())


def task_groups(spark: SparkSession) -> int:
    """Into how many groups work is dealt: follows the shuffle partitions, which follow the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def small_batches(spark: SparkSession, rows: int = 2000, size: str = "8m") -> None:
    """Arrow batches of at most so many rows and bytes from here on, so that tables of long texts need no more memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def tidy() -> None:
    """Gives memory that a task no longer uses back to the machine: Python workers outlive their tasks, and several wait beside those at work."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim()


def trim() -> None:
    """The same for what the C library keeps, where it can."""
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if free is not None:
        free(0)


def packed(df: DataFrame, keep: Sequence[str] | None = None, **computed: Column) -> DataFrame:
    """The columns to keep (all, unless given) of df inside the one column `row`, beside computed columns: no names can clash."""
    return df.select(F.struct(*[df[c] for c in (df.columns if keep is None else keep)]).alias("row"), *[c.alias(n) for n, c in computed.items()])


def unpacked(df: DataFrame, columns: Sequence[str], added: Sequence[str]) -> DataFrame:
    """The columns that packed() put away, then the added ones, which win where names clash."""
    taken = {c.lower() for c in added}
    return df.select(*[F.col("row").getField(c).alias(c) for c in columns if c.lower() not in taken], *added)


def ranked(df: DataFrame, groups: Sequence[str], bucket: str, order: Sequence[Column], name: str) -> DataFrame:
    """Adds the 0-based rank of each row in its group, by bucket and then by order.

    No task gets a whole group: rows are numbered in their (group, bucket), and the buckets' counts,
    few to a group, are summed up. Groups and bucket must not be null.
    """
    keys = [*groups, bucket]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_"))
    before = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"))
    own = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("own_", own).join(starts, keys).withColumn(name, F.col("start_") + F.col("own_")).drop("start_", "own_")


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of edges (src, dst longs): component is the smallest node reachable.

    Large-star and small-star rounds, each two aggregations by node, until nothing moves. A node's
    edges are never gathered: a star is a minimum over its edges, joined back, and joins of a hot
    node can be split by the adaptive planner.
    """
    edges = cut(edges.where("src != dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"))
        large = both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        large = large.where("src != dst").distinct()
        low = large.groupBy("src").agg(F.min("dst").alias("low"))
        joined = large.join(low, "src")
        small = joined.where("dst != low").select(F.col("dst").alias("src"), F.col("low").alias("dst")).unionByName(low.select("src", F.col("low").alias("dst"))).distinct()
        small = cut(small)
        same = small.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")).first()
        was = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")).first()
        edges = small
        if same == was:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(edges.select(F.col("dst").alias("node"), F.col("dst").alias("component"))).distinct()
