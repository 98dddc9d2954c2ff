"""Tables that several later steps read: computed once, and kept where a lost executor cannot take them; and how work is dealt to tasks."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> None:
    """Sets the folder of checkpoints: spark.checkpoint.dir, which a cluster must have set; in local runs without it one of our own."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
    context.setCheckpointDir(folder)


def once(df: DataFrame) -> DataFrame:
    """df, computed now and read from its checkpoint by all that follows; a plan that uses it twice does not compute it twice."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df, dealt by its keys to as many tasks as there are shuffle partitions, or cores if these are more.

    Spark joins partitions of few bytes to one task, however long each row takes there and however much it grows in sorts and lists; where the number is given, it does not.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)
