"""Tables at which a lineage ends."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shared_folder(spark) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Without that
    setting, in local mode only, a folder of this machine is taken."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vellum-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def visible(spark) -> None:
    """Let local Python workers import this package wherever the driver was started. A
    cluster ships the package with --py-files as usual."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def settled(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def ranged(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` dealt over partitions by ranges of ``order``, stored, with its partition in
    _p and its place in _m: ranges and places are those of one run."""
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return settled(spread.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))


def running(df: DataFrame, order: Column | str, amount: str, name: str) -> DataFrame:
    """Sum of ``amount`` up to and with each row in ``order``, without one task for all
    rows: each range starts at the sum of those before it."""
    spread = ranged(df, order)
    sums = spread.groupBy("_p").agg(F.sum(amount).alias("_s"))
    before = sums.select(F.col("_p").alias("_q"), (F.sum("_s").over(Window.orderBy("_p")) - F.col("_s")).alias("_b"))  # one row a partition
    inside = F.sum(amount).over(Window.partitionBy("_p").orderBy("_m"))
    return spread.withColumn(name, inside).join(F.broadcast(before), F.col("_p") == F.col("_q")).withColumn(name, F.col(name) + F.col("_b")).drop("_p", "_m", "_q", "_b")


def ranked(counts: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, c) -> with upto, the count up to a value within its group, and _n, that of
    the group: one running sum by ranges over all groups, less what comes before a group's
    first value."""
    place = F.struct(*by, value)
    run = settled(running(settled(counts), place, "c", "_upto"))
    first = run.groupBy(*by).agg(F.min(F.col("_upto") - F.col("c")).alias("_first"), F.sum("c").alias("_n"))
    names = {c: f"_by_{i}" for i, c in enumerate(by)}
    start = first.select(*[F.col(c).alias(n) for c, n in names.items()], "_first", "_n")
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    return run.join(start, same).withColumn("upto", F.col("_upto") - F.col("_first")).drop(*names.values(), "_upto", "_first")
