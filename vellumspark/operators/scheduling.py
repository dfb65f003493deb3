"""Ordering and sizing of work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import ranged


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Row numbers over a total order, without one task for all rows: rows are sorted
    across partitions, and each partition starts where those before it end."""
    spread = ranged(rows, *order)
    counts = spread.groupBy("_p").agg(F.count("*").alias("n"))
    before = counts.select(F.col("_p").alias("_q"), (F.sum("n").over(Window.orderBy("_p")) - F.col("n")).alias("_b"))  # one row a partition
    inside = F.row_number().over(Window.partitionBy("_p").orderBy("_m"))
    return spread.withColumn("_r", inside).join(F.broadcast(before), F.col("_p") == F.col("_q")).withColumn(name, (F.col("_b") + F.col("_r")).cast("int")).drop("_p", "_m", "_q", "_b", "_r")


def batch_size(setting: str | None, default: int = 128, most: int = 256) -> int:
    """Blank, zero and anything that is no number mean the default."""
    try:
        n = int((setting or "").strip())
    except ValueError:
        n = 0
    return min(n, most) if n > 0 else default


def batch_sizes(setting: Column, default: int = 128, most: int = 256) -> Column:
    """batch_size of a column of settings."""
    bare = F.btrim(setting)
    said = F.when(bare.rlike("^[0-9]+$"), F.try_to_number(bare, F.lit("9" * 18)).cast("long"))
    return F.when(said > 0, F.least(said, F.lit(most))).otherwise(default)


def in_order(results: DataFrame, index: str) -> DataFrame:
    """Results in the order of their inputs; each input must have exactly one."""
    twice = results.groupBy(index).agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select(F.col(index).alias("_twice"))
    checked = results.join(twice, F.col(index) == F.col("_twice"), "left")
    ok = F.when(F.col("_twice").isNotNull(), F.raise_error(F.concat(F.lit("two results for "), F.col("_twice").cast("string"))).cast("boolean")).otherwise(True)
    return checked.where(ok).drop("_twice").orderBy(index)
