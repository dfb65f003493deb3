"""Sums of doubles without rounding on the way, the same for any partitioning.

A double is a whole number of 55 bits at most times a power of two. Whole numbers of one
power are summed as decimals, which Spark's partial aggregation merges in any order; the
powers of a group, a couple of thousand at most, are added as integers and rounded once.
"""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import visible

#: The least power of two of a double.
LEAST = -1074


def _parts(x: Column) -> tuple[Column, Column]:
    """(power, whole) with x = whole * 2 ** power, exactly. The scale is applied in halves,
    as 2 ** -power alone may be too large for a double."""
    power = F.greatest(F.floor(F.log2(F.abs(x))) - 53, F.lit(LEAST)).cast("int")
    half = F.floor(-power / 2)
    whole = x * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), -power - half)
    return F.when(x == 0, 0).when(x.isNotNull(), power), F.when(x == 0, 0).otherwise(whole.cast("long"))


def _rounded(powers: pd.Series) -> pd.Series:
    def one(parts) -> float | None:
        total = sum((int(p["whole"]) * Fraction(2) ** int(p["power"]) for p in parts), Fraction(0))
        try:
            return float(total)
        except OverflowError:
            return float("inf") if total > 0 else float("-inf")

    return powers.map(one)


def exact_sums(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, total, mean, n) of the values that are not null: the total is the exact sum
    rounded once, the mean is total / n. A group with an infinite value or NaN has Spark's
    own sum; one of nulls only has none."""
    visible(rows.sparkSession)
    x = F.col(value).cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    power, whole = _parts(F.when(finite, x))
    marked = rows.select(*by, power.alias("_power"), whole.alias("_whole"), F.when(~finite, x).alias("_odd"), x.isNotNull().cast("long").alias("_one"))
    parts = marked.groupBy(*by, "_power").agg(F.sum(F.col("_whole").cast("decimal(28,0)")).alias("_whole"), F.sum("_odd").alias("_odd"), F.sum("_one").alias("_one"))
    add = F.pandas_udf(_rounded, "double")
    some = F.when(F.col("_power").isNotNull(), F.struct(F.col("_power").alias("power"), F.col("_whole").alias("whole")))
    sums = parts.groupBy(*by).agg(F.collect_list(some).alias("_parts"), F.sum("_odd").alias("_odd"), F.sum("_one").alias("n"))
    total = F.when(F.col("n") > 0, F.coalesce(F.col("_odd"), F.col("_sum")))
    done = sums.withColumn("_sum", add("_parts")).withColumn("total", total)
    return done.select(*by, "total", (F.col("total") / F.col("n")).alias("mean"), "n")
