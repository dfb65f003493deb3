"""Separable resampling of grids: a sparse table of weights is joined once per axis."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fraction bits of fixed-point weights, and the filter's half width (fixed values).
BITS, SUPPORT = 22, 2.0
WEIGHTS = "to int, at int, w long"
CURVE = -0.75


def _cubic(x: float, a: float) -> float:
    x = abs(x)
    if x < 1:
        return ((a + 2) * x - (a + 3)) * x * x + 1
    return (((x - 5) * x + 8) * x - 4) * a if x < 2 else 0.0


def fixed_weights(spark: SparkSession, size: int, new: int) -> DataFrame:
    """(to, at, w): what place ``at`` of ``size`` gives to place ``to`` of ``new``, in units
    of 2 ** -BITS; wider windows where the axis shrinks. The table is as long as the axis."""
    scale = size / new
    wide = max(scale, 1.0)
    rows = []
    for to in range(new):
        centre = (to + 0.5) * scale
        first, last = max(int(centre - SUPPORT * wide + 0.5), 0), min(int(centre + SUPPORT * wide + 0.5), size)
        own = [_cubic((at - centre + 0.5) * (1 / wide), -0.5) for at in range(first, last)]
        total = 0.0
        for w in own:
            total += w
        for at, w in zip(range(first, last), own, strict=True):
            w = w / total if total else w
            rows.append((to, at, int(math.copysign(0.5, w) + w * (1 << BITS)) if w else 0))
    return spark.createDataFrame(rows, WEIGHTS)


def clipped(total: Column) -> Column:
    """A fixed-point sum, its half already added, as a byte."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.shiftright(total, BITS))).cast("int")


def _axis(cells: DataFrame, axis: str, weights: DataFrame, key: list[str]) -> DataFrame:
    others = [c for c in (*key, "y", "x") if c != axis]
    met = cells.join(weights, F.col(axis) == F.col("at"))
    return met.groupBy(*others, F.col("to").alias(axis)).agg(F.sum(F.col("v") * F.col("w")).alias("v")).select(*key, "y", "x", "v")


def resized(cells: DataFrame, height: int, width: int, to_height: int, to_width: int, key: list[str]) -> DataFrame:
    """(key, y, x, v of 0 to 255) at a new size, with bytes between the two passes, first
    across, then down; an axis whose size stays is left alone. Places without a cell are 0."""
    if min(to_height, to_width) < 1:
        raise ValueError("a size must be at least 1")
    spark = cells.sparkSession
    out = cells.select(*key, "y", "x", F.col("v").cast("long").alias("v"))
    for axis, size, new in (("x", width, to_width), ("y", height, to_height)):
        if size != new:
            out = _axis(out, axis, fixed_weights(spark, size, new), key).withColumn("v", clipped(F.col("v") + (1 << (BITS - 1))).cast("long"))
    return out.withColumn("v", F.col("v").cast("int"))


def curve_weights(spark: SparkSession, size: int, new: int) -> DataFrame:
    """(to, at, w) of four neighbours, places beyond an edge being the edge."""
    rows: dict[tuple[int, int], float] = {}
    for to in range(new):
        centre = (to + 0.5) * size / new - 0.5
        base = math.floor(centre)
        for k in range(-1, 3):
            at = min(max(base + k, 0), size - 1)
            rows[to, at] = rows.get((to, at), 0.0) + _cubic(centre - base - k, CURVE)
    return spark.createDataFrame([(*k, w) for k, w in rows.items()], "to int, at int, w double")


def position_table(rows: DataFrame, positions: int, length: int) -> DataFrame:
    """(pos, c, v) for a sequence of ``length``: position 0 passes, the others are a square
    grid that is resampled to another square; sizes that are no squares are an error."""
    size, new = math.isqrt(positions - 1), math.isqrt(length - 1)
    if size * size != positions - 1 or new * new != length - 1:
        raise ValueError("positions beside the first must be a square grid")
    if size == new:
        return rows
    spark = rows.sparkSession
    grid = rows.where("pos > 0").select("c", F.floor((F.col("pos") - 1) / size).cast("int").alias("y"), ((F.col("pos") - 1) % size).cast("int").alias("x"), "v")
    weights = curve_weights(spark, size, new)
    out = _axis(_axis(grid, "x", weights, ["c"]), "y", weights, ["c"])
    return rows.where("pos = 0").unionByName(out.select((F.col("y") * new + F.col("x") + 1).cast("long").alias("pos"), "c", "v"))
