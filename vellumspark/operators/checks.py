"""Constraints, inherited values, dictionary matches and small lookups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from .tables import settled

WIDTHS = {"F32": 4, "F16": 2, "BF16": 2, "I8": 1}


def violations(*checks: tuple[Column, str]) -> Column:
    """array<string>: names of the conditions that don't hold; null counts as not."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for ok, name in checks]), lambda v: v.isNotNull())


def directory_violations(dtype: Column, shape: Column, offset: Column, size: Column, payload: Column) -> Column:
    """A tensor's range lies in the payload and its bytes are what shape and dtype make."""
    width = F.create_map(*[F.lit(x) for kv in WIDTHS.items() for x in kv])[dtype]
    cells = F.aggregate(shape, F.lit(1).cast("long"), lambda a, d: a * d)
    return violations((width.isNotNull(), "dtype"), (width * cells == size, "bytes"), ((offset >= 0) & (offset + size <= payload), "range"))


def inherited(nodes: DataFrame, visited: int = 64) -> DataFrame:
    """(id, parent, value) -> (id, value): a node's own value or that of its nearest
    ancestor, of ``visited`` nodes on the way up (a power of two), itself the first.
    Pointers double, and every round is settled, so the joins are the logarithm."""
    if visited & (visited - 1) or visited < 1:
        raise ValueError("visited must be a power of two")
    now, reach = nodes.select("id", F.when(F.col("value").isNull(), F.col("parent")).alias("up"), "value"), 1
    while reach < visited:
        now = settled(now)
        above = now.select(F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("value").alias("_v"))
        joined = now.join(above, F.col("up") == F.col("_id"), "left")
        now = joined.select("id", F.when(F.col("value").isNull() & F.col("_v").isNull(), F.col("_up")).alias("up"), F.coalesce("value", "_v").alias("value"))
        reach *= 2
    return now.select("id", "value")


def last_largest(rows: DataFrame, by: str, size: Column, order: str) -> DataFrame:
    """Of a group the row of greatest size, the last of equals."""
    return rows.groupBy(by).agg(F.max_by(order, F.struct(size.alias("s"), F.col(order).alias("o"))).alias(order))


def matches(text: Column, entries: list[str]) -> Column:
    """Dictionary entries as they occur, the longest at each place, leftmost first."""
    escaped = ["\\Q" + e + "\\E" for e in sorted(set(entries), key=lambda e: (-len(e.encode()), e))]
    return F.regexp_extract_all(text, F.lit("|".join(escaped)), 0)


def both_ways(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, n): rows of one that the other lacks, repeats counted."""
    return a.exceptAll(b).select(F.lit("left").alias("side")).unionAll(b.exceptAll(a).select(F.lit("right").alias("side"))).groupBy("side").agg(F.count("*").alias("n"))


def stacked(*blocks: DataFrame) -> DataFrame:
    """Blocks of equal columns under another, with their ordinal."""
    out = None
    for k, b in enumerate(blocks):
        rows = b.withColumn("block", F.lit(k))
        out = rows if out is None else out.unionByName(rows)
    return out


def _beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    from math import exp, lgamma, log

    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(b, a, 1 - x)
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > 1e-300 else 1e-300)
    h = d
    for m in range(1, 300):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            c = 1 + term / c
            d = 1 / (d if abs(d) > 1e-300 else 1e-300)
            c = c if abs(c) > 1e-300 else 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a * h


@F.pandas_udf(DoubleType())
def beta_quantile(a: pd.Series, b: pd.Series, p: pd.Series) -> pd.Series:
    """By bisection; the incomplete beta function is no built-in."""

    def solve(a: float, b: float, p: float) -> float:
        low, high = 0.0, 1.0
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if _beta_tail(a, b, mid) < p else (low, mid)
        return (low + high) / 2

    return pd.Series([solve(*t) for t in zip(a, b, p, strict=True)], dtype=float)


@F.pandas_udf(LongType())
def ulps(a: pd.Series, b: pd.Series) -> pd.Series:
    """Greatest distance of two float arrays in units of the last place; numbers of both
    signs lie on one line."""

    def line(v) -> np.ndarray:
        bits = np.asarray(v, "<f4").view("<i4").astype(np.int64)
        return np.where(bits < 0, -(bits & 0x7FFFFFFF), bits)

    return pd.Series([int(np.abs(line(x) - line(y)).max(initial=0)) for x, y in zip(a, b, strict=True)])
