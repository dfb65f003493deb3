"""Connected components by alternating large-star and small-star steps.

All state is edges in tables of the shared folder. Minima are taken by partial
aggregation and attached by equi-joins whose small side has one row a node, so a
hub's edges never have to meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def _state(edges: DataFrame) -> tuple:
    """Order-free digest of an edge table."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(a, b) pairs of longs -> (node, component): the smallest node reachable.

    Only nodes that occur in a pair of two different nodes are returned; pairs with
    a null are ignored. An empty input gives an empty result.
    """
    spark = edges.sparkSession
    start = (
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    now, path = stored(start, "edges")
    state = _state(now)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after, new = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        was, state = state, _state(after)
        forget(spark, path)
        now, path = after, new
        if was == state:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
