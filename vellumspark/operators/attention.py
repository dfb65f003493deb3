"""Queries over the keys of a stream: a frozen prefix and a ring of the latest others.

A query's scores are folded block by block into (greatest score, sum of exponentials,
weighted values), and such partial folds merge in any order and grouping. Blocks of keys
are what a join meets on, so a long stream is dealt over tasks and no window walks it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RING, BLOCK = 128, 128


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def positions(rows: DataFrame, stream: list[str], order: list[str]) -> DataFrame:
    """With ``pos``, the place in the stream from 0."""
    return rows.withColumn("pos", (F.row_number().over(Window.partitionBy(*stream).orderBy(*order)) - 1).cast("long"))


def _scaled(values: Column, by: Column) -> Column:
    return F.transform(values, lambda v: v * by)


def _folded(parts: Column) -> Column:
    """Fold of an array of folds: each is scaled to the greatest score of all."""
    top = F.array_max(F.transform(parts, lambda p: p["m"]))
    low = F.aggregate(parts, F.lit(0.0), lambda s, p: s + p["l"] * F.exp(p["m"] - top))
    zero = _scaled(parts[0]["acc"], F.lit(0.0))
    acc = F.aggregate(parts, zero, lambda s, p: F.zip_with(s, _scaled(p["acc"], F.exp(p["m"] - top)), lambda x, y: x + y))
    return F.struct(top.alias("m"), low.alias("l"), acc.alias("acc"))


def partial_folds(queries: DataFrame, keys: DataFrame, stream: list[str], prefix: int, ring: int = RING, block: int = BLOCK, scale: float = 1.0) -> DataFrame:
    """(stream, pos, fold) a query and block of keys: the keys at positions below ``prefix``
    and the last ``ring`` others up to the query's own position. Queries: (stream, pos, q);
    keys: (stream, pos, k, v). Queries never meet keys of other streams."""
    lowest, highest = F.greatest(F.col("pos") - ring + 1, F.lit(prefix)), F.col("pos")
    # position blocks below the prefix, and those that the ring touches; each once
    head = F.sequence(F.lit(0), F.lit(max(prefix - 1, 0) // block)) if prefix else F.array().cast("array<int>")
    tail = F.when(lowest <= highest, F.sequence(F.floor(lowest / block).cast("int"), F.floor(highest / block).cast("int"))).otherwise(F.array().cast("array<int>"))
    asking = queries.select(*[F.col(c).alias(f"_{c}") for c in stream], "pos", "q", F.explode(F.array_distinct(F.concat(head, tail))).alias("_block"))
    held = keys.select(*stream, F.col("pos").alias("_at"), "k", "v", F.floor(F.col("pos") / block).cast("int").alias("_in"))
    seen = (F.col("_at") <= F.col("pos")) & ((F.col("_at") < prefix) | (F.col("_at") > F.col("pos") - ring))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in stream] + [F.col("_block") == F.col("_in"), seen]
    one = F.struct((dot(F.col("q"), F.col("k")) * scale).alias("m"), F.lit(1.0).alias("l"), F.transform("v", lambda x: x.cast("double")).alias("acc"))
    met = asking.join(held, on).select(*stream, "pos", "_block", one.alias("_one"))
    # a group holds at most the keys of a block
    return met.groupBy(*stream, "pos", "_block").agg(F.collect_list("_one").alias("_all")).select(*stream, "pos", _folded(F.col("_all")).alias("fold"))


def attend(queries: DataFrame, keys: DataFrame, stream: list[str], prefix: int, ring: int = RING, block: int = BLOCK, scale: float = 1.0) -> DataFrame:
    """(stream, pos, top, total, attended): greatest score, sum of exponentials over it, and
    the softmax-weighted mean of values. A query without keys has no row."""
    folds = partial_folds(queries, keys, stream, prefix, ring, block, scale)
    whole = folds.groupBy(*stream, "pos").agg(F.collect_list("fold").alias("_folds")).select(*stream, "pos", _folded(F.col("_folds")).alias("f"))
    return whole.select(*stream, "pos", F.col("f.m").alias("top"), F.col("f.l").alias("total"), _scaled(F.col("f.acc"), 1 / F.col("f.l")).alias("attended"))


def drafts(positioned: DataFrame, stream: list[str], many: int) -> DataFrame:
    """The last ``many`` positions of each stream: each of them, as a query, sees what lies
    before it and itself, and none of the drafts after it."""
    last = positioned.groupBy(*[F.col(c).alias(f"_{c}") for c in stream]).agg(F.max("pos").alias("_last"))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in stream] + [F.col("pos") > F.col("_last") - many]
    return positioned.join(last, on).select(positioned["*"])
