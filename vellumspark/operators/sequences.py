"""Operators over token sequences, windows of streams, and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.functions.vectors import let

RING = 128


def draft(tokens: Column, ngram: int, most: int) -> Column:
    """What followed the latest earlier occurrence of the last ``ngram`` tokens."""

    def after(s: Column) -> Column:
        n = F.size(s)
        tail = F.slice(s, n - ngram + 1, ngram)
        starts = F.filter(F.sequence(F.lit(0), n - ngram - 1), lambda i: F.slice(s, i + 1, ngram) == tail)
        return let(F.array_max(starts), lambda at: F.when(at.isNull(), F.array().cast("array<string>")).otherwise(F.slice(s, F.coalesce(at, F.lit(0)) + ngram + 1, most)))

    return let(tokens, lambda s: F.when(F.size(s) > ngram, after(F.when(F.size(s) > ngram, s).otherwise(F.array_repeat(F.lit(""), ngram + 1)))).otherwise(F.array().cast("array<string>")))


def bans(tokens: Column, ngram: int, window: int, allowed: Column) -> Column:
    """Tokens that would repeat an n-gram of the last ``window`` tokens (0: of all)."""

    def found(s: Column) -> Column:
        n = F.size(s)
        first = F.greatest(F.lit(0), n - window) if window else F.lit(0)
        tail = F.slice(s, n - ngram + 2, ngram - 1) if ngram > 1 else F.array().cast("array<string>")
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), n - ngram)), lambda i: (i >= first) & (n >= ngram) & ((F.slice(s, i + 1, ngram - 1) == tail) if ngram > 1 else F.lit(True)))
        return F.array_sort(F.array_except(F.transform(starts, lambda i: s[i + ngram - 1]), allowed))

    return let(tokens, lambda s: F.when(F.size(s) >= ngram, found(F.when(F.size(s) >= ngram, s).otherwise(F.array_repeat(F.lit(""), ngram)))).otherwise(F.array().cast("array<string>")))


def accepted(draft_: Column, greedy: Column, end: Column) -> Column:
    """Length of the drafted prefix that equals the greedy one, up to and with an end."""

    def length(d: Column, g: Column) -> Column:
        n = F.size(d)
        at = F.sequence(F.lit(0), n)
        wrong = F.filter(at, lambda i: (i < n) & ~F.coalesce(F.get(d, i).eqNullSafe(F.get(g, i)), F.lit(False)))
        ends = F.filter(at, lambda i: (i < n) & (F.get(d, i) == end))
        return F.least(n, F.coalesce(F.array_min(wrong), n), F.coalesce(F.array_min(ends) + 1, n))

    return let(draft_, lambda d: let(greedy, lambda g: length(d, g)))


def ring_attention(rows: DataFrame, key: str, order: list[str], score: str, value: str, prefix: int, ring: int = RING) -> DataFrame:
    """Softmax-weighted mean of ``value`` over the first ``prefix`` rows of a stream and
    its last ``ring`` others, the current row included: sums of two frames."""
    by = Window.partitionBy(key).orderBy(*order)
    numbered = rows.withColumn("pos", F.row_number().over(by))
    e = F.exp(F.col(score))
    frozen = F.col("pos") <= prefix
    head = by.rowsBetween(Window.unboundedPreceding, 0)
    tail = by.rowsBetween(-(ring - 1), 0)
    total = lambda x, w, where: F.coalesce(F.sum(F.when(where, x)).over(w), F.lit(0.0))
    top = total(e * F.col(value), head, frozen) + total(e * F.col(value), tail, ~frozen)
    low = total(e, head, frozen) + total(e, tail, ~frozen)
    return numbered.withColumn("attended", top / low)


def causal_attention(rows: DataFrame, key: str, order: list[str], score: str, value: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    e = F.exp(F.col(score))
    return rows.withColumn("attended", F.sum(e * F.col(value)).over(w) / F.sum(e).over(w))


def islands(rows: DataFrame, key: str, order: list[str], flag: Column) -> DataFrame:
    """(key, island, flag, n): maximal runs of equal ``flag``."""
    by = Window.partitionBy(key).orderBy(*order)
    marked = rows.withColumn("_f", flag).withColumn("_new", F.coalesce((F.col("_f") != F.lag("_f").over(by)).cast("long"), F.lit(0)))
    numbered = marked.withColumn("island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "island").agg(F.first("_f").alias("flag"), F.count("*").alias("n"))


def positional(slots: DataFrame, features: DataFrame, by: str, slot_order: str, feature_order: str) -> DataFrame:
    """The k-th open slot of a group takes the group's k-th feature; unequal numbers are an
    error. slots: (by, order, open, x); features: (by, order, f)."""
    a = slots.withColumn("_k", F.when(F.col("open"), F.sum(F.col("open").cast("long")).over(Window.partitionBy(by).orderBy(slot_order))))
    b = features.select(F.col(by).alias("_by"), F.row_number().over(Window.partitionBy(by).orderBy(feature_order)).cast("long").alias("_j"), F.col("f"))
    need, have = slots.groupBy(by).agg(F.count_if("open").alias("need")), features.groupBy(by).agg(F.count("*").alias("have"))
    even = need.join(have, by, "full").select(by, F.when(F.coalesce("need", F.lit(0)) != F.coalesce("have", F.lit(0)), F.raise_error(F.lit("slots and features differ in number")).cast("boolean")).otherwise(True).alias("_even"))
    joined = a.join(even, by).where("_even").join(b, (F.col(by) == F.col("_by")) & (F.col("_k") == F.col("_j")), "left")
    return joined.select(by, slot_order, F.coalesce("f", "x").alias("x"))


def grids(most: int = 32, least: int = 2) -> list[tuple[int, int]]:
    """Grids of ``least`` to ``most`` tiles by number of tiles, then sides: a fixed dimension."""
    return sorted(((i, j) for i in range(1, most + 1) for j in range(1, most + 1) if least <= i * j <= most), key=lambda g: (g[0] * g[1], g))


def closest_grid(width: Column, height: Column, tile: int, most: int = 32) -> Column:
    """struct<i, j> nearest in aspect; of equally near ones the last whose tiles the image
    half fills, else the first. The grids are a constant array, so nothing is joined."""
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for k, (i, j) in enumerate(grids(most))])
    aspect, area = width / height, width * height
    gap = lambda g: F.abs(aspect - g["i"] / g["j"])

    def pick(near: Column) -> Column:
        later = F.filter(near, lambda g: (g["k"] > near[0]["k"]) & (area > 0.5 * tile * tile * g["i"] * g["j"]))
        return F.coalesce(F.try_element_at(later, F.lit(-1)), near[0])

    return let(F.array_min(F.transform(each, gap)), lambda low: let(F.filter(each, lambda g: gap(g) == low), pick))


def census(expected: DataFrame, found: DataFrame, name: str = "name") -> DataFrame:
    """Names on one side only: (name, side)."""
    e, f = expected.select(name).distinct().withColumn("e", F.lit(True)), found.select(name).distinct().withColumn("f", F.lit(True))
    both = e.join(f, name, "full").where("e IS NULL OR f IS NULL")
    return both.select(name, F.when(F.col("e").isNull(), "unexpected").otherwise("missing").alias("side"))


def looked_up(rows: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """An inner join whose unmatched rows are an error."""
    hit = dimension.withColumn("_hit", F.lit(True))
    joined = rows.join(hit, key, "left")
    ok = F.when(F.col("_hit").isNull(), F.raise_error(F.concat(F.lit("no entry for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean")).otherwise(F.col("_hit"))
    return joined.withColumn("_hit", ok).where("_hit").drop("_hit")


def spread(runs: DataFrame, by: list[str], token: str, score: str) -> DataFrame:
    """(by, same, spread) of runs at one position."""
    return runs.groupBy(*by).agg((F.count_distinct(token) == 1).alias("same"), (F.max(score) - F.min(score)).alias("spread"))
