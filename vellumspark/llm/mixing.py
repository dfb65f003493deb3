"""Mixing sources to target weights by hash thresholds: columns and joins only.

Every document has a 32-bit hash of its doc_id. Sizes are summed by source and the
hash's first bits; the bucket in which a source's budget ends is summed by the next
bits, and again, until a bucket is one hash value. A document is taken once more if
its hash is below its source's threshold. Nothing is sorted but the sums of sources, and
those of one source and level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, stored, word_count

#: Bits of the hash that each level of histograms uses.
LEVELS = (11, 11, 10)
MOST = 3
#: Sources whose thresholds are sent to all tasks; beyond it they are joined.
BROADCAST_SOURCES = 100_000
WEIGHTS = (1, 2, 3)


def hash32(doc_id: Column) -> Column:
    """First 32 bits of the MD5 of the id as text (of 'null' for null)."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null"))), 1, 8), 16, 10).cast("long")


def _running(rows: DataFrame, order: list[Column], sums: list[str]) -> DataFrame:
    """``rows`` with, for each of ``sums``, its sum over the rows before in ``order`` as
    before_<name>. Rows are stored by ranges of the order; only the ranges' own sums, one
    row each, meet in one place."""
    dealt, _ = stored(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("_range").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    start = ranges.select(F.col("_range").alias("_at"), *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in sums])
    run = dealt.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(within), F.lit(0)) for c in sums})
    return run.join(start, F.col("_range") == F.col("_at")).select(*rows.columns, *[(F.col(f"before_{c}") + F.col(f"_{c}")).alias(f"before_{c}") for c in sums])


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) -> with target: weights by order of code point, null last;
    a source stops at ``most`` times its size and the excess goes to the others.

    With a common level L, a source gets min(most * size, L * weight). L follows from
    the sources in order of size / weight: the first k stop, the rest share what is left.
    """
    numbered = _running(by_source.select("source", "source_size", F.lit(1).cast("long").alias("one")), [F.col("source").asc_nulls_last()], ["one"])
    weighed = numbered.select("source", "source_size", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod(F.col("before_one"), F.lit(len(weights))) + 1).cast("int")).alias("w"))
    rows = _running(weighed, [F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last()], ["source_size", "w"])
    rows, _ = stored(rows, "order")
    total, shares = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    level = (F.lit(total) - most * F.col("before_source_size")).cast("double") / (F.lit(shares) - F.col("before_w")).cast("double")
    found = rows.select(F.max(F.when(level * F.col("w") <= most * F.col("source_size"), level))).first()[0]
    return rows.select("source", "source_size", F.least((most * F.col("source_size")).cast("double"), F.lit(found).cast("double") * F.col("w")).alias("target"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def thresholds(sized: DataFrame, goal: DataFrame, most: int = MOST) -> DataFrame:
    """(source, size, u) and (source, source_size, target) -> goal with ``rounds`` (times
    every document is taken) and ``below`` (documents with a smaller hash once more; none
    of a source that all are taken ``most`` times of)."""
    size = F.col("source_size")
    state = goal.select(
        "source", "source_size", "target",
        F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long").alias("rounds"),
    ).withColumn("need", F.col("target") - F.col("rounds") * size).withColumn("prefix", F.lit(0).cast("long"))
    used = 0
    for bits in LEVELS:
        left, used = 32 - used - bits, used + bits
        edge = state.select(F.col("source").alias("_s"), "need", "prefix")
        held = sized.join(edge, _same("source", "_s") & (F.shiftright("u", 32 - used + bits) == F.col("prefix")))
        sums = held.groupBy("_s", F.shiftright("u", left).alias("bucket")).agg(F.sum("size").alias("size"), F.first("need").alias("need"))
        run = sums.withColumn("upto", F.sum("size").over(Window.partitionBy("_s").orderBy("bucket")))
        last = left == 0
        fits = (F.col("upto") - F.col("need") <= F.col("need") - (F.col("upto") - F.col("size"))) & (F.col("upto") - F.col("need") < F.col("size")) if last else F.lit(False)
        inside = (F.col("upto") <= F.col("need")) | fits
        cut = run.groupBy("_s").agg(
            F.min(F.when(~inside, F.col("bucket"))).alias("next"),
            F.coalesce(F.max(F.when(inside, F.col("upto"))), F.lit(0)).alias("spent"),
            F.max("bucket").alias("top"),
        )
        state = state.join(cut, _same("source", "_s"), "left").select(
            "source", "source_size", "target", "rounds",
            (F.col("need") - F.coalesce("spent", F.lit(0))).alias("need"),
            F.coalesce("next", F.col("top") + 1, F.shiftleft("prefix", bits)).alias("prefix"),
        )
        state, _ = stored(state, "thresholds")
    return state.select("source", "source_size", "target", "rounds", F.when(F.col("rounds") < most, F.col("prefix")).otherwise(0).alias("below"))


def mix(docs: DataFrame, size: Column | None = None, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, times) of every row of ``docs``.

    ``times`` (0 to ``most``) is how often the mix takes the document. ``size`` is its
    words by default (null text: 0). Documents without a source are a source of their
    own; a source of no words has target 0. Rows that repeat a doc_id share its hash and
    are taken together. Other columns are not read; an empty table gives no rows.
    """
    sized, _ = stored(docs.select(F.col("doc_id"), F.col("source"), (word_count(F.col("text").cast("string")) if size is None else size).alias("size"), hash32(F.col("doc_id")).alias("u")), "sizes")
    by = _found(sized, weights, most).withColumnRenamed("source", "_s")
    taken = sized.join(by, _same("source", "_s"))
    return taken.select("doc_id", "source", "size", "source_size", "target", (F.col("rounds") + (F.col("u") < F.col("below")).cast("long")).alias("times"), "u")


def _found(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    return thresholds(sized, targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), most)


def apply_mix(docs: DataFrame, size: Column | None = None, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``docs`` with every document as often as the mix takes it: ``most`` times at most."""
    sized, _ = stored(docs.select(F.col("source"), (word_count(F.col("text").cast("string")) if size is None else size).alias("size"), hash32(F.col("doc_id")).alias("u")), "sizes")
    found = _found(sized, weights, most)
    key, rounds, below, copy = (free_name(docs, c) for c in ("_mix_source", "_mix_rounds", "_mix_below", "_mix_copy"))
    by = found.select(F.col("source").alias(key), F.col("rounds").alias(rounds), F.col("below").alias(below))
    few = by.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    times = F.col(rounds) + (hash32(F.col("doc_id")) < F.col(below)).cast("long")
    joined = docs.join(F.broadcast(by) if few else by, _same("source", key))
    return joined.where(times > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), times))).select(*docs.columns)
