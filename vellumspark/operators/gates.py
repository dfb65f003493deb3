"""Timing statistics, regression gates and certification scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import ranked

NOISY = 5.0
PRIMARY, TAIL, THROUGHPUT, SLACK = 0.03, 0.15, 0.05, 1e-12
QUARANTINE = 0.005


def ratio(a: Column, b: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def truncated(x: Column) -> Column:
    return F.floor(x * 1e6) / 1e6


def _spread(rows: DataFrame, by: list[str], value: str, picks: dict[str, Callable[[Callable[[Column], Column]], Column]]) -> DataFrame:
    """(by, n, best, mean, cv_pct, *picks): moments by partial sums, and picks from ranks of
    counted values, so no group's values are held together."""
    x = F.col(value)
    moments = rows.groupBy(*by).agg(F.min(x).alias("best"), F.avg(x).alias("mean"), (F.stddev_samp(x) / F.avg(x) * 100).alias("cv_pct"), F.count(x).alias("n"))
    run = ranked(rows.where(x.isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c")), by, value)
    found = run.groupBy(*by).agg(*[pick(lambda rank: F.min(F.when(F.col("upto") > rank, x))).alias(name) for name, pick in picks.items()])
    on = [moments[c].eqNullSafe(found[c]) for c in by]
    return moments.join(found, on, "left").select(*[moments[c] for c in by], "n", "best", "mean", "cv_pct", *picks)


def timing(rows: DataFrame, by: str | list[str], value: str) -> DataFrame:
    """(by, best, p50, mean, cv_pct, n) with an interpolated median."""
    by = [by] if isinstance(by, str) else by
    middle = (F.col("_n") - 1) / 2
    median = lambda at: (at(F.floor(middle)) + at(F.ceil(middle))) / 2
    return _spread(rows, by, value, {"p50": median}).select(*by, "best", "p50", "mean", "cv_pct", "n")


def nearest_rank(rows: DataFrame, by: str | list[str], value: str) -> DataFrame:
    """Nearest-rank p50 and p90; ``keep`` tells whether the spread allows a claim."""
    by = [by] if isinstance(by, str) else by
    rank = lambda q: lambda at: at(F.greatest(F.ceil(F.col("_n") * q) - 1, F.lit(0)))
    found = _spread(rows, by, value, {"p50": rank(0.5), "p90": rank(0.9)})
    return found.select(*by, "p50", "p90", (F.col("cv_pct") <= NOISY).alias("keep"), "n")


def paired(now: DataFrame, baseline: DataFrame) -> DataFrame:
    """Benches by name with those of the baseline; unpaired ones never block."""
    old = baseline.select("name", F.col("p50").alias("b50"), F.col("p90").alias("b90"), F.col("throughput").alias("bt"))
    both = now.join(old, "name")
    return both.select("name", "p50", "b50", (F.col("p50") / F.col("b50") - 1).alias("d50"), (F.col("p90") / F.col("b90") - 1).alias("d90"), (1 - F.col("throughput") / F.col("bt")).alias("dt"))


def compare(now: DataFrame, baseline: DataFrame) -> DataFrame:
    rows = paired(now, baseline)
    return rows.select("name", "d50", "d90", "dt", *[(F.col(c) <= most + SLACK).alias(n) for c, most, n in (("d50", PRIMARY, "primary_ok"), ("d90", TAIL, "tail_ok"), ("dt", THROUGHPUT, "throughput_ok"))])


def regressions(now: DataFrame, baseline: DataFrame) -> DataFrame:
    rows = paired(now, baseline)
    return rows.agg((F.exp(F.avg(F.log(F.col("p50") / F.col("b50")))) - 1).alias("geomean"), F.max("d90").alias("worst_p90"), F.max("dt").alias("worst_throughput"))


def advance(history: DataFrame, now: DataFrame) -> DataFrame:
    """The better of both by name: least latencies, greatest throughput."""
    h, n = history.alias("h"), now.alias("n")
    both = h.join(n, F.col("h.name") == F.col("n.name"), "full")
    return both.select(F.coalesce("h.name", "n.name").alias("name"), F.least("h.p50", "n.p50").alias("p50"), F.least("h.p90", "n.p90").alias("p90"), F.greatest("h.throughput", "n.throughput").alias("throughput"))


def posteriors(rows: DataFrame) -> DataFrame:
    """(category, status, weight) -> Beta(1, 1) posteriors; partial adds half to both."""
    w, s = F.col("weight"), F.col("status")
    known = F.when(s.isin("present", "partial", "missing", "excluded"), s).otherwise(F.raise_error(F.concat(F.lit("unknown status "), F.coalesce(s, F.lit("null")))).cast("string"))
    each = rows.withColumn("status", known)
    half = F.when(s == "partial", 0.5 * w)
    sums = each.groupBy("category").agg((1 + F.coalesce(F.sum(F.when(s == "present", w).otherwise(half)), F.lit(0.0))).alias("alpha"), (1 + F.coalesce(F.sum(F.when(s == "missing", w).otherwise(half)), F.lit(0.0))).alias("beta"))
    return sums.withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta")))


def conformal(rows: DataFrame, by: list[str], value: str, confidence: float) -> DataFrame:
    """(by, half): the residual of rank ceil(confidence (n + 1)), counted by value."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by)
    run = rows.groupBy(*by, value).agg(F.count("*").alias("c")).select(*by, value, F.sum("c").over(w.orderBy(value)).alias("upto"), F.sum("c").over(w).alias("n"))
    rank = F.greatest(F.lit(0), F.least(F.ceil(F.lit(confidence) * (F.col("n") + 1)) - 1, F.col("n") - 1))
    return run.where(F.col("upto") > rank).groupBy(*by).agg(F.min(value).alias("half"))


def ratchet(now: DataFrame, floors: DataFrame) -> DataFrame:
    """(dips, verdict): allow, waiver (only waived dips), quarantine (one small dip), block."""
    rows = floors.join(now, "category", "left").withColumn("dip", F.col("floor") - F.coalesce("lower", F.lit(0.0))).where("dip > 0")
    own = ~F.col("waived")
    sums = rows.agg(F.count("*").alias("dips"), F.count_if(own).alias("hard"), F.max(F.when(own, F.col("dip"))).alias("worst"))
    verdict = F.when(F.col("dips") == 0, "allow").when(F.col("hard") == 0, "waiver").when((F.col("hard") == 1) & (F.col("worst") <= QUARANTINE), "quarantine").otherwise("block")
    return sums.select("dips", verdict.alias("verdict"))


def roofline(cost: DataFrame, by: str, flops_per_s: float, bytes_per_s: float) -> DataFrame:
    """A stage can't be faster than its slower resource; stages add up."""
    compute, memory = F.col("flops") / flops_per_s, F.col("bytes") / bytes_per_s
    return cost.groupBy(by).agg(F.sum(F.greatest(compute, memory)).alias("floor_s"), F.count_if(compute >= memory).alias("compute_bound"))
