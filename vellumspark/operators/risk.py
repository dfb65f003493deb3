"""Tail risk of samples in [0, 1]. Samples are first counted by value, which every measure
only needs; values are ranked by ranges, so no task sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import running, settled

ALPHA, EVT_Q, POT = 0.10, 0.999, 0.15
MIN_EXCEED = 8


def checked(samples: DataFrame, value: str) -> DataFrame:
    """Samples must be finite and within [0, 1]; the first other one is an error."""
    x = F.col(value)
    bad = x.isNull() | F.isnan(x) | (x < 0) | (x > 1)
    return samples.select(F.when(bad, F.raise_error(F.lit("a sample is not within [0, 1]")).cast("double")).otherwise(x.cast("double")).alias("x"))


def histogram(samples: DataFrame, value: str) -> DataFrame:
    """(x, c, upto, n): one row a distinct value with its count, the samples up to it and
    all samples. Counted and ranked once; every measure below only reads these rows."""
    hist = settled(checked(samples, value).groupBy("x").agg(F.count("*").alias("c")))
    return settled(running(hist, "x", "c", "upto").join(F.broadcast(hist.agg(F.sum("c").alias("n")))))


def quantiles(hist: DataFrame, qs: dict[str, float]) -> DataFrame:
    """One row of type-7 quantiles by name, from the histogram."""
    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("upto") > rank, F.col("x")))

    cols = []
    for name, q in qs.items():
        h = (F.col("n") - 1) * F.lit(q)
        low, high = at(F.floor(h)), at(F.ceil(h))
        cols.append((low + F.max(h - F.floor(h)) * (high - low)).alias(name))
    return hist.agg(*cols, F.max("n").alias("n"))


def cvar(hist: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(cvar): mean of the worst ``alpha`` of all samples, the last one in part."""
    run = hist.withColumn("before", F.col("n") - F.col("upto"))
    size = F.lit(alpha) * F.col("n")
    taken = F.greatest(F.lit(0.0), F.least(F.col("c").cast("double"), size - F.col("before")))
    single = F.max(size) < 1  # under one sample: the worst one itself
    return run.agg(F.when(single, F.max("x")).otherwise(F.sum(F.col("x") * taken) / F.max(size)).alias("cvar"))


def pareto(hist: DataFrame, pot: float = POT) -> DataFrame:
    """One row (threshold, shape, scale, m, n): a generalised Pareto tail by probability
    weighted moments; shape and scale are null where the fit falls back."""
    q = quantiles(hist, {"u": 1 - pot})
    under = hist.join(F.broadcast(q.select("u")), F.col("x") <= F.col("u")).agg(F.coalesce(F.max("upto"), F.lit(0)).alias("under"))
    over = hist.join(F.broadcast(q.select("u")), F.col("x") > F.col("u")).join(F.broadcast(under))
    run = over.select((F.col("x") - F.col("u")).alias("y"), F.col("c").cast("double").alias("c"), (F.col("upto") - F.col("under")).cast("double").alias("upto"), (F.col("n") - F.col("under")).cast("double").alias("m"))
    # copies of a value have ranks upto - c + 1 to upto; their mean rank is enough
    rank = F.col("upto") - (F.col("c") - 1) / 2
    sums = run.agg(F.coalesce(F.max("m"), F.lit(0.0)).alias("m"), (F.sum(F.col("y") * F.col("c")) / F.max("m")).alias("a0"), (F.sum((1 - (rank - 0.35) / F.col("m")) * F.col("y") * F.col("c")) / F.max("m")).alias("a1"))
    d = F.col("a0") - 2 * F.col("a1")
    fit = sums.withColumn("ok", (F.col("m") >= MIN_EXCEED) & (F.abs(d) >= 1e-12) & (F.col("a0") > 0) & (2 * F.col("a0") * F.col("a1") / d > 0))
    return fit.join(F.broadcast(q)).select(F.col("u").alias("threshold"), F.when(F.col("ok"), 2 - F.col("a0") / d).alias("shape"), F.when(F.col("ok"), 2 * F.col("a0") * F.col("a1") / d).alias("scale"), "m", "n")


def report(samples: DataFrame, value: str, alpha: float = ALPHA, evt_q: float = EVT_Q, pot: float = POT) -> DataFrame:
    """One row: n, mean, worst, value at risk, CVaR, the extreme quantile (never under
    the empirical one, clamped to [0, 1]), whether it fell back, and its coverage."""
    hist = histogram(samples, value)
    base = hist.agg((F.sum(F.col("x") * F.col("c")) / F.sum("c")).alias("mean"), F.max("x").alias("worst"))
    q = quantiles(hist, {"var": 1 - alpha, "emp": evt_q})
    one = base.join(F.broadcast(q)).join(F.broadcast(cvar(hist, alpha))).join(F.broadcast(pareto(hist, pot).drop("n")))
    ratio = F.greatest((1 - F.lit(evt_q)) / (F.col("m") / F.col("n")), F.lit(1e-300))
    curve = F.when(F.abs("shape") < 1e-9, F.col("threshold") - F.col("scale") * F.log(ratio)).otherwise(F.col("threshold") + F.col("scale") / F.col("shape") * (F.pow(ratio, -F.col("shape")) - 1))
    evt = F.least(F.lit(1.0), F.greatest(F.coalesce(curve, F.col("emp")), F.col("emp"), F.lit(0.0)))
    done = one.withColumn("evt", evt).withColumn("fallback", F.col("shape").isNull())
    covered = hist.join(F.broadcast(done.select("evt"))).agg((F.sum(F.when(F.col("x") <= F.col("evt"), F.col("c")).otherwise(0)) / F.sum("c")).alias("coverage"))
    return done.join(F.broadcast(covered)).select("n", "mean", "worst", "var", "cvar", "evt", "fallback", "coverage", "threshold", "shape", "scale")


def gate(candidate: DataFrame, baseline: DataFrame, budget: float) -> DataFrame:
    """(cvar, evt) of a candidate against a baseline of at most one row: each may exceed
    its baseline by ``budget``; without a baseline the verdict is no-baseline."""
    b = baseline.agg(F.max("cvar").alias("b_cvar"), F.max("evt").alias("b_evt"))
    joined = candidate.join(F.broadcast(b))
    ok = [F.coalesce(F.col(c) <= F.col(f"b_{c}") + budget + 1e-12, F.lit(True)) for c in ("cvar", "evt")]
    none = F.col("b_cvar").isNull() & F.col("b_evt").isNull()
    return joined.select("cvar", "evt", "b_cvar", "b_evt", ok[0].alias("cvar_ok"), ok[1].alias("evt_ok"), F.when(none, "no-baseline").when(ok[0] & ok[1], "pass").otherwise("fail").alias("verdict"))
