"""Universal scalability law: speed-up n / (1 + a (n - 1) + b n (n - 1)) per group."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_R2 = 0.90


def speedups(samples: DataFrame, by: list[str], n: str = "n", throughput: str = "throughput") -> DataFrame:
    """(by, n, c): throughput scaled so that the smallest n has a speed-up of n."""
    low = samples.groupBy(*by).agg(F.min_by(F.struct(F.col(n).alias("bn"), F.col(throughput).alias("bt")), n).alias("low"))
    return samples.join(low, by).select(*by, F.col(n).cast("double").alias("n"), (F.col(throughput) * F.col("low.bn") / F.when(F.col("low.bt") > 0, F.col("low.bt")).otherwise(F.raise_error(F.lit("the smallest sample has no throughput")).cast("double"))).alias("c"))


def law(n: Column, a: Column, b: Column) -> Column:
    d = 1 + a * (n - 1) + b * n * (n - 1)
    return F.when(d <= 0, 0.0).otherwise(n / d)


def fit_linear(points: DataFrame, by: list[str]) -> DataFrame:
    """(by, a, b): least squares of n / c - 1 on (n - 1) and n (n - 1), by Cramer's rule."""
    ok = points.where("n > 1 AND c > 0").select(*by, (F.col("n") - 1).alias("p"), (F.col("n") * (F.col("n") - 1)).alias("q"), (F.col("n") / F.col("c") - 1).alias("y"))
    s = ok.groupBy(*by).agg(*[F.sum(F.col(u) * F.col(v)).alias(u + v) for u, v in ("pp", "pq", "qq", "py", "qy")], F.count("*").alias("used"))
    det = F.col("pp") * F.col("qq") - F.col("pq") * F.col("pq")
    solved = (F.col("used") >= 2) & (F.abs(det) >= 1e-18)
    return s.select(*by, F.when(solved, (F.col("py") * F.col("qq") - F.col("qy") * F.col("pq")) / det).alias("a"), F.when(solved, (F.col("pp") * F.col("qy") - F.col("pq") * F.col("py")) / det).alias("b"))


def goodness(points: DataFrame, fit: DataFrame, by: list[str]) -> DataFrame:
    """(by, a, b, r2, rmse) in speed-ups."""
    mean = points.groupBy(*by).agg(F.avg("c").alias("mean"))
    rows = points.join(fit, by).join(mean, by)
    r = F.col("c") - law(F.col("n"), F.col("a"), F.col("b"))
    s = rows.groupBy(*by, "a", "b").agg(F.sum(r * r).alias("res"), F.sum((F.col("c") - F.col("mean")) * (F.col("c") - F.col("mean"))).alias("tot"), F.count("*").alias("k"))
    return s.select(*by, "a", "b", F.when(F.col("tot") > 0, 1 - F.col("res") / F.col("tot")).otherwise(1.0).alias("r2"), F.sqrt(F.col("res") / F.col("k")).alias("rmse"))


def peak(a: Column, b: Column) -> Column:
    """Where the law is greatest: without bound if nothing holds it back."""
    return F.when(b <= 0, float("inf")).when(a >= 1, 1.0).otherwise(F.sqrt((1 - a) / b))


def integer_peak(a: Column, b: Column, real: Column, cpus: int) -> Column:
    """The better of the whole numbers around the peak, between 1 and ``cpus``; of equals
    the smaller."""
    near = F.array(*[F.greatest(F.lit(1.0), F.least(F.lit(float(cpus)), f(F.least(real, F.lit(float(cpus)))))) for f in (F.floor, F.ceil)])
    return F.array_sort(F.transform(near, lambda n: F.struct((-law(n, a, b)).alias("s"), n.alias("n"))))[0]["n"]


def decide(quality: DataFrame, by: list[str], cpus: int, cores: int) -> DataFrame:
    """The pool size of each group: the law's integer peak, clamped to ``cpus``, or the
    physical cores where the fit is poor or missing."""
    a, b = F.col("a"), F.col("b")
    poor = a.isNull() | b.isNull() | F.isnan("r2") | (F.col("r2") < MIN_R2)
    rows = quality.withColumn("peak", peak(a, b)).withColumn("peak_n", integer_peak(a, b, F.col("peak"), cpus)).withColumn("fallback", poor)
    top, all_ = law(F.col("peak_n"), a, b), law(F.lit(float(cpus)), a, b)
    return rows.select(
        *by, F.round("a", 4).alias("alpha"), F.round("b", 6).alias("beta"), F.round("r2", 4).alias("r2"), F.round("rmse", 4).alias("rmse"), "fallback",
        F.when(F.col("fallback"), cores).otherwise(F.col("peak_n")).cast("int").alias("chosen"),
        F.when(F.col("fallback"), 0.0).otherwise(F.coalesce(F.round(100 * F.try_divide(top - all_, all_), 1), F.lit(0.0))).alias("gain_pct"),
        F.when(F.col("fallback"), "fallback-physical-cores").when(F.col("peak_n") >= cpus, "no-cap-needed").otherwise("cap-at-usl-peak").alias("decision"),
    )


def refine(points: DataFrame, fit: DataFrame, by: list[str], steps: int = 12, halvings: int = 8) -> DataFrame:
    """(by, a, b, sse): damped Gauss-Newton from a linear fit. Iterative, so one Arrow
    call a group; a group is one sweep of a machine."""
    keys = ", ".join(f"{c} {t}" for c, t in points.dtypes if c in by)

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        n, c = pdf["n"].to_numpy(), pdf["c"].to_numpy()
        x = pdf[["a", "b"]].iloc[0].to_numpy(dtype=float)

        def model(x):
            d = 1 + x[0] * (n - 1) + x[1] * n * (n - 1)
            return d, [y / z if z > 0 else 0.0 for y, z in zip(n, d, strict=True)]

        def loss(x):
            return float(((c - model(x)[1]) ** 2).sum())

        best = loss(x)
        for _ in range(steps):
            d, speed = model(x)
            ok = d > 0
            j = (-(n * (n - 1) / d**2)[ok], -(n * n * (n - 1) / d**2)[ok])
            r = (c - speed)[ok]
            h = [[float(u @ v) for v in j] for u in j]
            det = h[0][0] * h[1][1] - h[0][1] * h[1][0]
            if abs(det) < 1e-24:
                break
            g = [float(u @ r) for u in j]
            step = pd.Series([(g[0] * h[1][1] - g[1] * h[0][1]) / det, (h[0][0] * g[1] - h[1][0] * g[0]) / det]).to_numpy()
            trials = [x + step * 0.5**k for k in range(halvings)]
            better = next((t for t in trials if loss(t) < best), None)
            if better is None:
                break
            x, best = better, loss(better)
        return pdf[by].iloc[:1].assign(a=x[0], b=x[1], sse=best)

    return points.join(fit.where("a IS NOT NULL"), by).groupBy(*by).applyInPandas(group, f"{keys}, a double, b double, sse double")
