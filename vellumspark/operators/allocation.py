"""Budgeted allocation over rate-distortion curves."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import running, settled

NO_GAIN, SLACK = 1e-6, 1e-12
#: Options (precisions) of all curves together, a small dimension.
OPTIONS = 256


def monotone(points: DataFrame, tensor: str, order: list[str], distortion: str) -> DataFrame:
    """``repaired``: the least distortion so far, from the cheap end."""
    w = Window.partitionBy(tensor).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return points.withColumn("repaired", F.min(distortion).over(w))


def hull(points: DataFrame, tensor: str = "tensor") -> DataFrame:
    """(tensor, rate, distortion) -> (tensor, hull): the lower convex hull of a curve as an
    ordered array, one point a rate, flat ends cut. A curve is a few options of one tensor,
    folded within its row."""
    best = points.groupBy(tensor, "rate").agg(F.min("distortion").alias("distortion"))
    curves = best.groupBy(tensor).agg(F.array_sort(F.collect_list(F.struct(F.col("rate").cast("double").alias("r"), F.col("distortion").cast("double").alias("d")))).alias("c"))

    def above(stack: Column, p: Column) -> Column:
        a, b = F.element_at(stack, -2), F.element_at(stack, -1)
        return (b["r"] - a["r"]) * (p["d"] - a["d"]) - (b["d"] - a["d"]) * (p["r"] - a["r"]) <= 0

    def drop(stack: Column) -> Column:
        return F.slice(stack, 1, F.size(stack) - 1)

    def push(stack: Column, p: Column) -> Column:
        # all points before p may have to go; the stack's own length bounds the steps
        left = F.aggregate(stack, stack, lambda s, _: F.when(F.size(s) < 2, s).when(above(s, p), drop(s)).otherwise(s))
        return F.concat(left, F.array(p))

    empty = F.array().cast("array<struct<r:double,d:double>>")
    folded = F.aggregate("c", empty, push)
    flat = F.aggregate(F.col("h"), F.col("h"), lambda s, _: F.when(F.size(s) < 2, s).when(F.element_at(s, -2)["d"] - F.element_at(s, -1)["d"] <= NO_GAIN, drop(s)).otherwise(s))
    return curves.select(tensor, F.when(F.size("c") <= 2, F.col("c")).otherwise(folded).alias("h")).select(tensor, flat.alias("hull"))


def choose(points: DataFrame, tensor: str, price: float) -> DataFrame:
    """Per tensor the point of least distortion + price * rate; ties to the greater rate."""
    cost = F.round(F.col("distortion") + price * F.col("rate"), 12)
    return points.groupBy(tensor).agg(F.min_by(F.struct("rate", "distortion"), F.struct(cost.alias("c"), (-F.col("rate")).alias("r"))).alias("p")).select(tensor, "p.rate", "p.distortion")


def edges(hulls: DataFrame, tensor: str = "tensor") -> DataFrame:
    """(tensor, step, added, dropped, slope): what each step along a hull costs and gains.
    Slopes fall along a hull, so slope order keeps a tensor's steps in order."""
    steps = F.sequence(F.lit(1), F.size("hull") - 1)
    each = hulls.where(F.size("hull") > 1).select(tensor, "hull", F.explode(steps).alias("step"))
    a, b = F.element_at("hull", F.col("step")), F.element_at("hull", F.col("step") + 1)
    cut = each.select(tensor, "step", (b["r"] - a["r"]).alias("added"), (a["d"] - b["d"]).alias("dropped"))
    return cut.withColumn("slope", F.col("dropped") / F.col("added"))


def waterfill(points: DataFrame, budget: float, tensor: str = "tensor") -> DataFrame:
    """(tensor, step, steps, rate, distortion, marginal) under a budget of total rate.

    From the cheapest point of every hull the steepest next step that still fits is taken,
    ties by name; a tensor whose next step doesn't fit is done. All steps are ordered once
    by slope: a running sum by ranges finds how many fit before the first that doesn't.
    What is left of the budget then rules out that tensor and every step above it, and
    what remains is summed again, until nothing does. A budget below the cheapest
    allocation is an error.
    """
    hulls = settled(hull(points, tensor))
    left = budget - (hulls.agg(F.sum(F.col("hull")[0]["r"])).first()[0] or 0.0)
    if left < 0:
        raise ValueError("the budget is below the cheapest allocation")
    todo = settled(edges(hulls, tensor).select(tensor, "step", "added", F.struct((-F.col("slope")).alias("slope"), F.col(tensor).alias("name"), "step").alias("place")))
    taken = todo.select(tensor, "step").limit(0)
    while not todo.isEmpty():
        run = settled(running(todo, "place", "added", "upto"))
        now = run.where(F.col("upto") <= left)
        taken = taken.unionByName(now.select(tensor, "step"))
        spent, left = left, left - (now.agg(F.max("upto")).first()[0] or 0.0)
        rest = run.where(F.col("upto") > spent)
        stops = rest.where(F.col("added") > left).groupBy(F.col(tensor).alias("stopped")).agg(F.min("step").alias("stop"))
        open_ = rest.join(stops, F.col(tensor) == F.col("stopped"), "left").where(F.col("stop").isNull() | (F.col("step") < F.col("stop")))
        todo = settled(open_.select(tensor, "step", "added", "place"))
    reached = taken.groupBy(F.col(tensor).alias("moved")).agg(F.max("step").alias("reached"))
    at = hulls.join(reached, F.col(tensor) == F.col("moved"), "left").select(tensor, "hull", F.coalesce("reached", F.lit(0)).alias("step"))
    here, onward = F.element_at("hull", F.col("step") + 1), F.try_element_at("hull", F.col("step") + 2)
    marginal = F.coalesce((here["d"] - onward["d"]) / (onward["r"] - here["r"]), F.lit(0.0))
    return at.select(tensor, "step", (F.size("hull") - 1).alias("steps"), here["r"].alias("rate"), here["d"].alias("distortion"), marginal.alias("marginal"))


def uniform(points: DataFrame, target: float, tensor: str = "tensor") -> DataFrame:
    """(tensor, rate, distortion): every tensor at ``target``, else at the least rate above
    it; one that has none at its least rate."""
    best = points.groupBy(tensor, "rate").agg(F.min("distortion").alias("distortion"))
    above = F.when(F.col("rate") >= target, F.col("rate"))
    pick = F.coalesce(F.min_by(F.struct("rate", "distortion"), above), F.min_by(F.struct("rate", "distortion"), F.col("rate")))
    return best.groupBy(tensor).agg(pick.alias("p")).select(tensor, F.col("p.rate").cast("double").alias("rate"), F.col("p.distortion").cast("double").alias("distortion"))


def uniform_within(points: DataFrame, budget: float, tensor: str = "tensor") -> DataFrame:
    """One row (target, rate, distortion): the uniform target whose total rate is the
    greatest under the budget, of equal ones the greatest target; all at their least if
    none is. The options of all tensors are few: each curve prices every one of them."""
    curves = points.groupBy(tensor).agg(F.array_sort(F.collect_list(F.struct(F.col("rate").cast("double").alias("r"), F.col("distortion").cast("double").alias("d")))).alias("c"))
    targets = [float(r[0]) for r in points.select("rate").distinct().orderBy("rate").limit(OPTIONS + 1).collect()]
    if len(targets) > OPTIONS:
        raise ValueError(f"over {OPTIONS} options")

    def pick(t: Column) -> Column:
        return F.coalesce(F.get(F.filter("c", lambda p: p["r"] >= t), F.lit(0)), F.col("c")[0])

    each = curves.select(F.explode(F.transform(F.array(*map(F.lit, targets)), lambda t: F.struct(t.alias("target"), pick(t)["r"].alias("rate"), pick(t)["d"].alias("distortion")))).alias("o")).select("o.*")
    totals = each.groupBy("target").agg(F.sum("rate").alias("rate"), F.sum("distortion").alias("distortion"))
    fits = F.when(F.col("rate") <= budget, F.struct("rate", "target"))
    row = F.struct("target", "rate", "distortion")
    return totals.agg(F.coalesce(F.max_by(row, fits), F.min_by(row, F.col("target"))).alias("o")).select("o.*")


def allocated(points: DataFrame, budget: float, target: float, tensor: str = "tensor", forced: bool = False) -> DataFrame:
    """(tensor, rate, distortion, reason, method, fallback): water-filling, or the uniform
    allocation at ``target`` with why: forced, the budget infeasible, or a total distortion
    worse than the uniform one's under the same budget."""
    why = "forced fallback" if forced else None
    if not forced:
        try:
            filled = settled(waterfill(points, budget, tensor))
            total = filled.agg(F.sum("distortion")).first()[0] or 0.0
            base = uniform_within(points, budget, tensor).first()
            if total > (base["distortion"] if base["distortion"] is not None else 0.0) + SLACK:
                why = "surrogate pre-check failed"
        except ValueError as e:
            why = f"optimizer error: {e}"
    if why is None:
        reason = F.when(F.col("step") == 0, "flat: starved to cheapest").when(F.col("step") == F.col("steps"), "steep: upgraded to highest available precision").otherwise("interior: upgraded one or more hull steps")
        return filled.select(tensor, "rate", "distortion", reason.alias("reason"), F.lit("lagrangian-waterfill").alias("method"), F.lit(None).cast("string").alias("fallback"))
    return uniform(points, target, tensor).withColumns({"reason": F.lit("uniform"), "method": F.lit(f"uniform-{target:g}"), "fallback": F.lit(why)})


def exact(points: DataFrame, budget: int, group: str, tensor: str = "tensor", grid: int = 1) -> DataFrame:
    """(group, tensor, rate, distortion) of least total distortion under ``budget``: a
    knapsack table per group, one Arrow call each; tensors of one group are few."""
    keys = dict(points.dtypes)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(pdf[tensor].unique())
        cells = int(budget // grid)
        best, back = [0.0] + [float("inf")] * cells, []
        for name in names:
            own = pdf[pdf[tensor] == name].sort_values(["rate", "distortion"])
            options = [(-(-int(r) // grid), d) for r, d in zip(own["rate"], own["distortion"], strict=True)]
            now, pick = [float("inf")] * (cells + 1), [-1] * (cells + 1)
            for k, (c, d) in enumerate(options):
                for at in range(c, cells + 1):
                    if best[at - c] + d < now[at] - 1e-18:
                        now[at], pick[at] = best[at - c] + d, k
            best = now
            back.append((own, options, pick))
        at = min(range(cells + 1), key=lambda i: (best[i], i))
        if best[at] == float("inf"):
            raise ValueError("the budget is below the cheapest allocation")
        rows = []
        for name, (own, options, pick) in zip(reversed(names), reversed(back), strict=True):
            k = pick[at]
            rows.append((pdf[group].iloc[0], name, own["rate"].iloc[k], own["distortion"].iloc[k]))
            at -= options[k][0]
        return pd.DataFrame(rows, columns=[group, tensor, "rate", "distortion"])

    return points.select(group, tensor, "rate", "distortion").groupBy(group).applyInPandas(solve, f"{group} {keys[group]}, {tensor} {keys[tensor]}, rate {keys['rate']}, distortion {keys['distortion']}")
