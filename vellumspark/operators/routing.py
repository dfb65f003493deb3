"""Expert routing and dispatch over rows of matrices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumspark.functions import vectors as V

GATES, TOP = 64, 6


def gates(rows: DataFrame, count: int = GATES) -> DataFrame:
    """One row: the gate matrix, ``count`` rows by id. Its size is fixed by the model."""
    few = rows.where(F.col("vec_id") < count).select(F.struct("vec_id", V.doubles(F.col("embedding")).alias("w")).alias("g"))
    return few.agg(F.transform(F.array_sort(F.collect_list("g")), lambda g: g["w"]).alias("gate"))


def scores(rows: DataFrame, key: str, gate: DataFrame) -> DataFrame:
    """(key, embedding, scores): a row's products with all gates; the gate matrix is one
    broadcast row, so rows stay where they are."""
    return rows.join(F.broadcast(gate)).select(key, "embedding", F.transform("gate", lambda w: V.dot(F.col("embedding"), w)).alias("scores"))


def route(rows: DataFrame, key: str, gate: DataFrame, top: int = TOP, normalise: bool = False) -> DataFrame:
    """(key, embedding, routes): softmax over all gates, the best ``top`` with their raw
    weights, or normalised ones."""
    soft = scores(rows, key, gate).select(key, "embedding", V.softmax(F.col("scores")).alias("p"))
    routed = soft.select(key, "embedding", V.top_k(F.col("p"), top).alias("routes"))
    if not normalise:
        return routed
    whole = V.total(F.transform("routes", lambda r: r["score"])) + 1e-20
    return routed.withColumn("routes", F.transform("routes", lambda r: F.struct(r["index"].alias("index"), (r["score"] / whole).alias("score"))))


def dispatch(routed: DataFrame, key: str, expert: Callable[[Column, Column], Column], shared: Callable[[Column], Column]) -> DataFrame:
    """(key, y): the experts' outputs by weight in ascending order of expert, then the
    shared expert's."""
    add = lambda a, b: F.zip_with(a, b, lambda p, q: p + q)

    def mixed(x: Column) -> Column:
        each = F.aggregate(F.array_sort("routes"), F.transform(x, lambda _: F.lit(0.0)), lambda acc, r: add(acc, F.transform(expert(x, r["index"]), lambda y: y * r["score"])))
        return add(each, shared(x))

    return routed.select(key, V.let(V.doubles(F.col("embedding")), mixed).alias("y"))


def refined_best(rows: DataFrame, key: str, gate: DataFrame, keep: int) -> DataFrame:
    """(key, best): int8 products choose ``keep`` gates, whose exact products replace
    theirs before the best of all is taken."""
    packed = gate.select("gate", F.transform("gate", V.int8).alias("packed"))

    def best(guess: Column) -> Column:
        chosen = F.transform(V.top_k(guess, keep), lambda r: r["index"])
        exact = lambda few: F.transform("gate", lambda w, i: F.when(F.array_contains(few, i), V.dot(F.col("embedding"), w)).otherwise(F.element_at(guess, i + 1)))
        return V.let(chosen, lambda few: V.let(exact(few), V.argmax))

    guess = V.let(V.int8(F.col("embedding")), lambda own: F.transform("packed", lambda g: V.int8_dot(own, g)))
    return rows.join(F.broadcast(packed)).select(key, V.let(guess, best).alias("best"))
