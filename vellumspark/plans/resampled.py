"""Queries of resampled grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumspark.operators import resample

from .base import query, read

CELLS = "SELECT vec_id // 256 AS image, (vec_id % 256 // 16)::INT AS y, (vec_id % 16)::INT AS x, (floor(abs(embedding[1]::DOUBLE) * 1000) % 256)::BIGINT AS v FROM embeddings"


def _cells(spark, sf):
    v = F.col("vec_id")
    level = F.floor(F.abs(F.col("embedding")[0].cast("double")) * 1000) % 256
    return read(spark, sf, "embeddings").select(F.floor(v / 256).alias("image"), F.floor(v % 256 / 16).cast("int").alias("y"), (v % 16).cast("int").alias("x"), level.cast("long").alias("v"))


def _kernel(x: str, a: str) -> str:
    return f"(CASE WHEN abs({x}) < 1 THEN (({a} + 2) * abs({x}) - ({a} + 3)) * abs({x}) * abs({x}) + 1 WHEN abs({x}) < 2 THEN (((abs({x}) - 5) * abs({x}) + 8) * abs({x}) - 4) * {a} ELSE 0 END)"


def _weights(name: str, size: int, new: int) -> str:
    scale = f"({size}::DOUBLE / {new})"
    wide = f"greatest({scale}, 1::DOUBLE)"
    return f"""{name}_c AS (SELECT t::INT AS to_, (t + 0.5::DOUBLE) * {scale} AS centre FROM range({new}) r(t)),
{name}_r AS (SELECT to_, a::INT AS src, {_kernel(f'((a - centre + 0.5::DOUBLE) / {wide})', '(-0.5::DOUBLE)')} AS w FROM {name}_c, range({size}) s(a) WHERE a >= greatest(trunc(centre - 2 * {wide} + 0.5::DOUBLE), 0) AND a < least(trunc(centre + 2 * {wide} + 0.5::DOUBLE), {size})),
{name} AS (SELECT to_, src, trunc(CASE WHEN w < 0 THEN -0.5::DOUBLE ELSE 0.5::DOUBLE END + w / sum(w) OVER (PARTITION BY to_) * 4194304)::BIGINT AS w FROM {name}_r)"""


def _resized(to_height: int, to_width: int) -> str:
    clip = "greatest(0, least(255, (sum(v * w)::BIGINT + 2097152) >> 22))"
    return f"""WITH g AS ({CELLS}), {_weights('wx', 16, to_width)}, {_weights('wy', 16, to_height)},
h AS (SELECT image, y, to_ AS x, {clip} AS v FROM g JOIN wx ON x = src GROUP BY 1, 2, 3)
SELECT image, to_::INT AS y, x, {clip}::INT AS v FROM h JOIN wy ON y = src GROUP BY 1, 2, 3"""


@query(_resized(11, 10))
def f13_shrunk(spark, sf):
    return resample.resized(_cells(spark, sf), 16, 16, 11, 10, ["image"])


@query(_resized(24, 40))
def f13_enlarged(spark, sf):
    return resample.resized(_cells(spark, sf), 16, 16, 24, 40, ["image"])


def _curve(name: str, size: int, new: int) -> str:
    return f"""{name} AS (SELECT to_, least(greatest(base + k, 0), {size - 1})::INT AS src, sum({_kernel('(centre - base - k)', '(-0.75::DOUBLE)')}) AS w
    FROM (SELECT t::INT AS to_, (t + 0.5::DOUBLE) * {size} / {new} - 0.5::DOUBLE AS centre, floor((t + 0.5::DOUBLE) * {size} / {new} - 0.5::DOUBLE) AS base FROM range({new}) r(t)), (SELECT unnest([-1, 0, 1, 2]) AS k) GROUP BY 1, 2)"""


@query(f"""WITH t AS (SELECT vec_id AS pos, c, embedding[c + 1]::DOUBLE AS v FROM embeddings, (SELECT unnest([0, 1, 2]) AS c) WHERE vec_id < 257), {_curve('k', 16, 12)},
h AS (SELECT c, (pos - 1) // 16 AS y, to_ AS x, sum(v * w) AS v FROM t JOIN k ON (pos - 1) % 16 = src WHERE pos > 0 GROUP BY 1, 2, 3),
b AS (SELECT c, to_ AS y, x, sum(v * w) AS v FROM h JOIN k ON y = src GROUP BY 1, 2, 3)
SELECT (y * 12 + x + 1)::BIGINT AS pos, c::INT AS c, round(v, 7) AS v FROM b UNION ALL SELECT pos, c::INT, round(v, 7) FROM t WHERE pos = 0""")
def w17_position_table(spark, sf):
    """The first 257 vectors as a table of 16 by 16 positions and one beside them."""
    channels = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col("embedding")[c].cast("double").alias("v")) for c in range(3)]))
    rows = read(spark, sf, "embeddings").where("vec_id < 257").select(F.col("vec_id").alias("pos"), channels.alias("s")).select("pos", "s.c", "s.v")
    return resample.position_table(rows, 257, 145).withColumn("v", F.round("v", 7))
