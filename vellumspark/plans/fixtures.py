"""Queries of tensors read by ranges."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vellumspark.operators.tables import shared_folder
from vellumspark.sources import containers, tensors

from .base import query, read
from .containers import file_number

SLICE, ROWS, WHOLE = 1000, 200, 2**53 + 1


@query(f"""WITH r AS (SELECT vec_id // {ROWS} AS file, row_number() OVER (PARTITION BY vec_id // {ROWS} ORDER BY vec_id) - 1 AS r, embedding FROM embeddings),
u AS (SELECT file, r * len(embedding) + generate_subscripts(embedding, 1) - 1 AS place, unnest(embedding)::DOUBLE AS v FROM r)
SELECT file, place // {SLICE} * {SLICE} AS start, count(*) AS n, round(sum(v), 5) AS total FROM u GROUP BY 1, 2""")
def s28_fixture_arrays(spark, sf):
    """Two hundred vectors a file; hidden sidecars beside them are no fixtures."""
    path = f"{shared_folder(spark)}/fixtures-{uuid.uuid4().hex}"
    rows = read(spark, sf, "embeddings").groupBy(F.floor(F.col("vec_id") / ROWS).alias("k")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("x"))
    shape = F.array(F.size("x").cast("long"), F.size(F.col("x")[0]["embedding"]).cast("long"))
    made = rows.select(F.explode(F.array(F.col("k").cast("string"), F.concat(F.lit("._"), "k"))).alias("file"), F.lit("F32").alias("dtype"), shape.alias("shape"), F.flatten("x.embedding").alias("values"))
    tensors.write_arrays(made, path).agg(F.sum("bytes")).collect()
    got = tensors.read(spark, path, slice=SLICE, bytes=20000)
    return got.select(F.col("name").cast("long").alias("file"), "start", F.size("floats").cast("long").alias("n"), F.round(F.aggregate("floats", F.lit(0.0), lambda a, v: a + v), 5).alias("total"))


@query(f"SELECT o_orderkey // 4096 AS file, row_number() OVER (PARTITION BY o_orderkey // 4096 ORDER BY o_orderkey) - 1 AS pos, o_orderkey + {WHOLE} AS value FROM orders")
def s13_whole_numbers(spark, sf):
    """Whole numbers beyond those that doubles hold come back as they are; of each file's
    two tensors one is read."""
    path = f"{shared_folder(spark)}/containers-{uuid.uuid4().hex}"
    rows = read(spark, sf, "orders").groupBy(F.floor(F.col("o_orderkey") / 4096).alias("file")).agg(F.array_sort(F.collect_list(F.col("o_orderkey") + WHOLE)).alias("values"))
    name = F.explode(F.array(F.lit("key"), F.lit("again"))).alias("name")
    containers.write(rows.select("file", name, F.lit("I64").alias("dtype"), F.array(F.size("values").cast("long")).alias("shape"), "values"), path, "safetensors").agg(F.sum("bytes")).collect()
    got = tensors.read(spark, path, ["key"], slice=512)
    return got.select(file_number(), "start", F.posexplode("wholes").alias("i", "value")).select("file", (F.col("start") + F.col("i")).alias("pos"), "value")
