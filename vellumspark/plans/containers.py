"""Queries of tensor containers: tables are written to containers and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vellumspark.operators import convert
from vellumspark.operators.tables import shared_folder
from vellumspark.sources import containers

from .base import query, read
from .vectors import INT8_Q


def written(spark, sf, form="own"):
    """Every vector is a tensor, 256 a file, and its id another one of whole numbers."""
    path = f"{shared_folder(spark)}/containers-{uuid.uuid4().hex}"
    rows = read(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 256).alias("file"), F.col("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    size = F.array(F.size("x").cast("long"))
    vectors = rows.select("file", F.concat(F.lit("v"), "vec_id").alias("name"), F.lit("F32").alias("dtype"), size.alias("shape"), F.col("x").alias("values"))
    ids = rows.select("file", F.concat(F.lit("id"), "vec_id").alias("name"), F.lit("I32").alias("dtype"), F.array(F.lit(1).cast("long"), F.lit(2).cast("long")).alias("shape"), F.array("vec_id", -F.col("vec_id")).cast("array<double>").alias("values"))
    containers.write(vectors.unionByName(ids), path, form).agg(F.sum("bytes")).collect()
    return path


def file_number():
    return F.regexp_extract("path", "([0-9]+)[.][a-z]+$", 1).cast("long").alias("file")


ROWS = """t AS (SELECT vec_id // 256 AS file, 'v' || vec_id AS name, 'F32' AS dtype, [len(embedding)] AS shape, 4 * len(embedding) AS byte_len FROM embeddings
UNION ALL SELECT vec_id // 256, 'id' || vec_id, 'I32', [1, 2], 8 FROM embeddings)"""


def placed(padded: str) -> str:
    return f"WITH {ROWS} SELECT file, name, dtype, shape, byte_len, sum({padded}) OVER (PARTITION BY file ORDER BY name) - {padded} AS at FROM t"


def located(rows):
    first = rows.groupBy("path").agg(F.min("byte_offset").alias("first"))
    return rows.join(first, "path").select(file_number(), "name", "dtype", "shape", "byte_len", (F.col("byte_offset") - F.col("first")).alias("at"))


@query(placed("((byte_len + 63) // 64 * 64)"))
def s14_own_directory(spark, sf):
    return located(containers.directory(spark, written(spark, sf), ranges=True))


@query(placed("byte_len"))
def s15_safetensors_directory(spark, sf):
    return located(containers.directory(spark, written(spark, sf, "safetensors"), ranges=True))


@query("SELECT 'v' || vec_id AS name, len(embedding) AS n, list_min(embedding)::DOUBLE AS low, list_max(embedding)::DOUBLE AS high FROM embeddings WHERE vec_id IN (0, 7, 300)")
def s16_tensors_by_name(spark, sf):
    got = containers.values(spark, written(spark, sf), ["v0", "v7", "v300", "v-1"], ranges=True, rank=1, dtype="F32")
    return got.select("name", F.size("values").alias("n"), F.array_min("values").cast("double").alias("low"), F.array_max("values").cast("double").alias("high"))


@query("SELECT 'id' || vec_id AS name, vec_id AS first, -vec_id AS second FROM embeddings WHERE vec_id < 500")
def s17_decoded(spark, sf):
    got = containers.values(spark, written(spark, sf, "safetensors"), [f"id{i}" for i in range(500)])
    return got.select("name", F.col("values")[0].cast("long").alias("first"), F.col("values")[1].cast("long").alias("second"))


@query("SELECT f AS format, count(DISTINCT vec_id // 256) AS files FROM embeddings, (VALUES ('own'), ('safetensors')) AS o(f) GROUP BY f")
def s13_sniffed(spark, sf):
    both = [containers.formats(spark, written(spark, sf, form), ranges=True) for form in ("own", "safetensors")]
    return both[0].unionByName(both[1]).groupBy("format").agg(F.count("*").alias("files"))


@query("SELECT vec_id // 256 AS file, 2 * count(*) AS tensors, sum(4 * len(embedding) + 8) AS payload FROM embeddings GROUP BY ALL")
def k08_written_twice(spark, sf):
    """Files that hold the same bytes however their rows are dealt."""
    a, b = written(spark, sf), written(spark, sf)
    shas = [spark.read.format("binaryFile").load(p).select(file_number(), F.sha2("content", 256).alias(c)) for p, c in ((a, "one"), (b, "two"))]
    rows = containers.directory(spark, a).groupBy(file_number()).agg(F.count("*").alias("tensors"), F.sum("byte_len").alias("payload"))
    return rows.join(shas[0], "file").join(shas[1], "file").where("one = two").select("file", "tensors", "payload")


@query(f"""WITH r AS (SELECT vec_id, i, (embedding::DOUBLE[])[i * 8 + 1 : i * 8 + 8] AS v FROM embeddings, range(8) AS o(i)),
s AS (SELECT *, coalesce(nullif((list_max(list_transform(v, lambda x: abs(x))) / 127)::FLOAT::DOUBLE, 0), 1) AS scale FROM r),
q AS (SELECT vec_id, 'model.layers.' || vec_id || CASE WHEN vec_id % 3 = 0 THEN '.mlp.up_proj.weight' ELSE '.input_layernorm.weight' END AS name, string_agg(array_to_string({INT8_Q}, ','), ',' ORDER BY i) AS q FROM s GROUP BY vec_id)
SELECT name, CASE WHEN vec_id % 3 = 0 THEN 'I8' ELSE 'F32' END AS dtype, 64 AS n, CASE WHEN vec_id % 3 = 0 THEN q END AS q FROM q UNION ALL SELECT name || '.scale', 'F32', 8, NULL FROM q WHERE vec_id % 3 = 0""")
def k10_converted(spark, sf):
    """From one container to another: vectors as matrices of eight rows."""
    here, there = (f"{shared_folder(spark)}/containers-{uuid.uuid4().hex}" for _ in range(2))
    name = F.concat(F.lit("model.layers."), "vec_id", F.when(F.col("vec_id") % 3 == 0, ".mlp.up_proj.weight").otherwise(".input_layernorm.weight"))
    rows = read(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 256).alias("file"), name.alias("name"), F.lit("F32").alias("dtype"), F.array(F.lit(8).cast("long"), F.lit(8).cast("long")).alias("shape"), F.col("embedding").cast("array<float>").alias("values"))
    containers.write(rows, here, "safetensors").agg(F.sum("bytes")).collect()
    found = containers.values(spark, here, None, ranges=True).withColumn("file", file_number())
    containers.write(convert.quantised(found), there).agg(F.sum("bytes")).collect()
    got = containers.values(spark, there, None, ranges=True)
    return got.select("name", "dtype", F.size("values").alias("n"), F.when(F.col("dtype") == "I8", F.array_join(F.col("values").cast("array<int>"), ",")).alias("q"))
