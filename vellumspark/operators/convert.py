"""Tensors by policy: matrices of eight-bit classes by rows, others as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.functions import vectors as V

from .policy import converter


def quantised(tensors: DataFrame) -> DataFrame:
    """(file, name, dtype, shape, values), a matrix that the converter's rule names as I8
    rows beside their scales (name and ``.scale``). Names must differ within a file."""
    narrow = converter(F.col("name")) & (F.size("shape") == 2) & (F.size("values") > 0)
    width = F.col("shape")[1].cast("int")
    rows = F.transform(F.sequence(F.lit(0), F.col("shape")[0].cast("int") - 1), lambda i: V.int8(F.slice(F.col("values"), i * width + 1, width)))
    split = tensors.where(narrow).withColumn("rows", rows)
    q = split.select("file", "name", F.lit("I8").alias("dtype"), "shape", F.flatten(F.col("rows.q")).cast("array<float>").alias("values"))
    scales = split.select("file", F.concat("name", F.lit(".scale")).alias("name"), F.lit("F32").alias("dtype"), F.slice("shape", 1, 1).alias("shape"), F.col("rows.scale").alias("values"))
    return tensors.where(~F.coalesce(narrow, F.lit(False))).select("file", "name", "dtype", "shape", "values").unionByName(q).unionByName(scales)
