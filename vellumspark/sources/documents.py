"""Documents, histories, measurements and vocabularies as JSON."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1
HISTORY = "name string, p50 double, p90 double, throughput double"
MEASURED = "schema string, source string, stages map<string,double>, tokens bigint"
#: Values that differ between runs that are equal (fixed values).
VOLATILE = ("seconds", "timestamp", "path", "pid", "host")


def document_json(pages: DataFrame, key: str) -> DataFrame:
    """(key, page, markdown, figure) -> (key, json): pages in order, joined by blank lines
    as the document's markdown; ``figures`` only if a page has one. A document's pages are
    one value, as they are one file."""
    rows = pages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page", "markdown", "figure"))).alias("p"))
    figures = F.filter("p", lambda x: x["figure"].isNotNull())
    listed = F.transform(figures, lambda x: F.struct(x["page"].alias("page"), x["figure"].alias("path")))
    body = F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"), F.array_join(F.transform("p", lambda x: x["markdown"]), "\n\n").alias("markdown"),
        F.transform("p", lambda x: F.struct(x["page"].alias("page"), x["markdown"].alias("markdown"))).alias("pages"), F.when(F.size(figures) > 0, listed).alias("figures"),
    )
    return rows.select(key, F.to_json(body).alias("json"))


def allocation_json(rows: DataFrame, key: str, budget: int) -> DataFrame:
    """(key, tensor, rate, distortion, marginal, reason) -> (key, json): the ledger of each
    allocation, tensors by name, with fixed rounding: rates to 4 places, distortions to 9
    (their total to 6), marginal gains to 7 digits; what is no number is null. Totals are
    sums of unrounded values. An allocation is one value, as it is one file."""

    def number(x: Column, places: int) -> Column:
        return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), F.round(x, places))

    @F.pandas_udf("double")
    def digits(v: pd.Series) -> pd.Series:  # Spark's own formats round ties of the shortest decimal, not of the value
        return v.map(lambda x: float(f"{x:.6e}"))

    each = F.struct(F.col("tensor"), F.col("rate").cast("double").alias("rate"), F.col("distortion").cast("double").alias("distortion"), digits(F.col("marginal").cast("double")).alias("marginal"), F.col("reason"))
    held = rows.groupBy(key).agg(F.array_sort(F.collect_list(each)).alias("a"), F.sum("rate").alias("r"), F.sum("distortion").alias("d"))
    listed = F.transform("a", lambda x: F.struct(number(x["rate"], 4).alias("bits"), number(x["distortion"], 9).alias("distortion"), F.when(~F.isnan(x["marginal"]) & (F.abs(x["marginal"]) < float("inf")), x["marginal"]).alias("marginal"), x["reason"].alias("reason"), x["tensor"].alias("tensor")))
    totals = F.struct(number(F.col("d").cast("double"), 6).alias("distortion"), number(F.col("r").cast("double"), 4).alias("bits"), (F.col("r") <= budget).alias("within"))
    body = F.struct(F.lit(budget).alias("budget"), F.size("a").alias("n_tensors"), F.lit(SCHEMA_VERSION).alias("schema_version"), totals.alias("totals"), listed.alias("allocation"))
    return held.select(key, F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def write_history(rows: DataFrame, path: str) -> None:
    rows.select("name", "p50", "p90", "throughput").write.mode("overwrite").json(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """What was measured before; nothing where there is no file. A malformed line is an
    error."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], HISTORY)
    return spark.read.schema(HISTORY).option("mode", "FAILFAST").json(path)


def measurement(text: Column, schema: str, source: str) -> Column:
    """A measurement's stages and tokens; null unless both tags are those asked for."""
    m = F.from_json(text, MEASURED)
    return F.when((m["schema"] == schema) & (m["source"] == source), m)


def merges(text: Column) -> Column:
    """array<struct<left, right, rank>> of a vocabulary's merges, pairs or "left right";
    of a repeated pair the first counts."""
    listed = F.from_json(text, "merges array<string>")["merges"]
    pairs = F.transform(listed, lambda s: F.when(s.startswith("["), F.from_json(s, "array<string>")).otherwise(F.split(s, " ", 2)))
    ranked = F.transform(pairs, lambda p, i: F.struct(p[0].alias("left"), p[1].alias("right"), F.when(F.array_position(pairs, p) == i + 1, i).alias("rank")))
    return F.filter(ranked, lambda x: x["rank"].isNotNull())


def vocabulary(text: Column) -> Column:
    """array<struct<key, value>> of token and id; added tokens come in place of others."""
    v = F.from_json(text, "vocab map<string,int>, added_tokens array<struct<id:int,content:string>>")
    added = F.coalesce(v["added_tokens"], F.array().cast("array<struct<id:int,content:string>>"))
    names = F.transform(added, lambda a: a["content"])
    own = F.map_filter(v["vocab"], lambda k, _: ~F.array_contains(names, k))
    return F.concat(F.map_entries(own), F.transform(added, lambda a: F.struct(a["content"].alias("key"), a["id"].alias("value"))))


def _scrub(value):
    if isinstance(value, dict):
        return {k: f"<{k}>" if k in VOLATILE else _scrub(v) for k, v in value.items()}
    return [_scrub(v) for v in value] if isinstance(value, list) else value


def scrubbed(text: Column) -> Column:
    """JSON whose volatile keys, at any depth, hold placeholders; null stays null. The
    depth is not known, which column functions would need."""

    @F.pandas_udf("string")
    def scrub(s: pd.Series) -> pd.Series:
        return s.map(lambda t: json.dumps(_scrub(json.loads(t)), separators=(",", ":"), ensure_ascii=False), na_action="ignore")

    return scrub(text)


def greedy(temperature: Column) -> Column:
    """Whether decoding takes the best token: a temperature that is not above zero, NaN
    and null included."""
    return ~F.coalesce((temperature > 0) & ~F.isnan(temperature), F.lit(False))


def ban_applies(size: Column, window: Column) -> Column:
    """Whether repeats are looked for at all."""
    return F.coalesce((size > 0) & (window > 0), F.lit(False))
