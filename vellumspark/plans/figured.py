"""Queries of the figures sink."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vellumspark.operators.tables import shared_folder, visible
from vellumspark.sources import figures

from .base import query, read

EACH = "SELECT page_id + 1 AS page, n, CASE WHEN (page_id + n) % 2 = 0 THEN 'png' ELSE 'jpg' END AS ext, url, html FROM pages, (SELECT unnest([1, 2]) AS n) WHERE n <= page_id % 3"


@query(f"""SELECT page, max(md) AS markdown, sum(bytes)::BIGINT AS bytes, count(*) AS files FROM (SELECT page, octet_length(encode(url || n)) AS bytes,
CASE WHEN page % 3 = 2 THEN '![figure 1](figures/page' || page || '_figure_1.' || (CASE WHEN page % 2 = 0 THEN 'png' ELSE 'jpg' END) || ') text ![](images/1.jpg)'
ELSE '![figure 1](figures/page' || page || '_figure_1.' || (CASE WHEN page % 2 = 0 THEN 'png' ELSE 'jpg' END) || ') text ![figure 2](figures/page' || page || '_figure_2.' || (CASE WHEN page % 2 = 0 THEN 'jpg' ELSE 'png' END) || ')' END AS md FROM ({EACH})) GROUP BY page""")
def k07_figures(spark, sf):
    """Figures written from pages, read back through the manifest, and the markdown that
    refers to them; a token without a figure stays."""
    visible(spark)
    pages = read(spark, sf, "pages").where("page_id % 3 > 0")
    many = F.sequence(F.lit(1), (F.col("page_id") % 3).cast("int"))
    each = pages.select((F.col("page_id") + 1).alias("page"), "url", F.explode(many).alias("figure"))
    rows = each.select("page", "figure", F.lit("figure").alias("label"), F.when((F.col("page") + F.col("figure")) % 2 == 1, "png").otherwise("jpg").alias("ext"), F.encode(F.concat("url", F.col("figure")), "UTF-8").alias("content"))
    written = figures.write(rows, f"{shared_folder(spark)}/figures-{uuid.uuid4().hex}", prefix="figures/")
    token = F.concat(F.lit("![](images/"), F.col("figure") - 1, F.lit(".jpg)"))
    listed = written.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("figure", token.alias("token"), "path"))).alias("f"), F.sum("bytes").alias("bytes"), F.count("*").alias("files"))
    return listed.select("page", figures.referred(F.lit("![](images/0.jpg) text ![](images/1.jpg)"), F.col("f")).alias("markdown"), "bytes", "files")
