"""Queries of containers' pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumspark.sources import pages as P

from .base import query, read

GROUP = 9


def _containers(spark, sf):
    """PDF files of up to nine rows of ``pages``: two inner nodes, the second of which
    comes first and lists itself again; pages are listed from the last to the first. Every
    fifth file lists no page, every seventh is no PDF."""
    k, i = F.floor(F.col("page_id") / GROUP), F.col("page_id") % GROUP
    number = F.col("i") + 10
    page = F.concat(number, F.lit(" 0 obj\n<< /Type /Page /Parent 3 0 R /Resources << /Font << /Type /Font >> >> /Note (endless \\) text) /Label "), "page_id", F.lit(" >>\nendobj\n"))
    rows = read(spark, sf, "pages").select("page_id", k.alias("file"), i.alias("i")).where("page_id IS NOT NULL")
    files = rows.groupBy("file").agg(
        F.concat_ws("", F.array_sort(F.collect_list(page))).alias("pages"),
        F.sort_array(F.collect_list(F.when(F.col("i") < 4, F.col("i"))), False).alias("low"), F.sort_array(F.collect_list(F.when(F.col("i") >= 4, F.col("i"))), False).alias("high"),
    )
    kids = [F.concat_ws(" ", F.transform(c, lambda x: F.concat((x + 10).cast("string"), F.lit(" 0 R")))) for c in ("low", "high")]
    top = F.when(F.col("file") % 5 == 4, "").otherwise("4 0 R 3 0 R")
    text = F.concat(
        F.lit("%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids ["), top,
        F.lit("] >>\nendobj\n3 0 obj\n<< /Type /Pages /Kids ["), kids[0], F.lit("] >>\nendobj\n4 0 obj\n<< /Type /Pages /Kids ["), kids[1],
        F.lit(" 4 0 R 2 0 R] >>\nendobj\n"), "pages", F.lit("trailer\n<< /Root 1 0 R >>\nstartxref\n0\n%%EOF\n"),
    )
    return files.select("file", F.encode(F.when(F.col("file") % 7 == 6, F.concat(F.lit("x"), text)).otherwise(text), "utf-8").alias("content"))


PAGES = f"""f AS (SELECT page_id, page_id // {GROUP} AS file, page_id % {GROUP} AS i FROM pages WHERE page_id IS NOT NULL),
o AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY i < 4, i DESC)::INTEGER AS page, page_id, NULL::VARCHAR AS error FROM f WHERE file % 7 <> 6 AND file % 5 <> 4
UNION ALL SELECT DISTINCT file, NULL::INTEGER, NULL::BIGINT, CASE WHEN file % 7 = 6 THEN 'no container' ELSE 'no pages' END FROM f WHERE file % 7 = 6 OR file % 5 = 4)"""


@query(f"WITH {PAGES} SELECT file, page, page_id, error FROM o")
def s06_page_order(spark, sf):
    got = P.ordered_pages(P.page_nodes(_containers(spark, sf), "file"), "file")
    return got.select("file", "page", (F.col("file") * GROUP + F.col("node") - 10).alias("page_id"), "error")


@query(f"WITH {PAGES} SELECT o.file, page, page_id, length(html) AS chars FROM o JOIN pages USING (page_id)")
def u06_document_pages(spark, sf):
    """A container's pages one to many, each with what it holds; errors hold nothing."""
    got = P.ordered_pages(P.page_nodes(_containers(spark, sf), "file"), "file").where("error IS NULL")
    held = read(spark, sf, "pages").select("page_id", F.length("html").cast("bigint").alias("chars"))
    return got.select("file", "page", (F.col("file") * GROUP + F.col("node") - 10).alias("page_id")).join(held, "page_id")
