"""Boilerplate lines by their frequency within a site: columns, aggregates and joins.

A line is known by two hashes of its trimmed text. First the pages of every (host,
line) are counted, each page once, with partial sums before the shuffle; then lines on
too many of a host's pages become one array a host, which is bounded by the pages' mean
number of lines over the ratio. Texts are only ever filtered where they are read, unless
there are so many boilerplate lines that hosts must be joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, kept

#: A line is boilerplate on over RATIO of its host's pages, MIN_PAGES at least.
RATIO, MIN_PAGES = 0.02, 5
#: Boilerplate lines that are sent to all tasks; beyond it, hosts are joined, each host's
#: rows dealt over so many keys.
BROADCAST_LINES, SALTS = 50_000, 64


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def line_key(line: Column) -> Column:
    """Identity of a line; null for a blank one, which is never boilerplate."""
    bare = F.trim(F.regexp_replace(line, "[\\x09-\\x0D]", " "))
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("a"), F.hash(bare).alias("b")))


def boilerplate(docs: DataFrame, host: Column, text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, copies_once: bool = False) -> DataFrame:
    """(host, drop): per host the keys of its boilerplate lines. Rows of one host and
    text are one page if ``copies_once``."""
    pages = docs.select(host.alias("host"), F.col(text).cast("string").alias("text"))
    if copies_once:
        pages = pages.withColumn("page", F.coalesce(F.xxhash64("text"), F.lit(0)))
    totals = pages.groupBy("host").agg((F.count_distinct("page") if copies_once else F.count("*")).alias("pages"))
    keys = F.array_distinct(F.transform(lines(F.col("text")), line_key))
    said = pages.select("host", F.explode(keys).alias("k"), *["page"] * copies_once).where("k IS NOT NULL")
    counts = (said.distinct() if copies_once else said).groupBy("host", "k.a", "k.b").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    over = counts.withColumnRenamed("host", "_host").join(totals, F.col("_host").eqNullSafe(F.col("host"))).where(F.col("n") > ratio * F.col("pages"))
    return over.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("drop"))


def dedup_lines(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, copies_once: bool = False) -> DataFrame:
    """``docs`` with boilerplate lines cut from ``text``, and how many as lines_dropped.

    Every row stays. A line goes if it is on over ``ratio`` of the rows of its host and
    on ``min_pages`` at least; lines are compared without white space around them, blank
    lines stay, and a row that says a line twice counts once. Null text stays null (0
    dropped); a text of boilerplate only becomes empty. Rows without a host are a site
    of their own; repeated rows count each, or copies of a text once a host if
    ``copies_once``. A column called lines_dropped is replaced.
    """
    drops = kept(boilerplate(docs, F.col(host), text, ratio, min_pages, copies_once), "boilerplate")
    key, gone, salt = (free_name(docs, c) for c in ("_line_host", "_line_drop", "_line_salt"))
    by = drops.select(F.col("host").alias(key), F.col("drop").alias(gone))
    many = by.agg(F.coalesce(F.sum(F.size(gone)), F.lit(0))).first()[0]
    same = F.col(host).eqNullSafe(F.col(key))
    if many <= BROADCAST_LINES:
        joined = docs.join(F.broadcast(by), same, "left")
    else:
        salted = by.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = docs.join(salted, same & (F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int") == F.col(salt)), "left").drop(salt)
    whole = lines(F.col(text).cast("string"))
    held = F.array_intersect(F.transform(whole, line_key), F.col(gone))
    cut = joined.withColumn(gone, held)
    stay = F.filter(whole, lambda x: F.coalesce(~F.array_contains(F.col(gone), line_key(x)), F.lit(True)))
    cut = cut.withColumn(gone, F.when(F.size(gone) > 0, stay))
    clean = F.when(F.col(gone).isNotNull(), F.array_join(gone, "\n")).otherwise(F.col(text))
    dropped = F.when(F.col(gone).isNotNull(), F.size(whole) - F.size(gone)).otherwise(0)
    return cut.withColumn("lines_dropped", dropped).withColumn(text, clean).select(*[c for c in docs.columns if c != "lines_dropped"], "lines_dropped")
