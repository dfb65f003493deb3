"""URL verdicts: longest rule first, then a path-template tree per host.

Columns, aggregates and equi-joins only. Paths become shapes (digits generalised), and
everything after works on one row per host and shape. Level by level a segment keeps
its value if enough pages have it and its labelled share of bad pages differs from its
siblings'; other values and similar branches merge into '*'. A
template is rejected if its smoothed share of bad pages is too high.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept

#: Longest wins; (host and path prefix, verdict).
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: A literal branch has so many pages.
SUPPORT = 20
#: |z| of the two-proportion test from which branches differ, and labels each side needs.
DIFFER, BRANCH_LABELS = 1.96, 5
#: Weight of the parent rate in smoothing, labels a rejected template has, rejecting rate.
PRIOR, TEMPLATE_LABELS, REJECT = 5.0, 5, 0.5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """struct(rule, verdict) of the longest fitting rule, else null. A rule fits its host
    and all subdomains if the path starts with the rule's. ``rules`` is a short list that
    is part of the plan."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for text, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def shape_of(path: Column) -> Column:
    """Segments with digit runs as '*', joined by '/'."""
    return F.array_join(F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.regexp_replace(x, "[0-9]+", "*")), "/")


def templates(shapes: DataFrame) -> DataFrame:
    """(host, shape, n, m, b): pages, labelled and bad ones -> with ``template``.

    A level at a time, as deep as paths go. Below a branch that has too few pages or
    labels, or labels of one kind only, no branch can be told apart, so what follows is
    '*' to the end and such rows leave the loop; its rounds are few even if some url has
    thousands of segments.
    """
    split, deep = F.split("shape", "/"), F.when(F.col("shape") == "", 0).otherwise(F.size(F.split("shape", "/")))
    now, whole, level = kept(shapes.select("*", F.lit("").alias("template")), "shapes"), None, 0
    while True:
        parent = now.groupBy("host", "template").agg(*[F.sum(c).alias(c.upper() + "all") for c in "nmb"])
        alive = (F.col("Nall") >= SUPPORT) & (F.col("Mall") >= 2 * BRANCH_LABELS) & (F.col("Ball") > 0) & (F.col("Ball") < F.col("Mall"))
        rows = kept(now.join(parent, ["host", "template"]).withColumn("open", alive & (deep >= level)).withColumn("part", F.when(deep > level, split[level]).otherwise("")), "shapes")
        done = rows.where("NOT open").select("host", "shape", "n", "m", "b", F.concat("template", F.repeat(F.lit("/*"), F.greatest(deep - level, F.lit(0)))).alias("template"))
        whole = done if whole is None else whole.unionByName(done)
        rows = rows.where("open")
        if not rows.take(1):
            return whole
        child = rows.groupBy("host", "template", "part").agg(*[F.sum(c).alias(c) for c in "nmb"], *[F.first(c).alias(c) for c in ("Mall", "Ball")])
        m, b, rest_m, rest_b = F.col("m").cast("double"), F.col("b").cast("double"), (F.col("Mall") - F.col("m")).cast("double"), (F.col("Ball") - F.col("b")).cast("double")
        rate = (b + rest_b) / (m + rest_m)
        spread = F.sqrt(rate * (1 - rate) * (1 / m + 1 / rest_m))
        enough = (F.col("m") >= BRANCH_LABELS) & (F.col("Mall") - F.col("m") >= BRANCH_LABELS)
        apart = F.when(enough, F.abs(b / m - rest_b / rest_m) > DIFFER * spread).otherwise(False)
        literal = (F.col("n") >= SUPPORT) & apart
        named = child.select("host", "template", "part", F.when(F.col("part") == "", "").when(literal, F.concat(F.lit("/"), "part")).otherwise("/*").alias("step"))
        now = kept(rows.join(named, ["host", "template", "part"]).select("host", "shape", "n", "m", "b", F.concat("template", "step").alias("template")), "shapes")
        level += 1


def rejected(found: DataFrame) -> DataFrame:
    """(host, template) of rejected templates, by purity smoothed to the host's rate,
    itself smoothed to that of all pages."""
    bad, marked = found.agg(F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("m"), F.lit(0))).first()
    base = bad / marked if marked else 0.0
    hosts = found.groupBy("host").agg(F.sum("b").alias("hb"), F.sum("m").alias("hm"))
    each = found.groupBy("host", "template").agg(F.sum("b").alias("b"), F.sum("m").alias("m")).where(F.col("m") >= TEMPLATE_LABELS)
    prior = (F.col("hb") + PRIOR * base) / (F.col("hm") + PRIOR)
    rate = (F.col("b") + PRIOR * prior) / (F.col("m") + PRIOR)
    return each.join(hosts, "host").where(rate > REJECT).select("host", "template")


def judge(pages: DataFrame, labels: DataFrame, rules: tuple = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template) of every row of ``pages``.

    ``labels`` (doc_id, quality, toxic) tell pages by doc_id = page_id; quality 0 or
    toxic 1 is bad, a page with neither is unlabelled, of repeated labels a bad one
    counts. Null urls and those without '://' have an empty host and path and share one
    template. Repeated rows count each; null page_ids are unlabelled. Without labels
    nothing but rules blocks. Other columns are not read.
    """
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long"), host_of(url).alias("host"), path_of(url).alias("path")).withColumn("shape", shape_of(F.col("path")))
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    marks = labels.where("quality IS NOT NULL OR toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(F.max(bad.cast("long")).alias("bad"))
    shapes = rows.join(marks, "page_id", "left").groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("bad").alias("m"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b"))
    found = templates(shapes)
    out = rejected(found).withColumn("refused", F.lit(True))
    judged = found.join(out, ["host", "template"], "left").select("host", "shape", "template", F.coalesce("refused", F.lit(False)).alias("refused"))
    rule = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("refused"), "block").otherwise("allow")
    return rows.withColumn("fit", rule).join(judged, ["host", "shape"]).select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", own).alias("verdict"), "template")
