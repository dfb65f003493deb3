"""Queries of record sources, checks, sinks, allocation and batch forms of streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumspark.operators import allocation
from vellumspark.sources import containers, records
from vellumspark.streaming import pages

from .base import query, read

LINES = """SELECT user_id AS run, event_id AS line_no, CASE event_id % 5 WHEN 0 THEN 'other output' WHEN 1 THEN '[timing] decode ' || (event_id % 97) || '.5 s (' || (event_id % 50) || ' tok)' WHEN 2 THEN '[timing] prefill ' || (event_id % 7) || ' s' WHEN 3 THEN '[timing] total = ' || (event_id % 31) || ' s' ELSE '[timing] vision ' || (event_id % 3) || '.25 s' END AS raw FROM events"""


def _lines(spark, sf):
    e = F.col("event_id")
    n = lambda k: (e % k).cast("string")
    forms = [F.lit("other output"), F.concat(F.lit("[timing] decode "), n(97), F.lit(".5 s ("), n(50), F.lit(" tok)")), F.concat(F.lit("[timing] prefill "), n(7), F.lit(" s")), F.concat(F.lit("[timing] total = "), n(31), F.lit(" s")), F.concat(F.lit("[timing] vision "), n(3), F.lit(".25 s"))]
    return read(spark, sf, "events").select(F.col("user_id").alias("run"), e.alias("line_no"), F.get(F.array(*forms), (e % 5).cast("int")).alias("raw"))


@query(f"""WITH p AS (SELECT run, line_no, regexp_extract(raw, '\\] ([a-z]+)', 1) AS stage, regexp_extract(raw, '([0-9.]+) s', 1)::DOUBLE AS s, nullif(regexp_extract(raw, '\\(([0-9]+) tok', 1), '')::INTEGER AS tokens FROM ({LINES}) WHERE raw LIKE '[timing]%')
SELECT run, stage, round(CASE WHEN stage = 'total' THEN max_by(s, line_no) ELSE sum(s) END, 6) AS s, max(tokens) AS tokens, count(*) AS occurrences FROM p GROUP BY run, stage""")
def s24_timing_log(spark, sf):
    return records.stage_totals(records.timing_lines(_lines(spark, sf), "[timing]")).withColumn("s", F.round("s", 6))


@query("""WITH j AS (SELECT event_id, event_id % 4 AS k FROM events)
SELECT event_id, CASE k WHEN 0 THEN '' WHEN 1 THEN 'event' WHEN 2 THEN 'schema_version,ts' ELSE 'value,digest' END AS wrong FROM j""")
def p13_log_contract(spark, sf):
    k = F.col("event_id") % 4
    line = (
        F.when(k == 0, F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit(2.5).alias("ts"), F.lit("metric").alias("event"), F.col("value"))))
        .when(k == 1, F.lit('{"schema_version":1,"ts":1.0,"event":"unheard"}'))
        .when(k == 2, F.lit('{"schema_version":2,"event":"start"}'))
        .otherwise(F.lit('{"schema_version":1,"ts":0,"event":"metric","digest":"XYZ"}'))
    )
    return read(spark, sf, "events").select("event_id", F.array_join(records.log_violations(line), ",").alias("wrong"))


@query("""SELECT p_size % 7 AS i, count(*) AS n, bool_and(p_retailprice > 0) AS ok FROM part GROUP BY 1""")
def s18_manifest(spark, sf):
    """Rows as manifests and back: the parsed sizes are what was written."""
    parsed = read(spark, sf, "part").select(F.col("p_size"), "p_retailprice", records.manifest(F.to_json(F.struct(F.lit(1).alias("schema_version"), F.col("p_name").alias("model"), F.create_map(F.lit("q"), F.struct(F.col("p_size").cast("long").alias("size"))).alias("quants")))).alias("m"))
    return parsed.groupBy((F.col("m.quants")["q"]["size"] % 7).cast("int").alias("i")).agg(F.count("*").alias("n"), F.bool_and((F.col("p_retailprice") > 0) & (F.col("m.model") != "")).alias("ok"))


@query("""SELECT conv_id AS file, true AS ok, 0::BIGINT AS bad_parts FROM conversations GROUP BY conv_id""")
def s19_parts_verified(spark, sf):
    """Turns as parts of a file, each with its size and digest."""
    rows = read(spark, sf, "conversations").select(F.col("conv_id").alias("file"), F.struct("turn", "role").alias("ordinal"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    order = F.array_sort(F.collect_list(F.struct("ordinal", "content")))
    whole = rows.groupBy("file").agg(F.sha2(F.aggregate(order, F.lit(b""), lambda a, p: F.concat(a, p["content"])), 256).alias("file_sha256"))
    return records.reassembled(rows.join(whole, "file").withColumns({"size": F.octet_length("content"), "sha256": F.upper(F.sha2("content", 256))}))


@query("""SELECT count(*) AS count, round(sum(length(html)) / 1000.0::DOUBLE, 6) AS seconds_total, round(sum(length(html)) / 1000.0::DOUBLE / count(*), 6) AS seconds_per_image FROM pages""")
def k04_batch_summary(spark, sf):
    out = records.summary(read(spark, sf, "pages").select((F.char_length("html") / 1000).alias("seconds")))
    return out.select("count", F.round("seconds_total", 6).alias("seconds_total"), F.round("seconds_per_image", 6).alias("seconds_per_image"))


@query("""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '{"image":"p' || page_id || '","ok":false,"error":"bad page"}' ELSE '{"image":"p' || page_id || '","ok":true,"markdown":"# ' || page_id || '"}' END AS line FROM pages""")
def k03_result_lines(spark, sf):
    p = F.col("page_id").cast("string")
    rows = read(spark, sf, "pages").select(F.concat(F.lit("p"), p).alias("path"), F.lit(None).cast("double").alias("seconds"), F.concat(F.lit("# "), p).alias("markdown"), F.when(F.col("page_id") % 4 == 0, "bad page").alias("error"))
    return records.result_lines(rows).select(F.regexp_extract("value", '"p(-?[0-9]+)"', 1).cast("long").alias("page_id"), F.col("value").alias("line"))


@query("""WITH p AS (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '\\s+$', '') AS t, turn % 5 = 4 AS bad FROM conversations)
SELECT conv_id AS doc, md5(string_agg(t, chr(10) || chr(10) ORDER BY turn, t) FILTER (WHERE NOT bad)) AS h, CASE WHEN bool_and(bad) THEN 'page failed' END AS first_error FROM p GROUP BY conv_id""")
def t17_joined_pages(spark, sf):
    rows = read(spark, sf, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), F.coalesce("text", F.lit("")).alias("markdown"), F.when(F.col("turn") % 5 == 4, "page failed").alias("error"))
    return records.joined_pages(rows).select("doc", F.md5("markdown").alias("h"), "first_error")


@query("""SELECT vec_id, CASE WHEN len(list_distinct(list_transform(embedding, lambda x: floor(abs(x) * 32) % 32))) <= 64 THEN 'png' ELSE 'jpeg' END AS format FROM embeddings""")
def k06_figure_format(spark, sf):
    pixels = read(spark, sf, "embeddings").select(F.col("vec_id").alias("image"), F.transform("embedding", lambda x: F.floor(F.abs(x) * 256).cast("int") * 65793).alias("rgb"))
    return records.figure_format(pixels).select(F.col("image").alias("vec_id"), "format")


@query("""SELECT page_id, url LIKE '%.html' OR left(html, 5) = '<!DOC' AS other, lower(url) LIKE '%.pdf' OR left(html, 5) = '%PDF-' AS pdf FROM pages""")
def s05_pdf_sniff(spark, sf):
    rows = read(spark, sf, "pages")
    return rows.select("page_id", (F.col("url").endswith(".html") | (F.left("html", F.lit(5)) == "<!DOC")).alias("other"), containers.is_pdf(F.col("url"), F.encode("html", "UTF-8")).alias("pdf"))


def _curves(spark, sf):
    return read(spark, sf, "part").select(F.col("p_brand").alias("tensor"), F.col("p_size").cast("long").alias("rate"), (F.col("p_retailprice") / 100).alias("distortion"))


HULL = """WITH c AS (SELECT p_brand AS tensor, p_size::DOUBLE AS r, min(p_retailprice / 100) AS d FROM part GROUP BY 1, 2),
h AS (SELECT b.* FROM c b WHERE NOT EXISTS (SELECT 1 FROM c a JOIN c p ON a.tensor = p.tensor WHERE a.tensor = b.tensor AND a.r < b.r AND p.r > b.r AND (b.r - a.r) * (p.d - a.d) - (b.d - a.d) * (p.r - a.r) <= 0)),
k AS (SELECT *, d - lead(d) OVER (PARTITION BY tensor ORDER BY r) AS gain FROM h),
g AS (SELECT *, max(CASE WHEN gain > 1e-6 THEN r END) OVER (PARTITION BY tensor) AS lastgain FROM k)
SELECT tensor, r, d FROM g WHERE r <= coalesce((SELECT min(x.r) FROM h x WHERE x.tensor = g.tensor AND x.r > lastgain), (SELECT min(x.r) FROM h x WHERE x.tensor = g.tensor))"""


@query(f"SELECT tensor, r, round(d, 6) AS d FROM ({HULL})")
def w09_convex_hull(spark, sf):
    points = allocation.hull(_curves(spark, sf)).select("tensor", F.explode("hull").alias("p"))
    return points.select("tensor", "p.r", F.round("p.d", 6).alias("d"))


@query("""SELECT tensor, min_by(rate, struct_pack(c := c, r := -rate)) AS rate FROM (SELECT p_brand AS tensor, p_size::BIGINT AS rate, round(p_retailprice / 100 + 0.3::DOUBLE * p_size, 12) AS c FROM part) GROUP BY tensor""")
def a20_priced_choice(spark, sf):
    return allocation.choose(_curves(spark, sf), "tensor", 0.3).select("tensor", "rate")


def _filled_sql(budget: int) -> str:
    """Steps in slope order, one at a time: each is taken if it fits and its tensor goes on."""
    return f"""WITH RECURSIVE p AS (SELECT tensor, r, d, row_number() OVER (PARTITION BY tensor ORDER BY r) - 1 AS step, count(*) OVER (PARTITION BY tensor) - 1 AS steps, r - lag(r) OVER (PARTITION BY tensor ORDER BY r) AS added, lag(d) OVER (PARTITION BY tensor ORDER BY r) - d AS dropped FROM ({HULL})),
e AS (SELECT *, row_number() OVER (ORDER BY dropped / added DESC, tensor, step) AS k FROM p WHERE step > 0),
walk AS (SELECT 0::BIGINT AS k, (SELECT sum(r) FROM p WHERE step = 0) AS used, []::VARCHAR[] AS stopped, false AS took
    UNION ALL SELECT e.k, CASE WHEN used + added <= {budget} AND NOT list_contains(stopped, tensor) THEN used + added ELSE used END, CASE WHEN used + added <= {budget} THEN stopped ELSE list_append(stopped, tensor) END, used + added <= {budget} AND NOT list_contains(stopped, tensor) FROM walk JOIN e ON e.k = walk.k + 1),
reached AS (SELECT tensor, max(step) AS step FROM walk JOIN e USING (k) WHERE took GROUP BY tensor),
filled AS (SELECT p.tensor, p.step, p.steps, p.r AS rate, p.d AS distortion FROM p LEFT JOIN reached USING (tensor) WHERE p.step = coalesce(reached.step, 0)),
c AS (SELECT p_brand AS tensor, p_size::DOUBLE AS rate, min(p_retailprice / 100) AS d FROM part GROUP BY 1, 2)"""


@query(f"{_filled_sql(200)} SELECT tensor, step::INT AS step, steps::INT AS steps, rate, round(distortion, 6) AS distortion FROM filled")
def a21_waterfill(spark, sf):
    filled = allocation.waterfill(_curves(spark, sf), budget=200)
    return filled.select("tensor", "step", "steps", "rate", F.round("distortion", 6).alias("distortion"))


@query(f"""{_filled_sql(200)} SELECT tensor, rate, round(distortion, 6) AS distortion, CASE WHEN step = 0 THEN 'flat: starved to cheapest' WHEN step = steps THEN 'steep: upgraded to highest available precision' ELSE 'interior: upgraded one or more hull steps' END AS reason, 'lagrangian-waterfill' AS method, NULL::VARCHAR AS fallback
FROM filled WHERE (SELECT sum(distortion) FROM filled) <= (SELECT max_by(d, struct_pack(a := r, b := t)) FROM (SELECT t, sum(r) AS r, sum(d) AS d FROM (SELECT o.rate AS t, c.tensor, coalesce(min(c.rate) FILTER (c.rate >= o.rate), min(c.rate)) AS r, coalesce(min_by(c.d, c.rate) FILTER (c.rate >= o.rate), min_by(c.d, c.rate)) AS d FROM c, (SELECT DISTINCT rate FROM c) o GROUP BY 1, 2) GROUP BY t) WHERE r <= 200) + 1e-12""")
def a23_allocated(spark, sf):
    return allocation.allocated(_curves(spark, sf), 200, 10).withColumn("distortion", F.round("distortion", 6))


@query("""WITH c AS (SELECT p_brand AS tensor, p_size::DOUBLE AS rate, min(p_retailprice / 100) AS d FROM part GROUP BY 1, 2)
SELECT tensor, coalesce(min(rate) FILTER (rate >= 10), min(rate)) AS rate, round(coalesce(min_by(d, rate) FILTER (rate >= 10), min_by(d, rate)), 6) AS distortion, 'uniform' AS reason, 'uniform-10' AS method, 'optimizer error: the budget is below the cheapest allocation' AS fallback FROM c GROUP BY tensor""")
def a23_infeasible(spark, sf):
    """A budget that no allocation meets falls back to the uniform one, and says why."""
    return allocation.allocated(_curves(spark, sf), 1, 10).withColumn("distortion", F.round("distortion", 6))


@query("""WITH c AS (SELECT p_brand AS tensor, p_size::DOUBLE AS rate, min(p_retailprice / 100) AS d FROM part GROUP BY 1, 2),
u AS (SELECT t, sum(r) AS r, sum(d) AS d FROM (SELECT o.rate AS t, c.tensor, coalesce(min(c.rate) FILTER (c.rate >= o.rate), min(c.rate)) AS r, coalesce(min_by(c.d, c.rate) FILTER (c.rate >= o.rate), min_by(c.d, c.rate)) AS d FROM c, (SELECT DISTINCT rate FROM c) o GROUP BY 1, 2) GROUP BY t)
SELECT t AS target, r AS rate, round(d, 6) AS distortion FROM u WHERE r <= 400 ORDER BY r DESC, t DESC LIMIT 1""")
def a23_uniform_within(spark, sf):
    return allocation.uniform_within(_curves(spark, sf), 400).withColumn("distortion", F.round("distortion", 6))


@query()
def a22_exact_allocation(spark, sf):
    """A knapsack table per market segment of brands; tests compare with all choices."""
    curves = _curves(spark, sf).withColumn("line", F.substring("tensor", 1, 7))
    best = curves.groupBy("line", "tensor", "rate").agg(F.min("distortion").alias("distortion"))
    return allocation.exact(best, 60, "line")


@query("""SELECT count(*) AS tensors, round(sum(distortion), 6) AS distortion, sum(rate)::BIGINT AS rate FROM (SELECT p_brand, max(p_size) AS rate, min_by(p_retailprice / 100, struct_pack(s := -p_size, p := p_retailprice)) AS distortion FROM part GROUP BY p_brand)""")
def a19_totals(spark, sf):
    """Every tensor at its greatest rate: the uniform baseline's totals."""
    own = _curves(spark, sf).groupBy("tensor").agg(F.max("rate").alias("rate"), F.min_by("distortion", F.struct((-F.col("rate")).alias("r"), "distortion")).alias("distortion"))
    return own.agg(F.count("*").alias("tensors"), F.round(F.sum("distortion"), 6).alias("distortion"), F.sum("rate").alias("rate"))


@query("""SELECT time_bucket(INTERVAL '5 minutes', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2""")
def z08_tumbling_windows(spark, sf):
    """An extension: event-time windows, here over the whole table at once."""
    out = pages.windowed(read(spark, sf, "events"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))
