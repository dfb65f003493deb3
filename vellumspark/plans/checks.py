"""Queries of constraints, inherited values, dictionary matches and joins of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from .base import query, read


@query("""SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size % 5 = 4 THEN 'dtype' END, CASE WHEN p_size % 5 = 4 OR p_partkey % 3 = 0 THEN 'bytes' END, CASE WHEN p_partkey + 8 * p_size > 1500 THEN 'range' END], lambda x: x IS NOT NULL), ',') AS wrong FROM part""")
def p10_directory(spark, sf):
    """Parts as tensors of 2 by p_size in a payload of 1500 bytes; of a third the shape is
    wrong, and of a fifth the type."""
    from vellumspark.operators import checks

    k, size = F.col("p_partkey"), F.col("p_size").cast("long")
    shape = F.array(F.lit(2).cast("long"), F.when(k % 3 == 0, size + 1).otherwise(size))
    rows = read(spark, sf, "part").select("p_partkey", checks.directory_violations(F.when(size % 5 == 4, "X9").otherwise("F32"), shape, k, 8 * size, F.lit(1500)).alias("w"))
    return rows.select("p_partkey", F.array_join("w", ",").alias("wrong"))


@query("""SELECT page_id, sha256(html) ~ '^[0-9a-f]{64}$' AS hex, url ~ '^https?://' AS scheme FROM pages""")
def p11_header(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.sha2("html", 256).rlike("^[0-9a-f]{64}$").alias("hex"), F.col("url").rlike("^https?://").alias("scheme"))


@query("""SELECT n_name AS name, n_nationkey AS id, n_regionkey * 2 % 5 AS want FROM nation JOIN region ON n_nationkey = r_regionkey WHERE n_regionkey * 2 % 5 <> r_regionkey""")
def p12_pinned(spark, sf):
    """Nations that the pins name must have their ids; undeclared ones may have any."""
    pins = read(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.lit(True).alias("pinned"))
    rows = read(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("id"), (F.col("n_regionkey") * 2 % 5).alias("want"))
    return rows.join(pins, "id", "left").where("pinned AND want <> id").select("name", "id", "want")


@query("""SELECT side, count(*) AS n FROM ((SELECT 'left' AS side FROM (SELECT o_orderkey AS k FROM orders EXCEPT ALL SELECT l_orderkey FROM lineitem)) UNION ALL (SELECT 'right' FROM (SELECT l_orderkey FROM lineitem EXCEPT ALL SELECT o_orderkey FROM orders))) GROUP BY side""")
def p19_both_ways(spark, sf):
    from vellumspark.operators import checks

    return checks.both_ways(read(spark, sf, "orders").select(F.col("o_orderkey").alias("k")), read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")))


@query("""SELECT a.p_partkey AS id, CASE WHEN a.p_partkey % 100 < 64 THEN coalesce((b.p_partkey * 90 % 360 - 90 + 360) % 360, 0) ELSE 0 END::INTEGER AS rotation
FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey - a.p_partkey % 100""")
def s12_rotation(spark, sf):
    """Chains of a hundred parts of which the first knows its rotation: 64 find it."""
    from vellumspark.operators import checks

    k = F.col("p_partkey")
    nodes = read(spark, sf, "part").select(k.alias("id"), F.when(k % 100 != 0, k - 1).alias("parent"), F.when(k % 100 == 0, k * 90 % 360 - 90).alias("value"))
    return checks.inherited(nodes).select("id", F.pmod(F.coalesce("value", F.lit(0)), F.lit(360)).cast("int").alias("rotation"))


@query("SELECT p_brand, arg_max(p_partkey, p_size * 10000000 + p_partkey) AS p_partkey FROM part GROUP BY p_brand")
def s07_largest_image(spark, sf):
    from vellumspark.operators import checks

    return checks.last_largest(read(spark, sf, "part"), "p_brand", F.col("p_size"), "p_partkey")


@query("SELECT event_type, count(*) AS n, sum((props::JSON ->> '$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY event_type")
def s22_json_fields(spark, sf):
    """Nested text with an explicit schema; nothing is inferred."""
    rows = read(spark, sf, "events").select("event_type", F.from_json("props", "k bigint")["k"].alias("k"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?'))::INTEGER AS n, round(coalesce(list_sum(list_transform(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?'), lambda x: least(x::DOUBLE, 1e6))), 0), 3) AS total FROM documents WHERE text IS NOT NULL")
def s23_values(spark, sf):
    xs = F.transform(F.regexp_extract_all("text", F.lit("[0-9]+(?:\\.[0-9]+)?"), 0), lambda x: F.least(x.cast("double"), F.lit(1e6)))
    return read(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.size(xs).alias("n"), F.round(F.aggregate(xs, F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


@query("SELECT doc_id, array_to_string(regexp_extract_all(text, 'there|then|the|th|is'), ' ') AS found FROM documents WHERE text IS NOT NULL")
def j16_dictionary(spark, sf):
    from vellumspark.operators import checks

    return read(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.array_join(checks.matches(F.col("text"), ["th", "the", "is", "there", "then"]), " ").alias("found"))


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS w, generate_subscripts(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), 1) AS p FROM documents),
d AS (SELECT doc_id, w, min(p) AS p FROM w GROUP BY doc_id, w) SELECT doc_id, md5(string_agg(w, ' ' ORDER BY p)) AS h FROM d GROUP BY doc_id""")
def t08_ordered_distinct(spark, sf):
    from vellumspark.functions import text as T

    rows = read(spark, sf, "documents").select("doc_id", F.array_distinct(T.words(F.col("text"))).alias("w")).where(F.size("w") > 0)
    return rows.select("doc_id", F.md5(F.array_join("w", " ")).alias("h"))


@query("SELECT 0 AS block, s_suppkey AS k, s_acctbal AS v FROM supplier UNION ALL SELECT 1, c_custkey, c_acctbal FROM customer UNION ALL SELECT 2, -1, 0.5")
def t09_stacked_blocks(spark, sf):
    from vellumspark.operators import checks

    a = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    b = read(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return checks.stacked(a, b, spark.range(1).select(F.lit(-1).cast("long").alias("k"), F.lit(0.5).alias("v")))


@query("""SELECT c_custkey, coalesce(n::VARCHAR, 'no orders') AS result FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""")
def j10_one_result_each(spark, sf):
    """Every input has exactly one result, a failure if need be."""
    got = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return read(spark, sf, "customer").select("c_custkey").join(got, "c_custkey", "left").select("c_custkey", F.coalesce(F.col("n").cast("string"), F.lit("no orders")).alias("result"))


@query("""SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE pos <= greatest(n - 5, n // 2)""")
def w02_rolled_back(spark, sf):
    """A stream cut to what was accepted: all but its last five steps, half at least."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id")
    rows = read(spark, sf, "events").withColumn("pos", F.row_number().over(w.orderBy("ts", "event_id"))).withColumn("n", F.count("*").over(w))
    return rows.where(F.col("pos") <= F.greatest(F.col("n") - 5, F.floor(F.col("n") / 2))).select("user_id", "event_id")


@query("""SELECT q::INTEGER AS q, k::INTEGER AS k, e.embedding[1]::DOUBLE AS bias FROM range(0, 16) a(q), range(0, 16) b(k), embeddings e WHERE e.vec_id = q - k + 15""")
def w18_relative_lookup(spark, sf):
    """The bias of a query and a key is found by their distance; the grid is fixed."""
    table = read(spark, sf, "embeddings").select(F.col("vec_id").alias("at"), F.col("embedding")[0].cast("double").alias("bias")).where("at < 31")
    cells = spark.range(256).select((F.floor(F.col("id") / 16)).cast("int").alias("q"), (F.col("id") % 16).cast("int").alias("k"))
    return cells.withColumn("at", (F.col("q") - F.col("k") + 15).cast("long")).join(F.broadcast(table), "at").select("q", "k", "bias")


@query("""SELECT p_partkey, least(a, b)::INTEGER AS x0, least(w, greatest(a, b))::INTEGER AS x1 FROM (SELECT p_partkey, p_size * 20 AS a, p_partkey % 997 AS b, 800 AS w FROM part) WHERE least(a, b) < least(w, greatest(a, b))""")
def f16_figure_crop(spark, sf):
    """Corners in order, within the image; empty boxes go."""
    a, b = (F.col("p_size") * 20).cast("int"), (F.col("p_partkey") % 997).cast("int")
    rows = read(spark, sf, "part").select("p_partkey", F.least(a, b).alias("x0"), F.least(F.lit(800), F.greatest(a, b)).alias("x1"))
    return rows.where("x0 < x1")


@query("""SELECT conv_id, turn, '{"event":"page_skipped","page":' || (turn + 1) || ',"schema_version":1}' AS line FROM conversations""")
def k05_events(spark, sf):
    """Pages count from one."""
    line = F.to_json(F.struct(F.lit("page_skipped").alias("event"), (F.col("turn") + 1).alias("page"), F.lit(1).alias("schema_version")))
    return read(spark, sf, "conversations").select("conv_id", "turn", line.alias("line"))


@query("SELECT page_id, CASE WHEN lower(url) LIKE '%.html' THEN 'json' ELSE 'markdown' END AS format FROM pages")
def k01_output_format(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.when(F.lower("url").endswith(".html"), "json").otherwise("markdown").alias("format"))


@query()
def a34_beta_quantile(spark, sf):
    """The incomplete beta function is no SQL function; tests use closed forms."""
    from vellumspark.operators import checks

    from .stats import _posteriors

    p = _posteriors(spark, sf)
    return p.select("category", checks.beta_quantile(F.col("alpha"), F.col("beta"), F.lit(0.025)).alias("low"), checks.beta_quantile(F.col("alpha"), F.col("beta"), F.lit(0.975)).alias("high"))


@query()
def a39_last_places(spark, sf):
    """Bits of floats are no SQL; tests use numpy's own spacing."""
    from vellumspark.operators import checks

    rows = read(spark, sf, "embeddings")
    near = F.transform("embedding", lambda x: (x.cast("double") * 1.0000001).cast("float"))
    return rows.select("vec_id", checks.ulps(F.col("embedding"), near).alias("ulps"))
