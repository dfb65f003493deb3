"""Queries of JSON documents, histories, measurements, vocabularies and modes."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from vellumspark.operators import gates
from vellumspark.operators.tables import shared_folder
from vellumspark.sources import documents as J

from .base import query, read


@query(r"""WITH p AS (SELECT s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS page, s_name, CASE WHEN s_suppkey % 7 = 0 THEN 'figures/' || s_suppkey || '.png' END AS figure FROM supplier)
SELECT s_nationkey, '{"schema_version":1,"markdown":"' || string_agg(s_name, '\n\n' ORDER BY page) || '","pages":[' || string_agg('{"page":' || page || ',"markdown":"' || s_name || '"}', ',' ORDER BY page) || ']'
|| coalesce(',"figures":[' || string_agg('{"page":' || page || ',"path":"' || figure || '"}', ',' ORDER BY page) FILTER (WHERE figure IS NOT NULL) || ']', '') || '}' AS json FROM p GROUP BY s_nationkey""")
def k02_document_json(spark, sf):
    """Nations as documents, their suppliers as pages."""
    page = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    figure = F.when(F.col("s_suppkey") % 7 == 0, F.concat(F.lit("figures/"), "s_suppkey", F.lit(".png")))
    return J.document_json(read(spark, sf, "supplier").select("s_nationkey", page.alias("page"), F.col("s_name").alias("markdown"), figure.alias("figure")), "s_nationkey")


def _benches(spark, sf):
    rows = read(spark, sf, "part").groupBy(F.col("p_brand").alias("name"))
    return rows.agg(F.min("p_retailprice").alias("p50"), F.max("p_retailprice").alias("p90"), F.max("p_size").cast("double").alias("throughput"))


@query("""SELECT p_brand AS name, min(p_retailprice) AS p50, max(p_retailprice) AS p90, max(p_size)::DOUBLE AS throughput FROM part GROUP BY p_brand""")
def k12_history_written(spark, sf):
    path = f"{shared_folder(spark)}/history-{uuid.uuid4().hex}"
    J.write_history(_benches(spark, sf), path)
    return J.read_history(spark, path)


@query("""SELECT p_brand AS name, min(p_retailprice) AS p50, max(p_retailprice) AS p90, max(p_size)::DOUBLE AS throughput FROM part GROUP BY p_brand""")
def s29_missing_history(spark, sf):
    """Without a history the first measurements are the baseline."""
    none = J.read_history(spark, f"{shared_folder(spark)}/history-{uuid.uuid4().hex}")
    return gates.advance(none, _benches(spark, sf))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 > 0 AND l_returnflag = 'R' THEN l_partkey END AS tokens, CASE WHEN l_linenumber % 3 > 0 AND l_returnflag = 'R' THEN l_quantity END AS decode_s FROM lineitem""")
def s30_measurements(spark, sf):
    """Measurements of other schemas or sources don't count."""
    said = F.struct(F.when(F.col("l_linenumber") % 3 > 0, "timing-1").otherwise("timing-0").alias("schema"), F.col("l_returnflag").alias("source"), F.create_map(F.lit("decode"), F.col("l_quantity").cast("double")).alias("stages"), F.col("l_partkey").alias("tokens"))
    rows = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.to_json(said).alias("text"))
    m = J.measurement(F.col("text"), "timing-1", "R")
    return rows.select("l_orderkey", "l_linenumber", m["tokens"].alias("tokens"), m["stages"]["decode"].alias("decode_s"))


@query("""SELECT s_suppkey, l AS "left", r AS "right", k AS rank FROM (SELECT s_suppkey, s_nationkey % 5 AS a, s_suppkey % 5 AS b FROM supplier), LATERAL (SELECT 't' || a AS l, 'x' AS r, 0 AS k UNION ALL SELECT 'y', 'z w', 1 UNION ALL SELECT 't' || b, 'x', 2 WHERE a <> b)""")
def s20_merges(spark, sf):
    """The third pair repeats the first where both numbers agree."""
    first, third = ((F.col(c) % 5).cast("string") for c in ("s_nationkey", "s_suppkey"))
    text = F.concat(F.lit('{"merges":["t'), first, F.lit(' x",["y","z w"],["t'), third, F.lit('","x"]]}'))
    return read(spark, sf, "supplier").select("s_suppkey", F.explode(J.merges(text)).alias("m")).select("s_suppkey", "m.left", "m.right", "m.rank")


@query("""SELECT s_suppkey, unnest(CASE WHEN s_suppkey % 3 = 0 THEN ['b', 'a'] ELSE ['a', 'b', 'end'] END) AS token, unnest(CASE WHEN s_suppkey % 3 = 0 THEN [2, 9] ELSE [1, 2, 9] END) AS id FROM supplier""")
def j03_added_tokens_first(spark, sf):
    text = F.concat(F.lit('{"vocab":{"a":1,"b":2},"added_tokens":[{"id":9,"content":"'), F.when(F.col("s_suppkey") % 3 == 0, "a").otherwise("end"), F.lit('"}]}'))
    return read(spark, sf, "supplier").select("s_suppkey", F.explode(J.vocabulary(text)).alias("v")).select("s_suppkey", F.col("v.key").alias("token"), F.col("v.value").alias("id"))


@query("""SELECT event_id, '{"id":' || event_id || ',"seconds":"<seconds>","runs":[{"path":"<path>","kind":"' || event_type || '"},' || user_id || ']}' AS json FROM events""")
def f20_scrubbed(spark, sf):
    text = F.concat(F.lit('{"id": '), "event_id", F.lit(', "seconds": 1.5, "runs": [{"path": ["'), F.col("user_id").cast("string"), F.lit('"], "kind": "'), "event_type", F.lit('"}, '), "user_id", F.lit("]}"))
    return read(spark, sf, "events").select("event_id", J.scrubbed(text).alias("json"))


@query("""SELECT event_id, event_id % 4 = 0 OR value IS NULL OR value - 50 <= 0 AS greedy, coalesce(event_id % 5 > 0 AND user_id % 3 > 0, false) AS bans FROM events""")
def p21_modes(spark, sf):
    """A temperature that is no number counts as greedy."""
    t = F.when(F.col("event_id") % 4 == 0, float("nan")).otherwise(F.col("value") - 50)
    return read(spark, sf, "events").select("event_id", J.greedy(t).alias("greedy"), J.ban_applies(F.col("event_id") % 5, F.col("user_id") % 3).alias("bans"))
