"""Queries of batched page streams and their events."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumspark.operators.tables import visible
from vellumspark.streaming import batching

from .base import query, read

LANES, CAP, RING, MOST = 4, 8, 4, 20


def tokens(seeds: list[int], steps: list[int], rings: list[list[int]]) -> list[int]:
    """A stand-in for the model whose next token depends on the whole ring."""
    return [(seed + 3 * step + sum(ring)) % 97 for seed, step, ring in zip(seeds, steps, rings, strict=True)]


def ends(token: int) -> bool:
    return token % 11 == 0


SERIAL = f"""WITH RECURSIVE s AS (SELECT event_id AS input_index, user_id * 7 + floor(coalesce(value, 0))::BIGINT AS seed FROM events),
w AS (SELECT input_index, seed, 0::BIGINT AS step, []::BIGINT[] AS made, NULL::BIGINT AS token, false AS done FROM s
    UNION ALL SELECT input_index, seed, step + 1, list_append(made, t), t, t % 11 = 0 OR step + 1 >= {MOST}
    FROM (SELECT *, (seed + 3 * step + coalesce(list_sum(made[greatest(1, len(made) - {RING - 1}):len(made)]), 0))::BIGINT % 97 AS t FROM w WHERE NOT done))"""


def _streams(spark, sf):
    visible(spark)
    e = read(spark, sf, "events")
    rows = e.select(F.col("event_id").alias("input_index"), (F.col("user_id") * 7 + F.floor(F.coalesce("value", F.lit(0.0)))).cast("long").alias("seed"))
    return batching.dealt(rows, LANES).unionByName(batching.flush(spark, LANES))


@query(f"{SERIAL} SELECT input_index, step - 1 AS step, token, done FROM w WHERE step > 0")
def z01_batched_streams(spark, sf):
    """Four lanes of at most eight active streams, beside each stream run alone."""
    out, _ = batching.watched(batching.batched(_streams(spark, sf), tokens, ends, MOST, CAP, RING), CAP)
    return out.select("input_index", "step", "token", "done")


@query(f"{SERIAL} SELECT (input_index % {LANES})::INT AS lane, count(*) AS tokens, count_if(done) AS retired, true AS within, true AS full FROM w WHERE step > 0 GROUP BY 1")
def t04_backfill(spark, sf):
    """The cap holds in every forward, and while streams wait all slots are taken: until the
    last stream is admitted no forward has fewer than the cap."""
    out, _ = batching.watched(batching.batched(_streams(spark, sf), tokens, ends, MOST, CAP, RING), CAP)
    last = out.groupBy("lane").agg(F.max(F.when(F.col("step") == 0, F.col("forward"))).alias("admitted"), F.count("*").alias("tokens"), F.count_if("done").alias("retired"), F.max("active").alias("most"), F.collect_set(F.when(F.col("active") < CAP, F.col("forward"))).alias("thin"))
    return last.select("lane", "tokens", "retired", (F.col("most") <= CAP).alias("within"), (F.size(F.filter("thin", lambda f: f < F.col("admitted"))) == 0).alias("full"))


@query("""SELECT page_id + 1 AS page, CASE WHEN html LIKE '%</html>' THEN '{"schema_version":1,"event":"page","status":"ok","page":' || (page_id + 1) || '}' ELSE '{"schema_version":1,"event":"page","status":"skipped","page":' || (page_id + 1) || ',"error_kind":"format_mismatch","message":"no end of page after ' || length(html) || ' characters"}' END AS json FROM pages""")
def z06_page_events(spark, sf):
    whole = F.col("html").endswith("</html>")
    message = F.concat(F.lit("no end of page after "), F.length("html"), F.lit(" characters"))
    return batching.page_events(read(spark, sf, "pages"), F.col("page_id") + 1, F.when(~whole, "format_mismatch"), message)
