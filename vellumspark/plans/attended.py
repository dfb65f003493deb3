"""Queries of attention over the keys of a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumspark.operators import attention

from .base import query, read

PREFIX, RING, SCALE = 16, 24, 0.125
KEYS = "p AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"
SEEN = f"k.label IS NOT DISTINCT FROM q.label AND k.pos <= q.pos AND (k.pos < {PREFIX} OR k.pos > q.pos - {RING})"


def _attended(queries: str, key: str = "label, pos", scores: str = "k.e", mine: str = "q.e", on: str = SEEN) -> str:
    return f"""{queries}, s AS (SELECT q.*, list_dot_product({mine}, {scores}) * {SCALE} AS s, {scores} AS v FROM q JOIN k ON {on}),
m AS (SELECT *, exp(s - max(s) OVER (PARTITION BY {key})) AS w, max(s) OVER (PARTITION BY {key}) AS top FROM s)"""


SUMS = "round(sum(w * v[1]) / sum(w), 6) AS a0, round(sum(w * v[2]) / sum(w), 6) AS a1, round(sum(w * v[5]) / sum(w), 6) AS a4"


def _stream(spark, sf):
    e = F.transform("embedding", lambda x: x.cast("double"))
    rows = attention.positions(read(spark, sf, "embeddings"), ["label"], ["vec_id"])
    return rows.select("label", "pos", e.alias("e"))


def _keys(rows, *key):
    return rows.select(*key, F.col("e").alias("k"), F.col("e").alias("v"))


def _shown(out, *key):
    return out.select(*key, *[F.round(F.col("attended")[i], 6).alias(f"a{i}") for i in (0, 1, 4)])


@query(f"WITH {KEYS}, k AS (SELECT * FROM p), {_attended('q AS (SELECT p.* FROM p, (SELECT label AS l, max(pos) AS last FROM p GROUP BY label) WHERE label IS NOT DISTINCT FROM l AND pos = last)')} SELECT label, pos, {SUMS} FROM m GROUP BY label, pos")
def j17_attention(spark, sf):
    """The last row of each stream over its prefix and ring."""
    rows = _stream(spark, sf)
    queries = attention.drafts(rows, ["label"], 1).withColumnRenamed("e", "q")
    out = attention.attend(queries, _keys(rows, "label", "pos"), ["label"], PREFIX, RING, block=10, scale=SCALE)
    return _shown(out, "label", "pos")


@query(f"WITH {KEYS}, k AS (SELECT * FROM p), {_attended('q AS (SELECT p.* FROM p, (SELECT label AS l, max(pos) AS last FROM p GROUP BY label) WHERE label IS NOT DISTINCT FROM l AND pos > last - 6)')} SELECT label, pos, {SUMS} FROM m GROUP BY label, pos")
def w03_draft_attention(spark, sf):
    """Six draft queries a stream, each with its own causal prefix."""
    rows = _stream(spark, sf)
    queries = attention.drafts(rows, ["label"], 6).withColumnRenamed("e", "q")
    out = attention.attend(queries, _keys(rows, "label", "pos"), ["label"], PREFIX, RING, scale=SCALE)
    return _shown(out, "label", "pos")


HEADS = "k AS (SELECT label, pos, h, e[h * 32 + 1 : h * 32 + 32] AS e FROM p, (SELECT unnest([0, 1]) AS h))"


@query(f"WITH {KEYS}, {HEADS}, {_attended('q AS (SELECT * FROM k)', 'label, h, pos', on=SEEN + ' AND k.h = q.h')} SELECT label, h::INT AS h, pos, {SUMS} FROM m GROUP BY label, h, pos")
def w04_streams_and_heads(spark, sf):
    """Every row as a query, by stream and head; keys of others are never met."""
    heads = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.slice("e", h * 32 + 1, 32).alias("e")) for h in (0, 1)]))
    rows = _stream(spark, sf).select("label", "pos", heads.alias("x")).select("label", "pos", "x.h", "x.e")
    out = attention.attend(rows.withColumnRenamed("e", "q"), _keys(rows, "label", "h", "pos"), ["label", "h"], PREFIX, RING, scale=SCALE)
    return _shown(out, "label", "h", "pos")


@query(f"WITH {KEYS}, k AS (SELECT * FROM p), {_attended('q AS (SELECT * FROM p)')} SELECT label, pos, round(max(top), 6) AS top, round(sum(w), 6) AS total FROM m GROUP BY label, pos")
def a06_two_pass_softmax(spark, sf):
    """Greatest score and sum of exponentials from folds of blocks of seven keys."""
    rows = _stream(spark, sf)
    out = attention.attend(rows.withColumnRenamed("e", "q"), _keys(rows, "label", "pos"), ["label"], PREFIX, RING, block=7, scale=SCALE)
    return out.select("label", "pos", F.round("top", 6).alias("top"), F.round("total", 6).alias("total"))
