"""Queries over embeddings as rows of matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.functions import vectors as V
from vellumspark.operators import routing

from .base import query, read

NEXT = "SELECT a.vec_id, a.embedding::DOUBLE[] AS v, b.embedding::DOUBLE[] AS w FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select("vec_id", "embedding")


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector with the next one by id."""
    a = _vectors(spark, sf)
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("w"))
    return a.join(b, "vec_id").select("vec_id", F.col("embedding").alias("v"), "w")


@query("SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INTEGER AS best FROM embeddings")
def a01_argmax(spark, sf):
    return _vectors(spark, sf).select("vec_id", V.argmax(F.col("embedding")).alias("best"))


@query("""SELECT vec_id, (list_position(x, list_max(x)) - 1)::INTEGER AS best FROM (
    SELECT vec_id, list_transform(embedding, lambda v, i: CASE WHEN (i - 1) % 7 = vec_id % 7 THEN '-infinity'::FLOAT ELSE v END) AS x FROM embeddings)""")
def a01_argmax_with_bans(spark, sf):
    bans = F.filter(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: i % 7 == F.col("vec_id") % 7)
    return _vectors(spark, sf).select("vec_id", V.argmax_except(F.col("embedding"), bans).alias("best"))


@query("""SELECT label, min_by(vec_id, struct_pack(s := -top, v := vec_id)) AS vec_id FROM (SELECT label, vec_id, list_max(embedding) AS top FROM embeddings) GROUP BY label""")
def a02_grouped_argmax(spark, sf):
    rows = read(spark, sf, "embeddings").select("label", "vec_id", F.array_max("embedding").alias("top"))
    return rows.groupBy("label").agg(F.min_by("vec_id", F.struct((-F.col("top")).alias("s"), "vec_id")).alias("vec_id"))


@query("SELECT vec_id, round((list_sort(embedding, 'DESC')[1] - list_sort(embedding, 'DESC')[2])::DOUBLE, 7) AS margin FROM embeddings")
def a03_top_margin(spark, sf):
    return _vectors(spark, sf).select("vec_id", F.round(V.margin(F.col("embedding")), 7).alias("margin"))


@query("""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos, list_max(embedding)::DOUBLE AS m FROM embeddings)
SELECT vec_id, pos::INTEGER AS pos, round(exp(x - m) / sum(exp(x - m)) OVER (PARTITION BY vec_id), 7) AS p FROM e""")
def a05_softmax(spark, sf):
    return _vectors(spark, sf).select("vec_id", F.posexplode(V.softmax(F.col("embedding"))).alias("pos", "p")).withColumn("p", F.round("p", 7))


@query("""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
SELECT vec_id, pos::INTEGER AS pos, round(x / sqrt(avg(x * x) OVER w + 1e-6), 6) AS rms, round((x - avg(x) OVER w) / sqrt(avg(x * x) OVER w - (avg(x) OVER w) ** 2 + 1e-6), 6) AS layer
FROM e WINDOW w AS (PARTITION BY vec_id)""")
def a07_norms(spark, sf):
    both = F.arrays_zip(V.rms_norm(F.col("embedding")).alias("rms"), V.layer_norm(F.col("embedding")).alias("layer"))
    rows = _vectors(spark, sf).select("vec_id", F.posexplode(both).alias("pos", "x"))
    return rows.select("vec_id", "pos", F.round("x.rms", 6).alias("rms"), F.round("x.layer", 6).alias("layer"))


INT8_SQL = """SELECT vec_id, v, CASE WHEN m = 0 THEN 1.0 ELSE (m / 127)::FLOAT::DOUBLE END AS scale FROM (
    SELECT vec_id, embedding::DOUBLE[] AS v, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) AS m FROM embeddings)"""
INT8_Q = "list_transform(v, lambda x: greatest(-127, least(127, round_even((x / scale)::FLOAT::DOUBLE, 0)))::INTEGER)"


@query(f"SELECT vec_id, array_to_string({INT8_Q}, ',') AS q, round(scale, 9) AS scale FROM ({INT8_SQL})")
def a24_int8_rows(spark, sf):
    q = _vectors(spark, sf).select("vec_id", V.int8(F.col("embedding")).alias("q"))
    return q.select("vec_id", F.array_join("q.q", ",").alias("q"), F.round(F.col("q.scale").cast("double"), 9).alias("scale"))


@query(f"""SELECT vec_id, round(list_max(list_transform(list_zip(v, {INT8_Q}), lambda z: abs(z[1] - z[2] * scale))), 7) AS off FROM ({INT8_SQL})""")
def f04_int8_round_trip(spark, sf):
    rows = _vectors(spark, sf).select("vec_id", "embedding", V.int8(F.col("embedding")).alias("q"))
    return rows.select("vec_id", F.round(V.max_abs_diff(F.col("embedding"), V.int8_values(F.col("q"))), 7).alias("off"))


@query(f"""WITH q AS (SELECT vec_id, {INT8_Q} AS q, scale FROM ({INT8_SQL}))
SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.q, b.q), lambda z: (z[1] * z[2])::BIGINT))::DOUBLE * a.scale * b.scale, 7) AS dot
FROM q a JOIN q b ON b.vec_id = a.vec_id + 1""")
def f03_int8_dot(spark, sf):
    return _pairs(spark, sf).select("vec_id", F.round(V.int8_dot(V.int8(F.col("v")), V.int8(F.col("w"))), 7).alias("dot"))


INT4_SQL = """SELECT vec_id, pos, x, CASE WHEN m = 0 THEN 1.0 ELSE m END AS scale FROM (
    SELECT *, (max(abs(x)) OVER (PARTITION BY vec_id, pos // 16) / 7)::FLOAT::DOUBLE AS m FROM (
        SELECT vec_id, unnest(embedding)::DOUBLE AS x, (generate_subscripts(embedding, 1) - 1)::INTEGER AS pos FROM embeddings))"""


@query(f"SELECT vec_id, pos, greatest(-7, least(7, round_even((x / scale)::FLOAT::DOUBLE, 0)))::INTEGER AS q, round(scale, 9) AS scale FROM ({INT4_SQL})")
def a25_int4_groups(spark, sf):
    rows = _vectors(spark, sf).select("vec_id", V.int4(F.col("embedding")).alias("q"))
    q = rows.select("vec_id", "q.scales", F.posexplode("q.q").alias("pos", "q"))
    return q.select("vec_id", "pos", "q", F.round(F.element_at("scales", (F.floor(F.col("pos") / 16) + 1).cast("int")), 9).alias("scale"))


@query(f"""WITH q AS (SELECT vec_id, pos, greatest(-7, least(7, round_even((x / scale)::FLOAT::DOUBLE, 0)))::INTEGER AS q FROM ({INT4_SQL})),
b AS (SELECT vec_id, pos // 2 AS byte, sum(CASE WHEN pos % 2 = 0 THEN q & 15 ELSE (q & 15) * 16 END) AS b FROM q GROUP BY vec_id, pos // 2)
SELECT b.vec_id, string_agg(b.b::VARCHAR, ',' ORDER BY byte) AS packed, true AS same FROM b GROUP BY b.vec_id""")
def f05_nibbles(spark, sf):
    rows = _vectors(spark, sf).select("vec_id", V.int4(F.col("embedding"))["q"].alias("q")).withColumn("b", V.nibbles(F.col("q")))
    return rows.select("vec_id", F.array_join("b", ",").alias("packed"), (V.from_nibbles(F.col("b")) == F.col("q")).alias("same"))


@query("""WITH r AS (SELECT vec_id, embedding::DOUBLE[] AS v, least(0, list_min(embedding))::DOUBLE AS lo, greatest(0, list_max(embedding))::DOUBLE AS hi FROM embeddings),
s AS (SELECT *, CASE WHEN hi = lo THEN 1.0 ELSE ((hi - lo) / 255)::FLOAT::DOUBLE END AS scale FROM r),
z AS (SELECT *, greatest(0, least(255, round_even((-lo / scale)::FLOAT::DOUBLE, 0)))::INTEGER AS zero FROM s)
SELECT vec_id, zero, array_to_string(list_transform(v, lambda x: greatest(0, least(255, round_even((x / scale)::FLOAT::DOUBLE, 0) + zero))::INTEGER), ',') AS q FROM z""")
def a26_uint8_rows(spark, sf):
    rows = _vectors(spark, sf).select("vec_id", V.uint8(F.col("embedding")).alias("q"))
    return rows.select("vec_id", "q.zero", F.array_join("q.q", ",").alias("q"))


@query(f"SELECT vec_id, round(list_dot_product(v, w) / sqrt(list_dot_product(v, v)) / sqrt(list_dot_product(w, w)), 7) AS cosine, round(list_max(list_transform(list_zip(v, w), lambda z: abs(z[1] - z[2]))), 7) AS off FROM ({NEXT})")
def a38_parity(spark, sf):
    return _pairs(spark, sf).select("vec_id", F.round(V.cosine(F.col("v"), F.col("w")), 7).alias("cosine"), F.round(V.max_abs_diff(F.col("v"), F.col("w")), 7).alias("off"))


ERF_SQL = "sign(y) * (1 - (((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t) * exp(-y * y))"


@query(f"""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE * 4 AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
k AS (SELECT *, x / sqrt(2) AS y, 1 / (1 + 0.3275911 * abs(x / sqrt(2))) AS t FROM e)
SELECT vec_id, pos::INTEGER AS pos, round(x / (1 + exp(-x)), 7) AS silu, round(0.5 * x * (1 + {ERF_SQL}), 7) AS gelu, round(x / (1 + exp(-1.702 * x)), 7) AS quick FROM k""")
def f01_activations(spark, sf):
    x = F.col("x")
    rows = _vectors(spark, sf).select("vec_id", F.posexplode(V.doubles(F.col("embedding"))).alias("pos", "x")).withColumn("x", x * 4)
    return rows.select("vec_id", "pos", F.round(V.silu(x), 7).alias("silu"), F.round(V.gelu(x), 7).alias("gelu"), F.round(V.quick_gelu(x), 7).alias("quick"))


@query("""WITH a AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings),
g AS (SELECT * FROM a WHERE vec_id < 64)
SELECT a.vec_id, g.vec_id::INTEGER AS gate, round(sum(a.x * g.x), 7) AS score FROM a JOIN g USING (k) GROUP BY a.vec_id, g.vec_id""")
def f02_matrix_product(spark, sf):
    rows = _vectors(spark, sf)
    scores = routing.scores(rows, "vec_id", routing.gates(rows))
    return scores.select("vec_id", F.posexplode("scores").alias("gate", "score")).withColumn("score", F.round("score", 7))


ROUTES = """WITH a AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings),
s AS (SELECT a.vec_id, g.vec_id AS gate, sum(a.x * g.x) AS s FROM a JOIN a g ON g.k = a.k AND g.vec_id < 64 GROUP BY a.vec_id, g.vec_id),
p AS (SELECT vec_id, gate, exp(s - max(s) OVER w) / sum(exp(s)) OVER w * exp(max(s) OVER w) AS p FROM s WINDOW w AS (PARTITION BY vec_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(p, 12) DESC, gate) AS rank FROM p QUALIFY rank <= 6)"""


@query(f"{ROUTES} SELECT vec_id, rank::INTEGER AS rank, gate::INTEGER AS gate, round(p, 7) AS weight FROM r")
def t01_top6_routing(spark, sf):
    rows = _vectors(spark, sf)
    routed = routing.route(rows, "vec_id", routing.gates(rows))
    each = routed.select("vec_id", F.posexplode("routes").alias("rank", "r"))
    return each.select("vec_id", (F.col("rank") + 1).alias("rank"), F.col("r.index").alias("gate"), F.round("r.score", 7).alias("weight"))


@query(f"""{ROUTES} SELECT a.vec_id, (a.k - 1)::INTEGER AS pos, round(sum(r.p * (r.gate + 1) * a.x) + a.x, 6) AS y FROM r JOIN a USING (vec_id) GROUP BY a.vec_id, a.k, a.x""")
def j05_expert_dispatch(spark, sf):
    """Expert e scales its rows by e + 1; the shared expert passes them on."""
    rows = _vectors(spark, sf)
    out = routing.dispatch(routing.route(rows, "vec_id", routing.gates(rows)), "vec_id", lambda v, e: F.transform(v, lambda x: x * (e + 1)), lambda v: v)
    return out.select("vec_id", F.posexplode("y").alias("pos", "y")).withColumn("y", F.round("y", 6))


@query("""WITH s AS (SELECT a.vec_id, g.vec_id AS gate, list_dot_product(a.embedding::DOUBLE[], g.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings g ON g.vec_id < 64)
SELECT vec_id, min_by(gate, struct_pack(s := -s, g := gate))::INTEGER AS best FROM s GROUP BY vec_id""")
def t02_two_phase_top(spark, sf):
    """int8 scores choose 16 of the 64, which are scored again exactly. The exact best is
    among them, so plain SQL finds the same."""
    rows = _vectors(spark, sf)
    return routing.refined_best(rows, "vec_id", routing.gates(rows), keep=16)


@query("""WITH e AS (SELECT vec_id, (vec_id % 50)::DOUBLE AS p, embedding::DOUBLE[] AS v FROM embeddings),
x AS (SELECT vec_id, p, i, v[i + 1] AS a, CASE WHEN i < 32 THEN -v[i + 33] ELSE v[i - 31] END AS b, p * pow(10000.0, -2.0 * (i % 32) / 64) AS t FROM e, range(64) r(i))
SELECT vec_id, i::INTEGER AS pos, round(a * cos(t) + b * sin(t), 6) AS y FROM x""")
def w07_rotary(spark, sf):
    turned = V.rotate(F.col("embedding"), (F.col("vec_id") % 50).cast("double"))
    return _vectors(spark, sf).select("vec_id", F.posexplode(turned).alias("pos", "y")).withColumn("y", F.round("y", 6))


@query("""SELECT a.vec_id, (i - 1)::INTEGER AS pos, CASE WHEN i <= 64 THEN a.embedding[i] ELSE b.embedding[i - 64] END::DOUBLE AS x
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1, range(1, 129) r(i)""")
def t13_concat_rows(spark, sf):
    return _pairs(spark, sf).select("vec_id", F.posexplode(F.concat("v", "w")).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))


@query(f"SELECT vec_id, (i - 1)::INTEGER AS pos, round(v[i] + w[i], 6) AS y FROM ({NEXT}), range(1, 65) r(i)")
def f18_residual(spark, sf):
    both = F.zip_with(V.doubles(F.col("v")), V.doubles(F.col("w")), lambda x, y: x + y)
    return _pairs(spark, sf).select("vec_id", F.posexplode(both).alias("pos", "y")).withColumn("y", F.round("y", 6))


@query("SELECT label, sum(len(embedding) * 4)::BIGINT AS bytes FROM embeddings GROUP BY label")
def t15_bytes_held(spark, sf):
    return read(spark, sf, "embeddings").groupBy("label").agg(F.sum(F.size("embedding") * 4).cast("long").alias("bytes"))
