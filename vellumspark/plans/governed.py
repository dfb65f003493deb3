"""Queries of provenance, envelopes, feasible tasks and allocation ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumspark.operators import policy, provenance
from vellumspark.sources import documents

from .base import query, read

REFS = "d AS (SELECT doc_id AS i, text, length(text) AS n FROM documents WHERE doc_id IS NOT NULL)"


def _references(docs):
    """Documents as references; faults by doc_id."""
    i, text = F.col("doc_id"), F.col("text")
    sha = F.sha2(F.when(i % 13 == 1, F.concat(text, F.lit("x"))).otherwise(text), 256)
    again = F.struct(
        F.lit(1).alias("schema_version"), F.when(i % 11 == 2, -1).otherwise(i).alias("rng_seed"), (i % 17 != 3).alias("requires_cuda"), F.lit(provenance.PREFIX_KIND).alias("expected_prefix_kind"),
        (F.char_length("text") - (i % 19 == 4).cast("int")).alias("expected_prefix_chars"), sha.alias("expected_prefix_sha256"), F.when(i % 23 != 5, sha).alias("expected_decoded_text_sha256"),
    )
    stored = F.create_map(F.lit("stage"), F.struct(F.concat(i, F.lit(".npy")).alias("file"), F.md5(i.cast("string")).alias("file_sha256")))
    made = F.struct(F.when(i % 29 == 6, 2).otherwise(1).alias("schema_version"), text.alias("decoded_text"), sha.alias("decoded_text_sha256"), F.when(i % 31 != 7, again).alias("deterministic_replay"), stored.alias("activations"))
    return docs.select("doc_id", F.to_json(made).alias("json"))


@query(f"""WITH {REFS}, r AS (SELECT * FROM d WHERE i % 31 <> 7)
SELECT i AS doc_id, 'schema' AS rule, NULL::VARCHAR AS detail FROM d WHERE i % 29 = 6 UNION ALL SELECT i, 'text digest', NULL FROM d WHERE i % 13 = 1 AND text IS NOT NULL UNION ALL SELECT i, 'no replay', NULL FROM d WHERE i % 31 = 7
UNION ALL SELECT i, 'seed', NULL FROM r WHERE i % 11 = 2 UNION ALL SELECT i, 'device', NULL FROM r WHERE i % 17 = 3 UNION ALL SELECT i, 'prefix length', NULL FROM r WHERE i % 19 = 4 OR n IS NULL
UNION ALL SELECT i, 'expected_prefix_sha256', NULL FROM r WHERE n IS NULL UNION ALL SELECT i, 'expected_decoded_text_sha256', NULL FROM r WHERE i % 23 = 5 OR n IS NULL
UNION ALL SELECT i, 'no file', i || '.npy' FROM d WHERE i % 7 = 0 UNION ALL SELECT i, 'file digest', i || '.npy' FROM d WHERE i % 7 = 1 UNION ALL SELECT NULL, 'not listed', '_' || i || '.npy' FROM d WHERE i % 7 = 0""")
def p17_provenance(spark, sf):
    """Files of every seventh document lie under another name, of the next one they differ."""
    docs = read(spark, sf, "documents").where("doc_id IS NOT NULL")
    i = F.col("doc_id")
    files = docs.select(F.concat(F.when(i % 7 == 0, "_").otherwise(""), i, F.lit(".npy")).alias("path"), F.md5(F.concat(i, F.when(i % 7 == 1, "x").otherwise(""))).alias("sha256"))
    return provenance.reference_faults(_references(docs), "doc_id", "json", files)


@query("""SELECT user_id, count(DISTINCT event_id) AS runs, min(event_type) AS least, max(event_type) AS greatest FROM events GROUP BY user_id HAVING min(event_type) <> max(event_type)""")
def p17_replays(spark, sf):
    """Users as references, events as replays of them."""
    return provenance.replay_differences(read(spark, sf, "events"), "user_id", "event_id", "event_type")


@query("""SELECT event_id, array_to_string(CASE WHEN event_id % 9 = 8 THEN ['json'] ELSE list_filter([CASE WHEN event_id % 4 = 1 THEN 'id' END, CASE WHEN event_id % 5 IN (1, 2) THEN 'values' END, CASE WHEN event_id % 3 = 1 THEN 'note' END, CASE WHEN event_id % 6 = 5 THEN 'strict' END], lambda x: x IS NOT NULL) END, ',') AS wrong FROM events""")
def p18_envelopes(spark, sf):
    """Events as requests: ids that are fractions, lists with texts or no lists at all, notes
    that are numbers, truth values in quotes, and texts cut short."""
    i = F.col("event_id")
    text = F.concat(
        F.lit('{"id": '), i, F.when(i % 4 == 1, ".5").otherwise(""), F.lit(', "values": '), F.when(i % 5 == 0, "[]").when(i % 5 == 1, '[1, "2"]').when(i % 5 == 2, "3").otherwise("[1, 2.5, -3e2]"),
        F.when(i % 3 == 0, "").when(i % 3 == 1, ', "note": 7').otherwise(', "note": null'), F.lit(', "strict": '), F.when(i % 6 == 5, '"true"').otherwise("true"), F.when(i % 9 == 8, "").otherwise("}"),
    )
    wrong = provenance.envelope_violations(text, {"id": "int", "values": "numbers", "note": "string?", "strict": "bool"})
    return read(spark, sf, "events").select("event_id", F.array_join(wrong, ",").alias("wrong"))


MODELS = "m AS (SELECT r_regionkey AS k, lower(r_name) AS mark FROM region)"
SPEC = "CASE c_custkey % 3 WHEN 1 THEN 'models/' || (SELECT upper(mark) FROM m WHERE k = c_custkey % 5) || '-x.bin' WHEN 2 THEN 'asia/plain.bin' END"


def _models(spark, sf):
    return read(spark, sf, "region").select(F.lower("r_name").alias("model"), F.col("r_name").alias("mark"), (F.col("r_regionkey") == 0).alias("preset"), F.col("r_regionkey").alias("size"))


def _requests(spark, sf):
    k = F.col("c_custkey")
    named = read(spark, sf, "region").select((F.col("r_regionkey")).alias("_k"), F.upper("r_name").alias("_n"))
    rows = read(spark, sf, "customer").join(F.broadcast(named), k % 5 == F.col("_k"), "left")
    return rows.select("c_custkey", F.col("c_nationkey").alias("task"), F.when(k % 3 == 1, F.concat(F.lit("models/"), "_n", F.lit("-x.bin"))).when(k % 3 == 2, "asia/plain.bin").alias("spec"), F.when(k % 3 == 1, F.lower("_n")).when(k % 3 == 2, "none").alias("model"))


@query(f"""WITH {MODELS}, q AS (SELECT c_custkey, c_nationkey, n_regionkey AS r, c_custkey % 3 AS s, c_custkey % 5 AS named FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey)
SELECT c_custkey, CASE WHEN r IS NULL THEN 'unknown task' WHEN c_nationkey % 10 = 9 THEN 'not implemented' WHEN c_nationkey % 4 <> 3 AND r <> 0 AND (s = 0 OR s = 1 AND named = 0) THEN 'needs ' || (SELECT mark FROM m WHERE k = r) ELSE 'ok' END AS verdict FROM q""")
def p09_feasible(spark, sf):
    """Nations as tasks that need their region's model, every fourth none."""
    models = _models(spark, sf)
    tasks = read(spark, sf, "nation").join(F.broadcast(models), F.col("n_regionkey") == F.col("size")).select(F.col("n_nationkey").alias("task"), F.when(F.col("n_nationkey") % 4 != 3, F.col("model")).alias("needs"), (F.col("n_nationkey") % 10 == 9).alias("planned"))
    return policy.feasible(_requests(spark, sf), tasks, models).select("c_custkey", "verdict")


@query(f"""WITH {MODELS} SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN (SELECT mark FROM m WHERE k = 0) WHEN 1 THEN (SELECT mark FROM m WHERE k = c_custkey % 5) END AS model, CASE c_custkey % 3 WHEN 0 THEN 0 WHEN 1 THEN c_custkey % 5 END AS size FROM customer""")
def s27_architectures(spark, sf):
    """Named, preset and unknown models of customers."""
    got = policy.architecture(_requests(spark, sf).select("c_custkey", "model"), _models(spark, sf))
    return got.select("c_custkey", "found.model", "found.size")


@query("""WITH p AS (SELECT p_brand, p_partkey, p_size / 7 AS r, p_retailprice / 3000 AS d FROM part), t AS (SELECT p_brand, round(sum(d), 6) AS total, sum(r) <= 1000 AS within, count(*) AS n FROM p GROUP BY p_brand)
SELECT p_brand, p_partkey::VARCHAR AS tensor, round(r, 4) AS bits, round(d, 9) AS distortion, format('{:.6e}', d / r)::DOUBLE AS marginal, total, within, n::INT AS n FROM p JOIN t USING (p_brand)""")
def k11_allocation_ledger(spark, sf):
    """Parts as tensors of their brands' allocations, read back from the ledgers."""
    size, price = F.col("p_size") / 7, F.col("p_retailprice").cast("double") / 3000
    rows = read(spark, sf, "part").select("p_brand", F.col("p_partkey").cast("string").alias("tensor"), size.alias("rate"), price.alias("distortion"), (price / size).alias("marginal"), F.lit("flat").alias("reason"))
    made = documents.allocation_json(rows, "p_brand", 1000)
    back = made.select("p_brand", F.from_json("json", "n_tensors int, totals struct<distortion:double,within:boolean>, allocation array<struct<bits:double,distortion:double,marginal:double,tensor:string>>").alias("j"))
    return back.select("p_brand", F.col("j.n_tensors").alias("n"), F.col("j.totals.distortion").alias("total"), "j.totals.within", F.inline("j.allocation"))
