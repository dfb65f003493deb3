"""Checks of references that a comparison rests on, and of typed JSON envelopes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checks import violations

REPLAY = "schema_version int, rng_seed bigint, requires_cuda boolean, expected_prefix_kind string, expected_prefix_chars bigint, expected_prefix_sha256 string, expected_decoded_text_sha256 string"
REFERENCE = f"schema_version int, decoded_text string, decoded_text_sha256 string, deterministic_replay struct<{', '.join(':'.join(c.split()) for c in REPLAY.split(', '))}>, activations map<string,struct<file:string,file_sha256:string>>"
SCHEMA, REPLAY_SCHEMA, PREFIX_KIND = 1, 1, "full_decoded_text"
#: What schema_of_variant says of each kind of field.
KINDS = {"int": "BIGINT", "string": "STRING", "bool": "BOOLEAN", "number": r"BIGINT|DOUBLE|DECIMAL\(.*\)", "ints": "ARRAY<(BIGINT|VOID)>", "numbers": r"ARRAY<(BIGINT|DOUBLE|VOID|DECIMAL\(.*\))>", "object": "OBJECT<.*>"}


def reference(text: Column) -> Column:
    return F.from_json(text, REFERENCE)


def text_violations(r: Column) -> Column:
    """array<string> of what a reference says of its own text: the digest is the text's, and
    absent where the text is; a replay tells the seed, the whole text's length and digest
    again. A text that is no JSON object breaks 'json' alone."""
    text, sha, again = r["decoded_text"], r["decoded_text_sha256"], r["deterministic_replay"]
    own = violations(
        (r["schema_version"] == SCHEMA, "schema"), (F.sha2(text, 256).eqNullSafe(sha), "text digest"), (again.isNotNull(), "no replay"),
        (again.isNull() | (again["schema_version"] == REPLAY_SCHEMA), "replay schema"), (again.isNull() | (again["rng_seed"] >= 0), "seed"),
        (again.isNull() | again["requires_cuda"], "device"), (again.isNull() | (again["expected_prefix_kind"] == PREFIX_KIND), "prefix kind"),
        (again.isNull() | (again["expected_prefix_chars"] == F.char_length(text)), "prefix length"),
        *[(again.isNull() | (again[c] == sha), c) for c in ("expected_prefix_sha256", "expected_decoded_text_sha256")],
    )
    known = F.coalesce(r["schema_version"].isNotNull() | text.isNotNull() | again.isNotNull() | r["activations"].isNotNull(), F.lit(False))
    return F.when(known, own).otherwise(F.array(F.lit("json")))


def reference_faults(refs: DataFrame, key: str, text: str, files: DataFrame) -> DataFrame:
    """(key, rule, detail): faults of references beside stored (path, sha256) files. Files
    are met by a join on their path: missing, another digest, or, with a null key, listed
    by no reference. A path that is stored twice must have the listed digest each time."""
    parsed = refs.select(key, reference(F.col(text)).alias("_r"))
    own = parsed.select(key, F.explode(text_violations(F.col("_r"))).alias("rule"), F.lit(None).cast("string").alias("detail"))
    said = parsed.select(key, F.explode(F.map_entries("_r.activations")).alias("_a")).select(key, F.col("_a.value.file").alias("detail"), F.col("_a.value.file_sha256").alias("_s"))
    stored = files.groupBy(F.col("path").alias("_p")).agg(F.min("sha256").alias("_least"), F.max("sha256").alias("_most"))
    met = said.join(stored, F.col("detail") == F.col("_p"), "left")
    same = F.coalesce((F.col("_s") == F.col("_least")) & (F.col("_s") == F.col("_most")), F.lit(False))
    wrong = met.select(key, F.when(F.col("_p").isNull(), "no file").when(~same, "file digest").alias("rule"), "detail").where("rule IS NOT NULL")
    stray = stored.join(said.select("detail").distinct(), F.col("_p") == F.col("detail"), "left_anti").select(F.lit(None).cast(refs.schema[key].dataType).alias(key), F.lit("not listed").alias("rule"), F.col("_p").alias("detail"))
    return reduce(DataFrame.unionAll, [own, wrong, stray])


def replay_differences(runs: DataFrame, reference_key: str, run: str, digest: str) -> DataFrame:
    """(reference, runs, digests): references whose replays disagree, a null digest being one
    of its own; runs of a reference are counted, not held together."""
    d = F.coalesce(digest, F.lit(""))
    return runs.groupBy(reference_key).agg(F.count_distinct(run).alias("runs"), F.min(d).alias("_a"), F.max(d).alias("_b")).where("_a <> _b").select(reference_key, "runs", F.col("_a").alias("least"), F.col("_b").alias("greatest"))


def envelope_violations(text: Column, fields: dict[str, str]) -> Column:
    """array<string>: fields that lack or have another JSON type than declared; ``kind?``
    may be absent or null. Numbers with a fraction, and truth values, are no ints; what is
    no JSON object breaks 'json' alone. An empty list is of any kind of list."""
    v = F.try_parse_json(text)

    def ok(name: str, kind: str) -> Column:
        got = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
        fits = got.rlike(f"^({KINDS[kind.rstrip('?')]})$")
        return got.isNull() | (got == "VOID") | fits if kind.endswith("?") else fits

    whole = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    return F.when(whole, violations(*[(ok(n, k), n) for n, k in fields.items()])).otherwise(F.array(F.lit("json")))
