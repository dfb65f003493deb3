import hashlib
import json

import pytest
from pyspark.sql import functions as F

from vellumspark.operators import policy, provenance
from vellumspark.sources import documents


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def made(text, **changes):
    again = {"schema_version": 1, "rng_seed": 0, "requires_cuda": True, "expected_prefix_kind": "full_decoded_text", "expected_prefix_chars": len(text), "expected_prefix_sha256": sha(text), "expected_decoded_text_sha256": sha(text)}
    again |= {k: v for k, v in changes.items() if k in again}
    own = {"schema_version": 1, "decoded_text": text, "decoded_text_sha256": sha(text), "deterministic_replay": again, "activations": {"s": {"file": "a.npy", "file_sha256": "1"}}}
    return json.dumps(own | {k: v for k, v in changes.items() if k not in again})


def test_reference_rules(spark):
    rows = {
        "ok": made("Ωé"), "kind": made("a", expected_prefix_kind="x"), "seed": made("a", rng_seed=1.5), "none": made("a", deterministic_replay=None), "gone": made("a", activations={"s": {"file": "b.npy"}}),
        "other": made("a", activations={"s": {"file": "a.npy", "file_sha256": "2"}}), "text": made("a", decoded_text_sha256=None), "json": "[", "null": None,
    }
    refs = spark.createDataFrame(list(rows.items()), "k string, text string")
    files = spark.createDataFrame([("a.npy", "1"), ("c.npy", "3"), ("c.npy", "3")], "path string, sha256 string")
    got = {tuple(r) for r in provenance.reference_faults(refs, "k", "text", files).collect()}
    assert got == {
        ("kind", "prefix kind", None), ("seed", "seed", None), ("none", "no replay", None), ("gone", "no file", "b.npy"), ("other", "file digest", "a.npy"), (None, "not listed", "c.npy"),
        ("text", "text digest", None), ("text", "expected_prefix_sha256", None), ("text", "expected_decoded_text_sha256", None), ("json", "json", None), ("null", "json", None),
    }


def test_envelope_kinds(spark):
    fields = {"a": "int", "b": "numbers", "c": "string?", "d": "bool", "e": "ints", "f": "object"}
    texts = ['{"a":1,"b":[],"d":true,"e":[1],"f":{}}', '{"a":1.0,"b":[1,"x"],"c":2,"d":0,"e":[1.5],"f":[]}', '{"a":true,"b":[1,2.5],"c":null,"d":null,"e":[]}', "[1]", "{", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", provenance.envelope_violations(F.col("t"), fields).alias("w")).orderBy("i").collect()
    assert [r.w for r in rows] == [[], list("abcdef"), ["a", "d", "f"], ["json"], ["json"], ["json"]]


def test_feasible_and_architecture(spark):
    models = spark.createDataFrame([("plain", "Plain", True), ("rich", "Rich", None)], "model string, mark string, preset boolean")
    tasks = spark.createDataFrame([("read", None, False), ("draw", "rich", False), ("say", None, True)], "task string, needs string, planned boolean")
    asked = [("draw", None), ("draw", "x/PLAIN.bin"), ("draw", "x/rich-plain.bin"), ("draw", "plain/y.bin"), ("read", "plain"), ("say", "rich"), ("fly", None), (None, None)]
    got = policy.feasible(spark.createDataFrame(asked, "task string, spec string"), tasks, models).collect()
    want = ["needs rich", "needs rich", "ok", "ok", "ok", "not implemented", "unknown task", "unknown task"]
    assert {(r.task, r.spec): r.verdict for r in got} == dict(zip(asked, want, strict=True))
    found = policy.architecture(spark.createDataFrame([(None,), ("rich",), ("x",)], "model string"), models).collect()
    assert {r.model: r.found and r.found.model for r in found} == {None: "plain", "rich": "rich", "x": None}
    with pytest.raises(ValueError, match="instead of one"):
        policy.architecture(models, models.where("model = 'rich'"))


def test_allocation_json(spark):
    rows = [("k", "b", 1.23456, 0.12345678949, 1.23456789e-5, "r"), ("k", "a", 2.0, float("nan"), 0.0, 'say "x"')]
    df = spark.createDataFrame(rows, "k string, tensor string, rate double, distortion double, marginal double, reason string")
    got = json.loads(documents.allocation_json(df, "k", 3).first()["json"])
    assert got["allocation"] == [{"bits": 2.0, "distortion": None, "marginal": 0.0, "reason": 'say "x"', "tensor": "a"}, {"bits": 1.2346, "distortion": 0.123456789, "marginal": 1.234568e-05, "reason": "r", "tensor": "b"}]
    assert got["totals"] == {"distortion": None, "bits": 3.2346, "within": False} and got["n_tensors"] == 2
    assert documents.allocation_json(df.where("false"), "k", 3).count() == 0
