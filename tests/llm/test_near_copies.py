import numpy as np
import pytest
from tests_llm_brute import near, shingled, simhash_of

import corpus_pipeline
from vellumspark.llm import near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def similar(a, b):
    a, b = shingled(a), shingled(b)
    return 5 * len(a & b) >= 4 * len(a | b)


def edited(rng, words, most):
    copy = list(words)
    for k in rng.integers(0, len(words), rng.integers(1, most)):
        copy[k] = f"new{rng.integers(1e9)}"
    return " ".join(copy)


@pytest.mark.parametrize("often", [2, 8])
def test_the_stage_drops_all_of_similarity_four_fifths(spark, monkeypatch, often):
    monkeypatch.setattr(near_copies, "OFTEN", often)
    monkeypatch.setattr(near_copies, "SAMPLE", 2)
    rng = np.random.default_rng(4)
    texts, common = {}, [f"all{k}" for k in range(30)]
    for i in range(40):
        words = [f"w{k}" for k in rng.integers(0, 5000, rng.integers(20, 250))] + (common if i % 2 else [])
        texts[i] = " ".join(words)
        for j in range(1, 5):
            texts[i + 100 * j] = edited(rng, words, 2 + len(words) // 25)
    texts |= {1000: "a b", 1001: "A  b", 1002: "a b c", 1003: "", 1004: None, 1005: " \n"}
    bits = lambda a, b: bin(simhash_of(texts[a]) ^ simhash_of(texts[b])).count("1")
    assert sum(similar(texts[i], texts[i + 100]) and bits(i, i + 100) > 4 for i in range(40)) > 5
    want = {d for d, first in near(texts).items() if d == first}
    docs = spark.createDataFrame([(d, t, None, "x", 1) for d, t in texts.items()], SCHEMA)
    out = dict(corpus_pipeline.STAGES)["near duplicates"](spark, docs, "")
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == sorted(want)
    assert 45 < len(want) < 150


def test_nothing_to_compare(spark):
    assert near_copies.keep_one(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("cell", [3, 384])
def test_a_large_group_is_compared_by_cells(spark, monkeypatch, cell):
    monkeypatch.setattr(near_copies, "CELL_TEXTS", cell)
    monkeypatch.setattr(near_copies, "BROADCAST_ROLES", -1 if cell == 3 else 1000)
    monkeypatch.setattr(near_copies, "COLUMNS", 64)
    rng = np.random.default_rng(7)
    base = [f"w{k}" for k in rng.integers(0, 5000, 160)]
    texts = {i: edited(rng, base, 6) if i % 3 else edited(rng, base[: rng.integers(110, 160)], 3) for i in range(70)}
    texts |= {100 + i: texts[i] for i in range(10)}
    docs = spark.createDataFrame([(d, t, None, "x", 1) for d, t in texts.items()], SCHEMA)
    want = {d for d, first in near(texts).items() if d == first}
    assert {r.doc_id for r in near_copies.keep_one(docs).collect()} == want and 1 < len(want) < 60
