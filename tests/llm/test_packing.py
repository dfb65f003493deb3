import json
import random
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vellumspark.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "DOC_TOKENS int, doc_id long, text string, ids string"


def check(rows, window, want):
    """want: list of (doc_id, ids), one for each document row."""
    seqs, docs = defaultdict(list), defaultdict(list)
    for doc, start, length, total, seq, off, ids in rows:
        ids = np.frombuffer(ids, "<u4") if isinstance(ids, (bytes, bytearray)) else ids
        assert len(ids) == length > 0
        seqs[seq].append((off, length))
        docs[doc].append((start, total, ids.tolist()))
    for parts in seqs.values():
        at = 0
        for off, length in sorted(parts):
            assert off == at
            at += length
        assert at <= window
    assert set(docs) == {d for d, _ in want}
    for doc, ids in want:
        if sum(d == doc for d, _ in want) == 1:
            parts = sorted(docs[doc])
            assert sum((p[2] for p in parts), []) == ids and {p[1] for p in parts} == {len(ids)}
    return [sum(n for _, n in p) for p in seqs.values()]


def test_words_give_the_tokenizers_ids():
    known, tok = packing.WordIds(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(1)
    alphabet = "aB'sé  \t\ń  İΣςƉ中日.,-!?9½<|>\x1c\x85" + "x"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += ["it's <|endoftext|> don't", "a<|startoftext|>b", "", "e ́", "w" * 5000]
    for t in texts:
        assert known.ids(t.encode()).tolist() == [*tok.encode(t, add_special_tokens=False).ids, 1], t
    assert known.ids(None).tolist() == [1]


def test_many_words_at_once_give_the_tokenizers_ids():
    known, tok = packing.WordIds(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(3)
    alphabet = "aBeRvSstTmMlLdDzÀÞßÿ×÷é09''''-.,!<|>\x7f́中"
    words = {"".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 9))) for _ in range(30_000)}
    words |= {"it's", "'tis", "L'été", "IT'LL", "a'", "'", "''s", "x'rex", "9's", "--'ve", "n" * 64, "n" * 65}
    got = dict(known.encoded([w.encode() for w in words]))
    assert len(got) == len(words)
    want = tok.encode_batch(sorted(words), add_special_tokens=False)
    assert all(np.frombuffer(got[w.encode()], "<u4").tolist() == e.ids for w, e in zip(sorted(words), want, strict=True))


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    known, tok = packing.WordIds(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(5)
    for _ in range(40):
        texts = [" ".join(f"w{rng.randrange(200)}" for _ in range(rng.randrange(60))) for _ in range(5)]
        got = known.many([t.encode() for t in texts])
        assert [g.tolist() for g in got] == [[*tok.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_other_tokenizers_take_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    known, tok = packing.WordIds(path), Tokenizer.from_file(path)
    assert not known.by_word
    for t in ("Hello World it's", "  two  spaces\n", "", "É <|endoftext|>x", "a\x85b"):
        assert known.ids(t.encode()).tolist() == [*tok.encode(t, add_special_tokens=False).ids, 1]


def test_rules_under_which_ids_could_differ_are_refused():
    rules = json.loads(Path(PATH).read_text(encoding="utf-8"))
    assert packing.piece_ranks(rules)
    first, *_, last = rules["model"]["merges"]
    rules["model"]["merges"][0], rules["model"]["merges"][-1] = last, first
    assert packing.piece_ranks(rules) is None
    rules["normalizer"] = None
    assert packing.piece_ranks(rules) is None


@pytest.mark.parametrize("window", [8, 2048])
def test_stream(window):
    rng = np.random.default_rng(2)
    docs = [(i, np.arange(int(n), dtype="<u4")) for i, n in enumerate(rng.integers(1, 3 * window, 700))]
    fills = check(packing.pack_stream(iter(docs), window), window, [(d, x.tolist()) for d, x in docs])
    assert sum(f < window for f in fills) <= 1


def test_rule_is_the_smallest_sum_of_squares():
    rng = np.random.default_rng(4)
    rule, w = packing.SumOfSquares(32), 32
    for k in range(600):
        size = int(rng.integers(1, w))
        n = rule.levels

        def after(h):
            m = n.copy()
            m[h] -= h > 0
            m[h + size] += 1
            return int((m[1:w] ** 2).sum())

        options = {h: after(h) for h in range(w - size + 1) if h == 0 or n[h]}
        at = rule.place(size)
        assert options[at] == min(options.values())
        rule.put(size, k)


def test_spark(spark):
    texts = [None, "", " \n", "one two", "word " * 30_000, "it's", "it's"]
    rows = [(1, i, t, "x") for i, t in enumerate(texts)] + [(1, None, "none", "x"), (1, 5, "it's", "x")]
    out = packing.pack(spark.createDataFrame(rows, SCHEMA), PATH)
    tok = Tokenizer.from_file(PATH)
    want = [(i, [*tok.encode(t or "", add_special_tokens=False).ids, 1]) for _, i, t, _ in rows]
    got = [tuple(r) for r in out.collect()]
    check(got, 2048, want)
    digest = {(r.doc_id, r.start): r.ids_crc32 for r in packing.digests(out).collect()}
    assert all(digest[r[0], r[1]] == zlib.crc32(bytes(r[6])) for r in got if r[0] != 5)
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_padding():
    assert [packing.padding(n) for n in (1, 2, 3, 1024, 1025, 2048)] == [0, 0, 2045, 0, 1023, 0]
