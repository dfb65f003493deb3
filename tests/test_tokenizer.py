"""The whole tokenizer beside the public library's, built from the same file and stages."""

import time

import public_tokenizers
import pytest
from tokenizers import AddedToken, Regex, Tokenizer, decoders, pre_tokenizers

from vellumspark.functions import bpe, tokenizer
from vellumspark.functions.merging import merge_linked
from vellumspark.functions.text import GPT_WORD

PATH = public_tokenizers.path("byte_bpe_50k.json")
MORE = (("<|a|>", 60000, True), ("<|a|>b", 60001, False))
ODD = ["", " ", "a  b\n\n c", "1234567 ٣٤٥٦", "漢字かなカナabc漢", "don't I'll", "\u00a0x\u2003y", "e\u0301 👩‍👩‍👧 ", "\x00\x7f\x80", "<|endoftext|> in text", "  \r\n\t end  "]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.pre_tokenizer = pre_tokenizers.Sequence(
        [
            pre_tokenizers.Split(Regex("\\p{N}{1,3}"), "isolated"),
            pre_tokenizers.Split(Regex("[一-龥぀-ゟ゠-ヿ]+"), "isolated"),
            pre_tokenizers.Split(Regex(GPT_WORD), "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ]
    )
    t.decoder = decoders.ByteLevel()
    return t


def test_ids_are_the_librarys(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = dict(map(tuple, docs.collect())) | {-1 - k: t for k, t in enumerate(ODD)} | {-99: None}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in tokenizer.encode(rows, PATH, ["doc_id"]).collect()}
    assert got.pop(-99) is None
    for k, ids in got.items():
        assert ids == library.encode(texts[k], add_special_tokens=False).ids, texts[k][:80]
    back = {r.doc_id: r.text for r in tokenizer.decode(tokenizer.encode(rows, PATH, ["doc_id"]), PATH, ["doc_id"]).collect()}
    assert back == texts


def test_added_and_special_tokens(spark):
    rows = spark.createDataFrame([(1, "x<|a|>b<|a|>y<|endoftext|>")], "k int, text string")
    ids = tokenizer.encode(rows, PATH, ["k"], more=MORE)
    own = tokenizer.vocabulary(PATH, MORE)
    assert ids.first().ids == [own.ids["x"], 60001, 60000, own.ids["y"], 50256]
    assert tokenizer.decode(ids, PATH, ["k"], more=MORE).first().text == "x<|a|>b<|a|>y<|endoftext|>"
    assert tokenizer.decode(ids, PATH, ["k"], skip_special=True, more=MORE).first().text == "x<|a|>by"
    assert (own.token_to_id("<|a|>"), own.token_to_id("the"), own.token_to_id("no such token")) == (60000, own.ids["the"], None)


@pytest.mark.parametrize("ids, error", [([70000], "unknown token id 70000"), ([-5], "unknown token id -5"), (None, "utf-8")])
def test_decoding_is_strict(spark, ids, error):
    own = tokenizer.vocabulary(PATH)
    half = [own.ids["Ã"]]
    with pytest.raises(Exception, match=error):
        tokenizer.decode(spark.createDataFrame([(1, ids or half)], "k int, ids array<int>"), PATH, ["k"]).collect()


def test_merging_takes_the_leftmost_of_least_rank():
    ranks = {("a", "a"): 0, ("aa", "a"): 1, ("b", "aa"): 2, ("aa", "aa"): 3}
    rank = lambda a, b: ranks.get((a, b))
    assert merge_linked(list("aaa"), rank) == ["aaa"] and merge_linked(list("baaaa"), rank) == ["baa", "aa"]
    assert merge_linked([], rank) == [] and merge_linked(["z"], rank) == ["z"]


def test_a_word_of_a_million_bytes():
    start = time.time()
    word = "anotherword" * 91_000
    ids = tokenizer.vocabulary(PATH).piece_ids(word)
    assert "".join(t for i in ids for t in [tokenizer.vocabulary(PATH).contents[i].decode()]) == word
    known = bpe.ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert b"".join(bpe.merge(word.encode(), known)) == word.encode()
    assert time.time() - start < 60


def test_a_batch_is_worked_through_in_small_parts():
    import pyarrow as pa

    from vellumspark.functions.batches import TOGETHER, by_rows

    texts = ["x" * 1000, None, "y" * 5_000_000, *["z" * 2000] * 6000]
    read = []
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["k", "t"])
    parts = by_rows(iter([batch]), ["k"], "n", pa.int64(), lambda t: read.append(t) or len(t))
    first = next(parts)
    assert first.num_rows == len(read) + 1 < 1000  # one null
    rest = [first, *parts]
    assert sum((p.column("n").to_pylist() for p in rest), []) == [None if t is None else len(t) for t in texts]
    assert len(rest) >= sum(map(len, filter(None, texts))) // TOGETHER


@pytest.mark.parametrize("name, cuts", [("u02_skip_special", 1), ("x17_added_tokens", 0), ("x10_pieces", 1)])
def test_a_text_is_cut_once(spark, name, cuts):
    from vellumspark.plans import registry

    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(lambda") + plan.count("regexp_extract_all(text") <= 2 * cuts and "Join" not in plan
    assert plan.count("Relation [") == 1
