from vellumspark.llm import langid


def test_a_language_of_rare_grams_only_is_learned(spark):
    """Over 60,000 n-grams, each of them once."""
    signs = "".join(chr(0x4E00 + k) for k in range(20_000))
    rows = [("rare", signs[i : i + 20]) for i in range(0, 20_000, 20)] + [("rare", signs[i::1000]) for i in range(1000)]
    rows += [("rare", signs[i::997][:20]) for i in range(997)] + [("rare", signs[i::991][:20]) for i in range(991)]
    rows += [("xx", "some plain words")] * 5
    (model,) = langid.train(spark.createDataFrame(rows, "lang string, text string"))
    assert model.langs == ["rare", "xx"]
    assert len(model.grams[-1][0]) > 60_000
