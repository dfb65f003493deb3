import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_copies_of_a_text_are_no_boilerplate(spark):
    rows = [(i, f"own {i}\nmenu" if i % 3 == 0 else f"own {i}", "en", "big", 5) for i in range(120)]
    rows += [(1000 + i, "a clean text\nsaid once", "en", "big", 5) for i in range(60)]
    rows += [(2000 + i, "another one", "en", "small", 5) for i in range(8)]
    rows += [(3000 + i, f"{i}\nsite line", "en", None, 5) for i in range(9)] + [(4000, None, "en", None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = corpus_pipeline.cut_boilerplate(spark, docs, "")
    got = {r.doc_id: r.text for r in out.collect()}
    want = {r[0]: r[1] and r[1].replace("\nmenu", "").replace("\nsite line", "") for r in rows}
    assert out.columns == docs.columns and got == want
