import random
import zlib
from collections import Counter, defaultdict

import numpy as np

import pytest

from vellumspark.llm import langid

SCHEMA = "lang string, doc_id long, text string, held_out string"


def slow(counts, text):
    """Bits of each character of a padded word by the recursion itself."""
    levels, now = [], dict(counts)
    for _ in range(4):
        levels.insert(0, now)
        below = Counter()
        for g in now:
            below[g[1:]] += 1
        now = below
    return levels


def probability(levels, gram, uniform):
    if not gram:
        return uniform
    now = levels[len(gram) - 1]
    ones, twos = sum(n == 1 for n in now.values()), sum(n == 2 for n in now.values())
    discount = min(0.9, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5
    same = [n for g, n in now.items() if g[:-1] == gram[:-1]]
    lower = probability(levels, gram[1:], uniform)
    if not same:
        return lower
    return max(0, now.get(gram, 0) - (discount if gram in now else 0)) / sum(same) + discount * len(same) / sum(same) * lower


def test_bits_follow_the_recursion(spark):
    rng = random.Random(3)
    counts = {lang: Counter() for lang in ("aa", "bb")}
    for lang, letters in (("aa", "abcd"), ("bb", "cdeé")):
        for _ in range(60):
            word = "   " + "".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) + " "
            for i in range(len(word) - 3):
                counts[lang][word[i : i + 4]] += rng.randrange(1, 4)
    rows = spark.createDataFrame([(lang, g, n) for lang, by in counts.items() for g, n in by.items()], "lang string, gram string, n long")
    model = langid.assembled(["aa", "bb"], *langid.probabilities(rows))
    uniform = 1 / (len({c for by in counts.values() for g in by for c in g}) + 1)
    for chunk in ("abc", "dcé", "zz", "abéza", "a"):
        row = model.words([chunk.encode()])[0]
        for k, lang in enumerate(model.langs):
            levels = slow(counts[lang], chunk)
            padded = "   " + chunk + " "
            want = -sum(np.log2(probability(levels, padded[i : i + 4], uniform)) for i in range(len(chunk) + 1))
            assert abs(row[k] - want) < 1e-9, (chunk, lang)
        assert row[-1] == len(chunk) + 1
    assert np.allclose(model.words([b"abc", b"1,2", b"x-abc"])[2], model.words([b"x"])[0] + model.words([b"abc"])[0])


def words(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(n))


def test_accuracy_and_odd_rows(spark):
    rng = random.Random(8)
    letters = {"xx": "aeioulmn", "yy": "eiukrtsö", "zz": "aoszćłwk"}
    rows = [(lang, k, words(rng, letters[lang], 40), "h") for k, lang in enumerate(["xx", "yy", "zz"] * 60)]
    odd = [(None, 900, words(rng, letters["yy"], 60_000), "h"), ("xx", 901, None, "h"), ("xx", 902, "", "h"), ("yy", 903, "12 !? 9", "h"), ("zz", None, words(rng, letters["zz"], 30), "h"), (None, 904, "QQQ" * 500, "h"), (None, 904, "QQQ" * 500, "h")]
    got = defaultdict(list)
    for r in langid.identify(spark.createDataFrame(rows + odd, SCHEMA)).collect():
        got[r.doc_id].append(r)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    assert sum(map(len, got.values())) == len(rows) + len(odd)
    tested = [r for r in rows if got[r[1]][0].held_out]
    assert len(tested) > 20 and sum(got[r[1]][0].lang_pred == r[0] for r in tested) >= 0.97 * len(tested)
    assert [got[i][0].lang_pred for i in (900, 901, 902, 903, None)] == ["yy", "und", "und", "und", "zz"]
    assert got[901][0].score == 0 and len(got[904]) == 2 and got[904][0].lang_pred != "und"


def bits_of(text, levels, uniform, memory):
    """Bits of all letters of a text and word ends, and how many, by the recursion."""
    total = n = 0
    for chunk in text.encode().split():
        for run in langid.pieces(chunk.decode()):
            padded = "   " + run + " "
            for i in range(len(run) + 1):
                g = padded[i : i + 4]
                if g not in memory:
                    memory[g] = -np.log2(probability(levels, g, uniform))
                total, n = total + memory[g], n + 1
    return total, n


@pytest.mark.parametrize("cells", [langid.CELLS, 1])
def test_the_whole_query_by_the_recursion(spark, monkeypatch, cells):
    """Choices and cross-entropies of plain recursions over counts of plain loops."""
    monkeypatch.setattr(langid.train, "__defaults__", (cells,))
    rng = random.Random(11)
    letters = {"xx": "aeilmn", "yy": "eikrtsö", "zz": "aoszćł"}
    rows = [(lang, k, words(rng, letters[lang], 12), "h") for k, lang in enumerate(["xx", "yy", "zz"] * 20)]
    rows += [("xx", 100, "漢字" * 200 + " " + words(rng, "aeil", 5), "h"), (None, 101, "", "h"), ("yy", 102, "字漢" * 90, "h")]
    counts = {lang: Counter() for lang in letters}
    for lang, k, text, _ in rows:
        if lang and zlib.crc32(str(k).encode()) % 4 != 2:
            for run in langid.pieces(text):
                padded = "   " + run + " "
                counts[lang].update(padded[i : i + 4] for i in range(len(run) + 1))
    uniform = 1 / (len({c for by in counts.values() for g in by for c in g}) + 1)
    levels = {lang: slow(by, "") for lang, by in counts.items()}
    memory = {lang: {} for lang in counts}
    docs = spark.createDataFrame(rows, SCHEMA)
    models = langid.train(docs.where(~langid.held_out(docs["doc_id"])))
    assert [m.langs for m in models] == ([["xx"], ["yy"], ["zz"]] if cells == 1 else [["xx", "yy", "zz"]])
    found = {r.doc_id: r for r in langid.entropies(docs, models).collect()}
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs).collect()}
    for _, k, text, _ in rows:
        want = sorted((bits_of(text, levels[lang], uniform, memory[lang])[0], lang) for lang in counts)
        n = bits_of(text, levels["xx"], uniform, memory["xx"])[1]
        if not n:
            assert found[k].pred is None and got[k] == "und"
            continue
        assert found[k].pred == got[k] == want[0][1] and found[k].chars == n
        assert found[k].best == pytest.approx(want[0][0] / n) and found[k].second == pytest.approx(want[1][0] / n)


def test_held_out_documents_teach_nothing(spark):
    rng = random.Random(9)
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    rows = [("only", i, words(rng, "qx", 30), "h") for i in ids] + [("xx", i, words(rng, "aei", 30), "h") for i in range(400) if i not in ids]
    assert {r.lang_pred for r in langid.identify(spark.createDataFrame(rows, SCHEMA)).collect()} == {"xx"}
    assert {r.lang_pred for r in langid.identify(spark.createDataFrame(rows[: len(ids)], SCHEMA)).collect()} == {"und"}
    assert langid.identify(spark.createDataFrame([], SCHEMA)).collect() == []


def test_number_signs_are_no_letters():
    assert langid.pieces("½ a²b Ⅷ x_y 7ü") == ["a", "b", "x", "y", "ü"]


def test_cuts_cover_long_texts():
    data = b" ab  " + b"c" * 37 + b" d e\n" * 20
    for size in (1, 3, 10, 1000):
        assert [w for at in range(0, len(data), size) for w in langid._cut(data, at, size)] == data.split()
