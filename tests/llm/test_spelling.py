import re
import zlib
from collections import Counter

import numpy as np
import pytest

from vellumspark.llm import spelling

SCHEMA = "doc_id long, text string, word string, n int, key string"


def plain(rows):
    """Every deletion and replacement of every word, looked up."""
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    holes = {}
    near = {w: set() for w in counts}
    for w in counts:
        for i in range(len(w)):
            holes.setdefault((w[:i], w[i + 1 :]), set()).add(w)
            if w[:i] + w[i + 1 :] in counts:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in counts:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def run(spark, rows, **how):
    docs = spark.createDataFrame([(d, t, "x", 1, None) for d, t in rows], SCHEMA)
    out = spelling.variants(docs, **how)
    assert dict(out.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in out.collect())


def invented(seed, letters, n):
    rng = np.random.default_rng(seed)
    base = ["".join(rng.choice(list(letters), rng.integers(7, 11))) for _ in range(n)]
    rows = [(None, None), (5, ""), (6, "123 \n"), (6, "again again"), (6, "again again")]
    for d in range(60):
        said = []
        for _ in range(200):
            w = base[int(rng.zipf(1.4)) % n]
            i = int(rng.integers(len(w)))
            said.append([w, w, w, w, w[:i] + w[i + 1 :], w[:i] + letters[d % len(letters)] + w[i:], w[:i] + letters[0] + w[i + 1 :]][rng.integers(7)])
        rows.append((d, " ".join(said)))
    return rows


@pytest.mark.parametrize("letters, crowded", [("ab", 1 << 20), ("ab", 64), ("abcÉé", 300), ("aÿ", 8)])
def test_against_lookups(spark, letters, crowded):
    rows = invented(len(letters) + crowded, letters, 300)
    got = run(spark, rows, crowded=crowded)
    assert got == plain(rows) and any(r[1] for r in got)


def test_pairs_of_runs_are_found_once(spark):
    rows = [(1, " ".join(["aaaaaaa"] * 30 + ["aaaaaaaa"] * 3 + ["aaaaaab"] * 2 + ["baaaaaa"] * 2 + ["aaabaaaa"] * 2))]
    assert run(spark, rows, crowded=4) == plain(rows)


def test_chains_of_forms_and_very_long_words(spark):
    rows = [(None, "begining " * 2 + "beginning " * 40 + "beginninge " * 900), (2, "x" * 300_000 + " " + "x" * 300_000), (3, "x" * 300_001 + " " + "x" * 300_001)]
    got = run(spark, rows)
    assert got == [(w, f, r, n, k, m) for w, f, r, n, k, m in plain_short(rows)] and [r[2] for r in got if r[0] == "begining"] == ["beginninge"]


def plain_short(rows):
    """As ``plain``; the two long words, whose lookups would be slow, by hand."""
    short = plain([(d, re.sub("x+", " ", t)) for d, t in rows])
    kept = []
    for d, t in rows[1:]:
        run = t.split()[0]
        h = zlib.crc32(f"{d}:{run}".encode())
        kept.append("x" * (len(run) - (h % 31 == 0)))
    return sorted(short + [(w, None, w, 2, 1, None) for w in kept])


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(1, None), (2, "to be")]) == []


def test_whole_query(spark):
    import duckdb

    from vellumspark.llm import queries

    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    out = queries.queries()["op13_spelling_variants"](spark, "/root/testdata/sf0.001")
    assert sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in out.collect()) == plain(rows)
