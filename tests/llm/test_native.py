"""Line dedup, URL filter and mixing on rows that the tables don't hold, against DuckDB."""

import random

import duckdb
import pandas as pd
import pytest

from vellumspark.llm import line_dedup, mixing, oracles, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, u string"


def duck(sql, **tables):
    c = duckdb.connect()
    for name, (rows, ddl) in tables.items():
        c.execute(f"CREATE TABLE {name} ({ddl})")
        if rows:
            c.executemany(f"INSERT INTO {name} VALUES ({','.join('?' * len(rows[0]))})", rows)
    r = c.execute(sql)
    return [d[0] for d in r.description], r.fetchall()


def same(df, cols, want):
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    assert sorted(got, key=repr) == sorted((tuple(r) for r in want), key=repr)


def documents():
    rows = []
    for i in range(120):
        lines = [f"own line {i}", "Boiler Plate", "\t rare %d " % (i % 40), "", "twice", "twice"]
        source = "big" if i % 3 else ["a", "b", None][i % 9 // 3]
        rows.append((i, "\n".join(lines[: i % 7]) if i % 11 else None, "en", source, 5, 1, "u"))
    rows += [(500, "Boiler Plate", None, "big", 0, 1, "u"), (501, "", None, "big", 0, 1, "u"), (501, "", None, "big", 0, 1, "u"), (None, "Boiler Plate\nx", None, "tiny", 0, 1, "u"), (502, "a " * 200_000 + "\nBoiler Plate", None, "big", 0, 1, "u")]
    return rows


DDL = "doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT, size INT, u VARCHAR"


@pytest.mark.parametrize("rows", [documents(), []])
def test_lines(spark, rows):
    cols, want = duck(oracles.LINE_DEDUP, documents=(rows, DDL))
    same(line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)), cols, want)


def test_lines_join_when_there_are_many(spark, monkeypatch):
    docs = spark.createDataFrame(documents(), DOCS)
    want = [tuple(r) for r in line_dedup.dedup_lines(docs).collect()]
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", -1)
    same(line_dedup.dedup_lines(docs), line_dedup.dedup_lines(docs).columns, want)
    assert any(r[-1] for r in want)


@pytest.mark.parametrize("rows", [documents(), [], [(1, None, None, None, None, 1, "u")], [(i, "w " * (i % 5 + 1), None, f"s{i % 6}" if i % 50 else "rare", None, 1, "u") for i in range(400)]])
def test_mixing(spark, rows):
    cols, want = duck(oracles.MIXING, documents=(rows, DDL))
    docs = spark.createDataFrame(rows, DOCS)
    mixed = mixing.mix(docs)
    out = mixed.select("doc_id", "size", "source_size", "target", (mixed["size"] * mixed["times"]).alias("taken"))
    same(out, cols, want)
    got = pd.DataFrame([tuple(r) for r in out.collect()], columns=out.columns)
    assert (got["taken"] <= 3 * got["size"]).all()
    if len(rows):
        total = got.drop_duplicates("target")["target"].sum() if len(rows) < 2 else None
        assert total is None or total == 0
    apart = mixing.apply_mix(docs)
    assert apart.columns == docs.columns
    assert apart.count() == sum(r.times for r in mixed.collect())


def test_targets_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1), (None, 500)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    # weights 1, 2, 3, 1; c stops at 3 and a at 30, the rest is shared 2 to 1
    assert got == {"a": 30.0, "c": 3.0, "b": 2 * 1478 / 3, None: 1478 / 3}


def test_no_document_of_a_stopped_source_is_taken_too_often(spark):
    rows = [(i, None if i % 3 else "few words", None, "a", 0, 1, "u") for i in range(200)] + [(1000 + i, "w " * 50, None, "b", 0, 1, "u") for i in range(200)]
    mixed = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.times for r in mixed if r.source == "a"} == {3} and max(r.times for r in mixed) <= 3


def test_targets_of_many_sources(spark):
    rng = random.Random(6)
    rows = [(f"s{i:04}", rng.choice([0, 1, 5, 50, 4000])) for i in range(300)] + [(None, 7)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
    weight = {s: (1, 2, 3)[k % 3] for k, (s, _) in enumerate(sorted(rows, key=lambda r: (r[0] is None, r[0] or "")))}
    left, open_, want = sum(n for _, n in rows), dict(rows), {}
    while True:
        level = left / sum(weight[s] for s in open_)
        over = [s for s, n in open_.items() if level * weight[s] > 3 * n]
        if not over:
            break
        for s in over:
            want[s] = 3 * open_.pop(s)
            left -= want[s]
    want |= {s: level * weight[s] for s in open_}
    assert got == pytest.approx(want)


PAGES = "page_id long, url string, html string, host string, n int"


def pages(big=False):
    rows = [(i, f"http://WWW.Site.net/en/{i}.html?q#f" if i % 2 else f"https://site.net/shop/x{i % 3}/buy/now/{i}/deep", "h", "h", 1) for i in range(300)]
    rows += [(1000 + i, f"https://mixed.io/{'spam' if i % 4 == 0 else 'news'}/{'abcdefghij'[i % 10]}", "h", "h", 1) for i in range(300)]
    rows += [(2000 + i, f"https://deep.io/a/b/c/d/e/{'casino' if i % 5 == 0 else 'guide'}/{i}", "h", "h", 1) for i in range(300)]
    rows += [(10_000 + i, f"https://big.io/{'spam' if i < 30 else 'page'}/{i}", "h", "h", 1) for i in range(3000 if big else 0)]
    odd = [None, "", "http://long.io/" + "x/" * (3000 if big else 6), "no scheme", "http://", "http://a.org", "http://a.org/", "HTTP://ORG/x", "x://corg/", "http://example.org/es/1", "http://a.example.org/en/12", "http://b.com/de/é?x", "http://b.com/fr#a", "http://h/a\nb/c?d", "a://b://c/d", "http://u/Ä/İ", "http://ÄB.ORG/1"]
    return rows + [(5000 + i, u, None, "h", 1) for i, u in enumerate(odd)] + [(None, "http://x.net/", None, "h", 1), (5001, "", None, "h", 1)]


@pytest.mark.parametrize("empty", [(), ("pages",), ("labels",)])
def test_urls(spark, empty):
    rows = [] if "pages" in empty else pages()
    labels = [] if "labels" in empty else [(2000 + i, int(i % 5 != 0), 0) for i in range(300)] + [(i, None if i % 7 == 0 else i % 3, 0) for i in range(0, 300, 2)] + [(1000 + i, int(i % 4 != 0), None) for i in range(0, 300)] + [(1001, None, 1), (None, 0, 0), (4, 0, 1), (4, 1, 0)]
    cols, want = duck(oracles.url_filter_sql(), pages=(rows, "page_id BIGINT, url VARCHAR, html VARCHAR, host VARCHAR, n INT"), labels=(labels, "doc_id BIGINT, quality INT, toxic INT"))
    got = url_filter.judge(spark.createDataFrame(rows, PAGES), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    same(got, cols, want)
    if not empty:
        by = {r.page_id: r for r in got.collect()}
        assert by[1000].verdict == "block" and by[1001].verdict == "allow" and by[1000].template == "/spam/*"
        assert {by[2000 + i].verdict for i in range(0, 300, 5)} == {"block"} and by[2001].verdict == "allow"
        rules = {i - (i > 1): by[5000 + i].rule for i in range(17) if i != 2}
        assert [rules[i] for i in (4, 5, 6, 7, 8, 9, 10, 11)] == [None, "org/", "org/", None, "example.org/es/", "example.org/en/1", "com/de/", None]
        assert by[5000].host == by[5000].path == "" and by[5014].host == "b:"


def test_small_sections_of_large_hosts_and_very_long_paths(spark):
    rows = pages(big=True)
    labels = [(10_000 + i, int(i >= 30), 0) for i in range(0, 3000, 3)]
    extra = "doc_id long, quality int, toxic int, host string, path string, shape string"
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, PAGES), spark.createDataFrame([(*r, "h", "p", "s") for r in labels], extra)).collect()}
    assert {got[10_000 + i].verdict for i in range(30)} == {"block"} and got[10_000].template == "/spam/*"
    assert {got[10_000 + i].verdict for i in range(30, 3000)} == {"allow"}
    assert got[5002].template == "/*" * 3000 and got[5002].verdict == "allow"
