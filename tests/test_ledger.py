from vellumspark.operators import ledger as L

ENTRY = """preamble agent: none
```
2026-01-01 | WIN | fenced
```
2026-01-02 | WIN | one
agent: a
kill: USE_A USE_B
disposition: KEEP
per-lever tally: W 1 / L 0 / N 2
2026-01-03 | NEGATIVE(reverted) | two
disposition: KEEPER
per-lever tally: W 1
2026-1-3 | WIN | no heading
"""


def texts(spark, *rows):
    return spark.createDataFrame(rows, "k string, text string")


def test_lines_and_fences(spark):
    rows = L.lines(texts(spark, ("a", "x\r\n```rs\ny\n```\nz\n```\nopen"), ("b", ""), ("c", None), ("d", "1\n\n")), "k", "text")
    assert sorted((r.k, r.line, r.said) for r in L.unfenced(rows, "k").collect()) == [("a", 1, "x"), ("a", 5, "z"), ("b", 1, ""), ("d", 1, "1"), ("d", 2, "")]


def test_table_rules(spark):
    md = "| id | ev | note |\n|---|------|---|\n| 1 | runs/a/ | x |\n| 2 | runs/b | _-_ |\n| 3 | tmp/a | |\n| _—_ | tmp | |\n| 4 | short |\n| id | ev | note |\n| 5 | runs/c | x |\n"
    files = spark.createDataFrame([("runs/a", "sha256sums"), ("runs/b/", "out.txt"), ("runs/b/", None)], "folder string, file string")
    rows = L.lines(texts(spark, ("a", md), ("none", "text")), "k", "text")
    got = L.table_faults(rows, "k", "| id |", ["id", "note", "who"], ["note"], "id", "ev", files, "runs/")
    assert {tuple(r) for r in got.collect()} == {
        ("a", None, "no column", "who"), ("a", 4, "empty cell", "note"), ("a", 5, "empty cell", "note"), ("a", 4, "no digests", "runs/b"), ("a", 5, "prefix", "tmp/a"), ("a", 9, "no folder", "runs/c"),
        ("none", None, "no column", "id"), ("none", None, "no column", "note"), ("none", None, "no column", "who"),
    }


def test_entry_rules_and_names(spark):
    held = L.entries(L.unfenced(L.lines(texts(spark, ("a", ENTRY), ("none", None)), "k", "text"), "k"), "k", L.HEADING)
    got = L.entry_faults(held, "k", ["agent:"], {"disposition": L.DISPOSITION, "tally": L.TALLY})
    assert {tuple(r) for r in got.collect()} == {("a", 10, "no field", "agent:"), ("a", 10, "disposition", None), ("a", 10, "tally", None)}
    none = L.undefined(held, "k", "kill:", r"\bUSE_[A-Z]+\b", texts(spark, ("s", None)), "text")
    assert {r.detail for r in none.collect()} == {"USE_A", "USE_B"}
    one = L.undefined(held, "k", "kill:", r"\bUSE_[A-Z]+\b", texts(spark, ("s", 'x = "USE_B";')), "text")
    assert [tuple(r) for r in one.collect()] == [("a", 5, "undefined", "USE_A")]


def test_columns_of_one_name(spark):
    rows = L.lines(texts(spark, ("a", "| x | y | x |\n| 1 | 2 | 3 |")), "k", "text")
    assert [r.row for r in L.table(rows, "k", "| x").collect()] == [{"y": "2", "x": "3"}]
