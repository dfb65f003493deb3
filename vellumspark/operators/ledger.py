"""Checks of ledgers: markdown tables and dated entries, lines as rows.

A ledger is one text with a key; its lines become rows at once, and only windows within a
ledger put them in order. Null texts have no lines. Faults are rows (key, line, rule,
detail), one for each thing that is wrong; a ledger without faults has none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells that count as not filled, beside empty ones (fixed values).
EMPTY = ("_—_", "_-_", "_no measurements yet_")
#: What an entry's outcome and tally look like (fixed values).
HEADING = r"^\d{4}-\d{2}-\d{2} \| (WIN|NEGATIVE\(reverted\)) \| .+$"
DISPOSITION = r"disposition:\s*(KEEP|REVERT)\b"
TALLY = r"per-lever tally:\s*W\s+\d+\s*/\s*L\s+\d+\s*/\s*N\s+\d+"
FENCE = "```"


def lines(ledgers: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, said), lines from 1; a last line break ends a line and begins none."""
    broken = F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n")
    return ledgers.select(key, F.posexplode(broken).alias("line", "said")).withColumn("line", F.col("line") + 1)


def unfenced(rows: DataFrame, key: str) -> DataFrame:
    """Lines outside fenced blocks: an odd count of fences up to a line is a block's. A
    block left open goes on to the end."""
    fence = F.col("said").startswith(FENCE)
    upto = F.sum(fence.cast("int")).over(Window.partitionBy(key).orderBy("line"))
    return rows.withColumn("_f", upto).where((F.col("_f") % 2 == 0) & ~fence).drop("_f")


def cells(said: Column) -> Column:
    """array<string>: a markdown row's cells without space around them."""
    return F.transform(F.split(F.regexp_replace(F.trim(said), r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c))


def filled(cell: Column) -> Column:
    return F.coalesce(~F.trim(cell).isin("", *EMPTY), F.lit(False))


def headers(rows: DataFrame, key: str, prefix: str) -> DataFrame:
    """(key, columns): cells of the first line that begins with ``prefix``."""
    return rows.where(F.col("said").startswith(prefix)).groupBy(key).agg(cells(F.min_by("said", "line")).alias("columns"))


def table(rows: DataFrame, key: str, prefix: str) -> DataFrame:
    """(key, line, row): map of column and cell of each row with as many cells as the
    header has; rules under headers and repeats of a header are no rows. Of columns with
    one name the last counts."""
    held = rows.where(F.col("said").startswith("|") & ~F.col("said").contains("------"))
    held = held.select(key, "line", cells(F.col("said")).alias("_c")).join(headers(rows, key, prefix), key)
    held = held.where((F.size("_c") == F.size("columns")) & (F.col("_c") != F.col("columns")))
    last = F.filter(F.sequence(F.lit(1), F.size("columns")), lambda i: ~F.array_contains(F.slice("columns", i + 1, F.size("columns")), F.get("columns", i - 1)))
    pairs = F.transform(last, lambda i: F.struct(F.get("columns", i - 1), F.get("_c", i - 1)))
    return held.select(key, "line", F.map_from_entries(pairs).alias("row"))


def _faults(rows: DataFrame, key: str, line: Column, *checks: tuple[Column, str, Column]) -> DataFrame:
    wrong = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(rule).alias("rule"), detail.alias("detail"))) for ok, rule, detail in checks])
    return rows.select(key, line.alias("line"), F.inline(F.array_compact(wrong)))


def evidence_faults(named: DataFrame, key: str, files: DataFrame, prefix: str) -> DataFrame:
    """(key, line, evidence) beside (folder, file) of stored evidence: evidence lies under
    ``prefix``, its folder exists, and one of its files is a list of digests. Folders are
    reduced to a row each before they meet the ledgers."""
    name = F.lower("file")
    listed = (name == "sha256sums") | (name.contains("sha256") & name.contains("manifest"))
    dirs = files.groupBy(F.rtrim("folder", F.lit("/")).alias("_d")).agg(F.max(F.coalesce(listed, F.lit(False))).alias("_l"))
    said = named.withColumn("_e", F.rtrim("evidence", F.lit("/"))).join(dirs, F.col("_e") == F.col("_d"), "left")
    rule = F.when(~F.coalesce(F.col("evidence").startswith(prefix), F.lit(False)), "prefix").when(F.col("_d").isNull(), "no folder").when(~F.col("_l"), "no digests")
    return said.select(key, "line", rule.alias("rule"), F.col("evidence").alias("detail")).where("rule IS NOT NULL")


def table_faults(rows: DataFrame, key: str, prefix: str, required: list[str], cells_filled: list[str], claim: str, evidence: str, files: DataFrame, under: str) -> DataFrame:
    """Faults of a ledger's table: required columns that its header lacks (line null; all of
    them, where no header is), cells that must be filled, and evidence. Rows without a
    ``claim`` don't count. ``rows`` are those of ``lines``."""
    ledgers = rows.groupBy(key).agg(F.lit(1).alias("_1")).join(headers(rows, key, prefix), key, "left")
    columns = _faults(ledgers, key, F.lit(None).cast("int"), *[(F.array_contains("columns", c), "no column", F.lit(c)) for c in required])
    claimed = table(rows, key, prefix).where(filled(F.col("row")[claim]))
    empty = _faults(claimed, key, F.col("line"), *[(filled(F.col("row")[c]), "empty cell", F.lit(c)) for c in cells_filled])
    named = evidence_faults(claimed.select(key, "line", F.col("row")[evidence].alias("evidence")), key, files, under)
    return reduce(DataFrame.unionAll, [columns, empty, named])


def entries(rows: DataFrame, key: str, heading: str) -> DataFrame:
    """(key, entry, line, said): lines from each heading up to the next, ``entry`` the
    heading's line. What comes before the first belongs to none. ``rows`` are unfenced."""
    head = F.when(F.col("said").rlike(heading), F.col("line"))
    held = rows.withColumn("entry", F.last(head, ignorenulls=True).over(Window.partitionBy(key).orderBy("line")))
    return held.where("entry IS NOT NULL")


def entry_faults(held: DataFrame, key: str, fields: list[str], patterns: dict[str, str] | None = None) -> DataFrame:
    """Faults of entries, at their headings' lines: fields that no line holds, and rules
    whose pattern no line matches. Lines are reduced to one flag each, so an entry's text is
    not put together."""
    rules = [(F.col("said").contains(f), "no field", f) for f in fields] + [(F.col("said").rlike(p), n, None) for n, p in (patterns or {}).items()]
    flags = held.groupBy(key, "entry").agg(*[F.max(ok).alias(f"_{i}") for i, (ok, _, _) in enumerate(rules)])
    checks = [(F.col(f"_{i}"), rule, F.lit(f).cast("string")) for i, (_, rule, f) in enumerate(rules)]
    return _faults(flags, key, F.col("entry"), *checks)


def names(said: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(said, F.lit(pattern), 0))


def undefined(held: DataFrame, key: str, field: str, pattern: str, sources: DataFrame, text: str) -> DataFrame:
    """Names that an entry's first line beginning with ``field`` uses and no source text
    defines; sources are reduced to their distinct names."""
    line = held.where(F.col("said").startswith(field)).groupBy(key, "entry").agg(F.min_by("said", "line").alias("said"))
    used = line.select(key, F.col("entry").alias("line"), F.explode(names(F.col("said"), pattern)).alias("detail"))
    known = sources.select(F.explode(names(F.col(text), pattern)).alias("detail")).distinct()
    return used.join(known, "detail", "left_anti").select(key, "line", F.lit("undefined").alias("rule"), "detail")
