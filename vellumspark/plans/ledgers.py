"""Queries of ledgers made from conversations: a turn is a row or an entry."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumspark.operators import ledger as L

from .base import query, read

HEAD = "| turn | role | chars | evidence |"
UNDER = "runs/"
TURNS = "t AS (SELECT conv_id AS c, turn AS t, min(role) AS role, max(length(text)) AS n FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn)"


def _turns(spark, sf):
    rows = read(spark, sf, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    return rows.groupBy(F.col("conv_id").alias("c"), F.col("turn").alias("t")).agg(F.min("role").alias("role"), F.max(F.length("text")).alias("n"))


def _ledgers(turns, head, said):
    """(c, text) with ``said`` of each turn in order below ``head``."""
    parts = turns.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("t", said.alias("said")))).alias("p"))
    return parts.select("c", F.concat(head, F.array_join(F.transform("p", lambda x: x["said"]), "\n"), F.lit("\n")).alias("text"))


def _evidence(spark, sf):
    """Folders of conversations by five: one holds no digests, one is missing."""
    k = F.col("conv_id") % 5
    rows = read(spark, sf, "conversations").where(k < 4)
    return rows.select(F.concat(F.lit("runs/"), k, F.lit("/")).alias("folder"), F.when(k == 0, "SHA256SUMS").when(k < 3, "Run.sha256.manifest").otherwise("out.log").alias("file"))


TABLE = f"""{TURNS}, r AS (SELECT c, t, 2 + row_number() OVER (PARTITION BY c ORDER BY t) AS line, coalesce(role, '') AS role, t % 5 = 2 OR n IS NULL AS blank,
CASE WHEN t % 4 = 3 THEN 'tmp/' || c % 5 ELSE 'runs/' || c % 5 END AS ev FROM t), h AS (SELECT DISTINCT c FROM t WHERE c % 7 = 0),
k AS (SELECT * FROM r WHERE c % 7 <> 0 AND t % 6 <> 5)
SELECT c, NULL::INTEGER AS line, 'no column' AS rule, unnest(['turn', 'role', 'chars', 'evidence']) AS detail FROM h
UNION ALL SELECT DISTINCT c, NULL, 'no column', 'checked' FROM t
UNION ALL SELECT c, line::INTEGER, 'empty cell', 'chars' FROM k WHERE blank
UNION ALL SELECT c, line::INTEGER, 'empty cell', 'role' FROM k WHERE role = ''
UNION ALL SELECT c, line::INTEGER, CASE WHEN t % 4 = 3 THEN 'prefix' WHEN c % 5 = 4 THEN 'no folder' ELSE 'no digests' END, ev FROM k WHERE t % 4 = 3 OR c % 5 > 2"""


@query(f"WITH {TABLE}")
def p15_table_ledger(spark, sf):
    """Every seventh conversation has no header, every sixth turn no claim."""
    chars = F.when(F.col("t") % 5 == 2, "_—_").otherwise(F.coalesce(F.col("n").cast("string"), F.lit("")))
    where = F.concat(F.when(F.col("t") % 4 == 3, "tmp/").otherwise("runs/"), F.col("c") % 5)
    claim = F.when(F.col("t") % 6 == 5, "_-_").otherwise(F.col("t").cast("string"))
    said = F.concat(F.lit("| "), claim, F.lit(" | "), F.coalesce("role", F.lit("")), F.lit(" | "), chars, F.lit(" |"), where, F.lit("|"))
    head = F.when(F.col("c") % 7 == 0, "# log\n").otherwise(HEAD + "\n").cast("string")
    texts = _ledgers(_turns(spark, sf), F.concat(head, F.lit("|------|---|---|---|\n")), said)
    rows = L.lines(texts, "c", "text")
    return L.table_faults(rows, "c", "| turn | role |", ["turn", "role", "chars", "evidence", "checked"], ["chars", "role"], "turn", "evidence", _evidence(spark, sf), UNDER)


ENTRY = f"""{TURNS}, e AS (SELECT c, t, 1 + 8 * (row_number() OVER (PARTITION BY c ORDER BY t) - 1) AS line, coalesce(role, 'none') AS role, coalesce(n, 0) AS n FROM t),
k AS (SELECT * FROM e WHERE t % 4 <> 3)
SELECT c, line::INTEGER AS line, 'no field' AS rule, 'agent:' AS detail FROM k WHERE n % 3 = 0
UNION ALL SELECT c, line::INTEGER, 'disposition', NULL FROM k WHERE n % 5 = 0
UNION ALL SELECT c, line::INTEGER, 'tally', NULL FROM k WHERE n % 7 = 0
UNION ALL SELECT c, line::INTEGER, 'undefined', 'USE_' || upper(role) || '_' || n % 4 FROM k WHERE n % 4 = 3
UNION ALL SELECT c, line::INTEGER, 'prefix', 'logs/' || c % 5 FROM k WHERE t % 4 = 2
UNION ALL SELECT c, line::INTEGER, CASE WHEN c % 5 = 4 THEN 'no folder' ELSE 'no digests' END, 'runs/' || c % 5 FROM k WHERE t % 4 <> 2 AND c % 5 > 2"""


@query(f"WITH {ENTRY}")
def p16_entry_ledger(spark, sf):
    """Every fourth turn's entry is fenced and counts for nothing; switches 0 to 2 of each
    role are defined by texts made from the turns."""
    n, role = F.coalesce("n", F.lit(0)), F.coalesce("role", F.lit("none"))
    fence = lambda: F.when(F.col("t") % 4 == 3, L.FENCE).otherwise("")
    switch = lambda m: F.concat(F.lit("USE_"), F.upper(role), F.lit("_"), m)
    said = F.concat_ws(
        "\n", F.when(F.col("t") % 4 == 3, L.FENCE).otherwise(F.concat(F.lit("2026-01-02 | "), F.when(n % 2 == 0, "WIN").otherwise("NEGATIVE(reverted)"), F.lit(" | turn "), "t")),
        F.when(F.col("t") % 4 == 3, "2026-01-03 | WIN | fenced").otherwise(""), F.concat(F.when(n % 3 == 0, "by: ").otherwise("agent: "), role),
        F.concat(F.lit("disposition: "), F.when(n % 5 == 0, "KEEPING").otherwise("KEEP")), F.concat(F.lit("per-lever tally: W 1 / L "), F.when(n % 7 == 0, "x").otherwise("0"), F.lit(" / N 2")),
        F.concat(F.lit("kill-switch: "), switch(n % 4), F.lit("=1 restores")), F.concat(F.lit("evidence_id: "), F.when(F.col("t") % 4 == 2, "logs/").otherwise("runs/"), F.col("c") % 5, F.lit(".")), fence(),
    )
    rows = L.unfenced(L.lines(_ledgers(_turns(spark, sf), F.lit(""), said), "c", "text"), "c")
    held = L.entries(rows, "c", L.HEADING)
    sources = _turns(spark, sf).select(F.concat(F.lit('const A: &str = "'), switch(F.lit(0)), F.lit('"; '), switch(F.lit(1)), F.lit(";"), switch(F.lit(2))).alias("text"))
    named = F.rtrim(F.regexp_extract("said", r"\bevidence_id:\s*(\S+)", 1), F.lit(",.;"))
    evidence = held.where(F.col("said").contains("evidence_id:")).select("c", F.col("entry").alias("line"), named.alias("evidence"))
    faults = L.entry_faults(held, "c", ["agent:", "evidence_id:"], {"disposition": L.DISPOSITION, "tally": L.TALLY})
    return faults.unionAll(L.undefined(held, "c", "kill-switch:", r"\bUSE_[A-Z0-9_]+\b", sources, "text")).unionAll(L.evidence_faults(evidence, "c", _evidence(spark, sf), UNDER))
