"""Line and JSON sources with explicit schemas, their checks, and record sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILE = "struct<filename:string,size:bigint,sha256:string,parts:array<struct<size:bigint,sha256:string,urls:array<string>>>>"
MANIFEST = f"schema_version int, model string, license_notice string, quants map<string,{FILE}>, tokenizer {FILE}"

#: Stage lines: name, pattern, whether repeats add up. The first that fits wins.
STAGES = (
    ("total", r"total[ =]+([0-9.]+) ?s", False),
    ("decode", r"decode[ =]+([0-9.]+) ?s", True),
    ("prefill", r"prefill[ =]+([0-9.]+) ?s", True),
    ("vision", r"vision[ =]+([0-9.]+) ?s", True),
)
TOKENS = r"\(?([0-9]+) tok"

KINDS = ("start", "metric", "end")


def timing_lines(lines: DataFrame, prefix: str) -> DataFrame:
    """(run, line_no, raw) -> (run, line_no, stage, s, tokens). Lines without the prefix
    are skipped; a line with it that no pattern knows is an error."""
    marked = lines.where(F.startswith("raw", F.lit(prefix)))
    stage, seconds = F.lit(None).cast("string"), F.lit(None).cast("double")
    for name, pattern, _ in reversed(STAGES):
        hit = F.col("raw").rlike(pattern)
        stage = F.when(hit, name).otherwise(stage)
        seconds = F.when(hit, F.regexp_extract("raw", pattern, 1).cast("double")).otherwise(seconds)
    known = F.coalesce(stage, F.raise_error(F.concat(F.lit("unknown line: "), F.col("raw"))).cast("string"))
    tokens = F.nullif(F.regexp_extract("raw", TOKENS, 1), F.lit("")).cast("int")
    return marked.select("run", "line_no", known.alias("stage"), seconds.alias("s"), tokens.alias("tokens"))


def stage_totals(parsed: DataFrame) -> DataFrame:
    """Repeats of a stage in a run add up, but for a total, of which the last counts."""
    once = [n for n, _, repeats in STAGES if not repeats]
    last = F.max_by("s", "line_no")
    return parsed.groupBy("run", "stage").agg(F.when(F.col("stage").isin(*once), last).otherwise(F.sum("s")).alias("s"), F.max("tokens").alias("tokens"), F.count("*").alias("occurrences"))


def manifest(text: Column) -> Column:
    """FAILFAST: malformed text or another version is an error."""
    parsed = F.from_json(text, MANIFEST, {"mode": "FAILFAST"})
    known = F.when(parsed["schema_version"] == 1, F.lit(True)).otherwise(F.raise_error(F.lit("the manifest's version is not 1")).cast("boolean"))
    return F.when(known, parsed)


def reassembled(parts: DataFrame) -> DataFrame:
    """(file, ordinal, content, size, sha256, file_sha256) -> (file, ok, bad_parts): every
    part has its size and digest, and all in order have the file's."""
    good = (F.octet_length("content") == F.col("size")) & (F.sha2("content", 256) == F.lower(F.trim("sha256")))
    rows = parts.select("file", "file_sha256", F.struct("ordinal", "content").alias("p"), good.alias("good"))
    whole = F.aggregate(F.array_sort(F.collect_list("p")), F.lit(b""), lambda a, p: F.concat(a, p["content"]))
    out = rows.groupBy("file").agg(F.count_if(~F.col("good")).alias("bad_parts"), (F.sha2(whole, 256) == F.lower(F.trim(F.first("file_sha256")))).alias("same"))
    return out.select("file", ((F.col("bad_parts") == 0) & F.col("same")).alias("ok"), "bad_parts")


def log_violations(record: Column) -> Column:
    """array<string>: what is wrong with a JSON log line; empty if nothing."""
    parsed = F.from_json(record, "schema_version int, ts double, test string, event string, value double, gate string, digest string")

    def say(bad: Column, text: str) -> Column:
        return F.when(F.coalesce(bad, F.lit(True)), F.lit(text))

    kind = parsed["event"]
    checks = F.array(
        say(parsed.isNull() | (parsed["schema_version"] != 1), "schema_version"),
        say(~kind.isin(*KINDS), "event"),
        say(parsed["ts"].isNull() | (parsed["ts"] < 0), "ts"),
        F.when(kind == "metric", say(parsed["value"].isNull(), "value")),
        F.when(parsed["digest"].isNotNull(), say(~parsed["digest"].rlike("^[0-9a-f]{64}$"), "digest")),
    )
    return F.filter(checks, lambda c: c.isNotNull())


def result_lines(results: DataFrame) -> DataFrame:
    """(path, seconds, markdown, error) -> one JSON line each, without absent fields."""
    ok = F.col("error").isNull()
    return results.select(F.to_json(F.struct(F.col("path").alias("image"), ok.alias("ok"), "seconds", F.when(ok, F.col("markdown")).alias("markdown"), F.when(~ok, F.col("error")).alias("error"))).alias("value"))


def summary(results: DataFrame) -> DataFrame:
    n = F.count("*")
    return results.agg(n.alias("count"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds_total"), (F.coalesce(F.sum("seconds"), F.lit(0.0)) / F.greatest(n, F.lit(1))).alias("seconds_per_image"))


def figure_format(pixels: DataFrame) -> DataFrame:
    """(image, rgb array<int>) -> (image, format): png for few distinct colours among at
    most 4096 evenly spaced pixels, else jpeg; an image without pixels is png."""
    step = F.greatest(F.ceil(F.size("rgb") / 4096), F.lit(1))
    seen = F.transform(F.filter("rgb", lambda _, i: i % step == 0), lambda p: F.shiftright(p, 19).bitwiseAND(31) * 1024 + F.shiftright(p, 11).bitwiseAND(31) * 32 + F.shiftright(p, 3).bitwiseAND(31))
    rows = pixels.select("image", F.size(seen).alias("n"), F.size(F.array_distinct(seen)).alias("d"))
    return rows.select("image", F.when((F.col("n") == 0) | (F.col("d") <= 64) | (F.col("d") / F.col("n") < 0.10), "png").otherwise("jpeg").alias("format"))


def joined_pages(pages: DataFrame) -> DataFrame:
    """(doc, page, markdown, error) -> (doc, markdown, first_error): good pages in order,
    trimmed at their ends, a blank line between; an error only if no page is good."""
    rows = pages.select("doc", F.struct("page", "markdown").alias("p"), F.col("error").isNull().alias("ok"), "error", "page")
    good = F.array_sort(F.collect_list(F.when(F.col("ok"), F.col("p"))))
    text = F.array_join(F.transform(good, lambda p: F.regexp_replace(p["markdown"], "(?U)\\s+\\z", "")), "\n\n")
    out = rows.groupBy("doc").agg(text.alias("markdown"), F.count_if("ok").alias("n"), F.min_by("error", F.when(~F.col("ok"), F.col("page"))).alias("first_error"))
    return out.select("doc", F.when(F.col("n") > 0, F.col("markdown")).alias("markdown"), F.when(F.col("n") == 0, F.col("first_error")).alias("first_error"))
