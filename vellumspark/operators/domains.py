"""Domains of arguments, settings by precedence, eligibility, tolerances and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checks import violations

UNSIGNED = 2**32 - 1
#: Bytes after which a logged text is cut.
LOG_BYTES = 512


def positive(value: Column) -> Column:
    """Null for a whole number from 1 to 32 bits, else what is wrong with it."""
    return F.when(value.isNull() | (value <= 0), "must be > 0").when(value > UNSIGNED, "too large")


def non_negative(value: Column) -> Column:
    return F.when(value.isNull() | (value < 0), "must be >= 0").when(value > UNSIGNED, "too large")


def finite(value: Column) -> Column:
    """Null for a finite number of 0 or more."""
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")) | (value < 0), "must be finite and >= 0")


def calibration(alpha: Column, p0: Column, stake: Column, cadence: Column) -> Column:
    """Names of the arguments outside their domain: 0 < alpha <= 1, 0 < p0 < 1,
    0 <= stake < 1 / (1 - p0), cadence >= 1. NaN and infinity are outside."""
    number = lambda c: ~(F.isnan(c) | (F.abs(c) == float("inf")))
    return violations(
        (number(alpha) & (alpha > 0) & (alpha <= 1), "alpha"),
        (number(p0) & (p0 > 0) & (p0 < 1), "p0"),
        (number(stake) & (stake >= 0) & (stake * (1 - p0) < 1), "lambda"),
        (cadence >= 1, "cadence"),
    )


def margin(threshold: Column) -> Column:
    """A threshold that is negative or not finite is infinite: every step is verified."""
    return F.when(finite(threshold).isNull(), threshold).otherwise(float("inf"))


def setting(flag: Column, env: Column, default: Column) -> Column:
    """What the flag says, else the environment, else the default; a value that is no
    positive whole number says nothing."""
    read = lambda c: F.when(c.rlike("^\\+?[0-9]+$"), F.try_to_number(F.ltrim(c, F.lit("+")), F.lit("9" * 18)).cast("long"))
    said = [F.when(read(c) > 0, read(c)) for c in (flag, env)]
    return F.coalesce(*said, default)


def eligible(pairs: DataFrame, most_cv: float = 5.0) -> Column:
    """Why two measurements, structs ``ours`` and ``theirs``, can't be compared."""
    each = []
    for side in ("ours", "theirs"):
        cv, n = F.col(f"{side}.cv_pct"), F.coalesce(F.col(f"{side}.n"), F.lit(0))
        each += [(cv.isNotNull() | (n >= 2), f"{side}: single sample"), (F.coalesce(cv <= most_cv, F.lit(True)), f"{side}: noise"), (F.coalesce(F.col(f"{side}.best_ms") != 0, F.lit(False)), f"{side}: no best")]
    same = lambda c: F.col(f"ours.{c}").eqNullSafe(F.col(f"theirs.{c}"))
    return violations(*each, (same("threads"), "threads"), (same("allocator"), "allocator"))


def tolerance(spreads: DataFrame, factor: float) -> DataFrame:
    """(spread, first) of documents -> tolerance: the widest spread times ``factor``, and
    the first place at which any document diverges (0 without one)."""
    return spreads.agg(F.round(F.coalesce(F.max("spread"), F.lit(0.0)) * factor, 8).alias("tolerance"), F.coalesce(F.min("first"), F.lit(0)).alias("first_divergence"))


def battery(cases: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """Per shape, whether all results are equal bit for bit (NaN only to NaN, the signs
    of zeros count), and how many are not."""
    bits = lambda c: F.hex(F.to_binary(F.concat(F.lit(""), F.col(c).cast("string")), F.lit("utf-8")))
    off = F.count_if(~bits(a).eqNullSafe(bits(b)))
    return cases.groupBy(by).agg(F.count("*").alias("cases"), off.alias("mismatches"), (off == 0).alias("passed"))


def token_id(tokens: DataFrame, added: DataFrame, vocab: DataFrame) -> DataFrame:
    """(token) -> with id: of the added tokens, else of the vocabulary, else null. Each
    table has (token, id); of repeated tokens the smallest id counts."""
    one = lambda df, name: df.groupBy("token").agg(F.min("id").alias(name))
    return tokens.join(one(added, "_added"), "token", "left").join(one(vocab, "_own"), "token", "left").withColumn("id", F.coalesce("_added", "_own")).drop("_added", "_own")


def points(options: Column, order: list[str]) -> Column:
    """array<struct<bytes, option>> by bytes, then by the order of precisions, then name;
    options that the order lacks come after it by the sum of their code points."""
    place = lambda o: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), o), F.lit(0)) - 1, len(order) + F.aggregate(F.split(o, ""), F.lit(0).cast("long"), lambda t, c: t + F.ascii(c)))
    keyed = F.transform(options, lambda x: F.struct(x["bytes"].alias("bytes"), place(x["option"]).alias("place"), x["option"].alias("option")))
    return F.transform(F.array_sort(keyed), lambda x: x["option"])


def char_bytes(lead: Column) -> Column:
    """Bytes of the character that a UTF-8 lead byte begins; 1 for any other byte."""
    return F.when(lead < 0x80, 1).when(F.shiftright(lead, 5) == 0b110, 2).when(F.shiftright(lead, 4) == 0b1110, 3).when(F.shiftright(lead, 3) == 0b11110, 4).otherwise(1)


def compact(text: Column, most: int = LOG_BYTES) -> Column:
    """Trimmed text of at most ``most`` bytes of UTF-8; a longer one is cut between
    characters and ends in three dots."""
    from ..functions.text import trimmed

    bare = trimmed(text)
    head = F.encode(bare, "UTF-8").substr(F.lit(1), F.lit(most + 1))
    byte = lambda i: F.conv(F.hex(head.substr(i, F.lit(1))), 16, 10).cast("int")
    starts = F.filter(F.sequence(F.lit(max(1, most - 2)), F.lit(most + 1)), lambda i: F.shiftright(byte(i), 6) != 0b10)
    cut = F.decode(head.substr(F.lit(1), F.array_max(starts) - 1), "UTF-8")
    return F.when(F.octet_length(bare) <= most, bare).otherwise(F.concat(cut, F.lit("...")))


def last_json(lines: Column) -> Column:
    """Of lines the last that is a JSON object, else null."""
    return F.element_at(F.filter(F.transform(F.split(lines, "\n"), lambda x: F.btrim(x)), lambda x: x.startswith("{") & F.try_parse_json(x).isNotNull()), -1)


def with_first(rows: DataFrame, by: str, order: str, value: str, sentinel: object) -> DataFrame:
    """(by, order, value) with a sentinel row of order -1 before each group."""
    first = rows.select(by).distinct().select(by, F.lit(-1).cast(dict(rows.dtypes)[order]).alias(order), F.lit(sentinel).cast(dict(rows.dtypes)[value]).alias(value))
    return rows.select(by, order, value).unionByName(first)


def found_from(text: Column, needle: str, start: Column) -> Column:
    """0-based byte of the first ``needle`` in UTF-8 text at byte ``start`` or later; null
    if there is none, the needle is empty or the start lies beyond the text."""
    if not needle:
        return F.lit(None).cast("int")
    flat = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    at = F.locate(needle.encode().decode("latin-1"), F.substr(flat, start + 1))
    return F.when((start <= F.octet_length(text)) & (at > 0), start + at - 1).cast("int")


#: One character of each class (names are fixed values).
CLASSES = {"ident_start": "[A-Za-z_]", "ident_continue": "[_\\-\\p{IsAlphabetic}\\p{N}]", "letter": "\\p{L}", "mark": "\\p{M}", "number": "\\p{N}", "punctuation": "\\p{P}", "symbol": "\\p{S}", "space": "\\p{IsWhite_Space}"}


def is_class(char: Column, name: str) -> Column:
    """Whether a text of one character is of a class of CLASSES."""
    return char.rlike(f"^{CLASSES[name]}\\z")


def hex_digest(content: Column) -> Column:
    """SHA-256 of bytes or text in lower-case hexadecimal digits."""
    return F.lower(F.hex(F.unhex(F.sha2(content, 256))))


def prompt(prefix: list[int], pad: int, count: Column, suffix: list[int]) -> Column:
    """Ids of a prompt with ``count`` pads where the image goes."""
    return F.concat(F.array(*map(F.lit, prefix)), F.array_repeat(F.lit(pad), count.cast("int")), F.array(*map(F.lit, suffix)))


def allowed(options: DataFrame, pins: DataFrame, floors: DataFrame, bits: dict[str, int]) -> DataFrame:
    """(name, option) that a tensor may take: the pinned one, else those of its floor's
    bits at least. ``pins`` (name, pin) and ``floors`` (name, floor) have a row a tensor
    at most; a pin that the tensor does not offer, or a floor above all, leaves none."""
    width = F.create_map(*[F.lit(x) for kv in bits.items() for x in kv])
    rows = options.select("name", "option").distinct().join(pins, "name", "left").join(floors, "name", "left")
    enough = F.col("floor").isNull() | (width[F.col("option")] >= width[F.col("floor")])
    return rows.where(F.when(F.col("pin").isNotNull(), F.col("option") == F.col("pin")).otherwise(enough)).select("name", "option")
