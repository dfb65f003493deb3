"""Text columns: markers, pieces, normalisation, digests and edit distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import let

#: Markers of decoded text (fixed values).
END, PAGE = "<｜end▁of▁sentence｜>", "<PAGE>"
WORD = r"[^\x20\x09-\x0D]+"
#: Runs of ideographs and kana, and of anything else.
CJK = "[\\u4E00-\\u9FA5\\u3040-\\u309F\\u30A0-\\u30FF]+"
NOT_CJK = "[^\\u4E00-\\u9FA5\\u3040-\\u309F\\u30A0-\\u30FF]+"
#: Six ordered alternatives of the word stage (fixed pattern).
GPT_WORD = "[!\"#$%&'()*+,\\-./:;<=>?@\\[\\\\\\]^_`{|}~][A-Za-z]+|[^\\r\\n\\p{L}\\p{P}\\p{S}]?[\\p{L}\\p{M}]+| ?[\\p{P}\\p{S}]+[\\r\\n]*|\\s*[\\r\\n]+|\\s+(?!\\S)|\\s+"
#: The three stages in one pass: digit groups, then words and gaps within a run of
#: ideographs and kana, then those within a run of anything else; a run's end is an end.
_RUN = CJK[1:-2]
_RUN_WORD = f"[{_RUN}&&[^\\p{{L}}\\p{{P}}\\p{{S}}]]?[{_RUN}&&[\\p{{L}}\\p{{M}}]]+|[{_RUN}&&[\\p{{P}}\\p{{S}}]]+"
_REST_WORD = (
    "[!\"#$%&'()*+,\\-./:;<=>?@\\[\\\\\\]^_`{|}~][A-Za-z]+"
    f"|[^\\r\\n\\p{{L}}\\p{{P}}\\p{{S}}\\p{{N}}{_RUN}]?[\\p{{L}}\\p{{M}}&&[^{_RUN}]]+"
    f"| ?[\\p{{P}}\\p{{S}}&&[^{_RUN}]]+[\\r\\n]*|\\s*[\\r\\n]+|\\s+(?![^\\s\\p{{N}}{_RUN}])|\\s+"
)
STAGES = f"\\p{{N}}{{1,3}}|{_REST_WORD}|{_RUN_WORD}|(?:(?!{_RUN_WORD})[{_RUN}])+|(?:(?!{_REST_WORD})[^\\p{{N}}{_RUN}])+"
#: Quotes and dashes that become ASCII (fixed values).
QUOTES, DASHES = "‘’‚‛′“”„‟″", "‐‑‒–—―−"
PLAIN = "'" * 5 + '"' * 5
#: What a running head may hold besides capitals, digits and ASCII white space (fixed values).
HEAD_SIGNS = ".,'\"&:;()-"
CAPITALS, DIGITS, SPACES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), 0)


def trimmed(text: Column) -> Column:
    """Without Unicode white space on either side."""
    return F.regexp_replace(F.regexp_replace(text, "(?U)^\\s+", ""), "(?U)\\s+\\z", "")


def strip_end(text: Column, marker: str = END) -> Column:
    """One trailing marker goes, then white space around."""
    return trimmed(F.when(F.endswith(text, F.lit(marker)), F.substring(text, F.lit(1), F.char_length(text) - len(marker))).otherwise(text))


def collapsed(text: Column) -> Column:
    return trimmed(F.regexp_replace(text, "(?U)\\s+", " "))


def pieces(text: Column, pattern: str) -> Column:
    """Matches and the gaps between them, in order; nothing is dropped."""
    return F.regexp_extract_all(text, F.lit(f"{pattern}|(?:(?!{pattern})[\\s\\S])+"), 0)


def digit_groups(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("\\p{N}{1,3}|\\P{N}+"), 0)


def cjk_runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"{CJK}|{NOT_CJK}"), 0)


def pretokenized(text: Column) -> Column:
    """Digits, then ideographs and kana, then words: each stage cuts the last one's pieces,
    here in one pass."""
    return F.regexp_extract_all(text, F.lit(STAGES), F.lit(0))


def byte_level(text: Column) -> Column:
    """Bytes as printable code points: 188 stand for themselves, 68 move to U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return F.translate(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), "".join(map(chr, rest)), "".join(chr(256 + k) for k in range(len(rest))))


def plain_signs(text: Column) -> Column:
    return F.translate(text, QUOTES + DASHES, PLAIN + "-" * len(DASHES))


def _without(line: Column, first: str, last: str) -> Column:
    """One sign ``first`` before the line and one ``last`` after it go, and white space."""
    bare = F.btrim(line, F.lit(SPACES))
    if first:
        bare = F.when(F.startswith(bare, F.lit(first)), F.substr(bare, F.lit(2))).otherwise(bare)
    bare = F.when(F.endswith(bare, F.lit(last)), F.left(bare, F.char_length(bare) - 1)).otherwise(bare)
    return F.btrim(bare, F.lit(SPACES))


def _number(text: Column, least: int, most: int) -> Column:
    return F.char_length(text).between(least, most) & (F.translate(text, DIGITS, "") == "")


def _header(line: Column) -> Column:
    """A running head: capitals, digits and a few signs, beginning with one of the first
    two and holding a capital; a year of three or four digits in brackets may follow."""
    bare = F.btrim(line, F.lit(SPACES))
    tail = F.substring_index(bare, "[", -1)
    dated = F.endswith(bare, F.lit("]")) & F.contains(bare, F.lit("[")) & _number(_without(tail, "", "]"), 3, 4)
    title = F.when(dated, F.btrim(F.left(bare, F.char_length(bare) - F.char_length(tail) - 1), F.lit(SPACES))).otherwise(bare)
    begins = F.contains(F.lit(CAPITALS + DIGITS), F.left(title, F.lit(1))) & (title != "")
    return begins & (F.translate(title, CAPITALS, "") != title) & (F.translate(title, CAPITALS + DIGITS + HEAD_SIGNS + SPACES, "") == "")


def normalized(text: Column) -> Column:
    """For scoring: signs made plain, running head and page number gone if other lines
    remain, hyphenated line ends joined, lower case, single spaces."""

    def without_tail(lines: Column) -> Column:
        page = _number(_without(F.element_at(lines, -1), "[", "]"), 1, 4)
        return F.when((F.size(lines) >= 2) & page, F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)

    def without_head(lines: Column) -> Column:
        return F.when((F.size(lines) >= 2) & _header(lines[0]), F.slice(lines, 2, F.size(lines))).otherwise(lines)

    body = let(F.split(plain_signs(text), "\n"), lambda ls: let(without_head(ls), lambda rest: F.array_join(without_tail(rest), "\n")))
    return collapsed(F.lower(F.regexp_replace(body, "([A-Za-z])-\\s*\\n\\s*([A-Za-z])", "$1$2")))


def error_rate(edits: Column, length: Column) -> Column:
    return edits / F.greatest(length, F.lit(1))


def word_distance(a: Column, b: Column) -> Column:
    """Edit distance over words: every distinct word of either text becomes one private
    code point, over which characters are compared."""

    def coded(known: Column, own: Column) -> Column:
        return F.array_join(F.transform(own, lambda w: _private(F.array_position(known, w))), "")

    return let(words(a), lambda x: let(words(b), lambda y: let(F.array_union(x, y), lambda known: F.levenshtein(coded(known, x), coded(known, y)))))


def _private(position: Column) -> Column:
    """Position 1, 2, … as a code point of the supplementary private planes (UTF-8)."""
    p = position.cast("int") + 0xF0000
    byte = lambda shift, mask, mark: F.lpad(F.hex(F.shiftrightunsigned(p, shift).bitwiseAND(mask).bitwiseOR(mark)), 2, "0")
    return F.decode(F.unhex(F.concat(byte(18, 7, 0xF0), byte(12, 63, 0x80), byte(6, 63, 0x80), byte(0, 63, 0x80))), "UTF-8")


def fraction_name(x: Column) -> Column:
    """Up to six decimals without trailing zeros."""
    return F.regexp_replace(F.format_string("%.6f", x), "\\.?0+$", "")


def percentile_name(q: Column) -> Column:
    """0.999 is 999: the percentage without zeros at its end and without its point."""
    return F.replace(F.regexp_replace(F.format_string("%.4f", q * 100), "\\.?0+$", ""), F.lit("."), F.lit(""))


def same_digest(content: Column, said: Column) -> Column:
    return F.sha2(content, 256) == F.lower(F.trim(said))
