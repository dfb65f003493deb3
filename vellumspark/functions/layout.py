"""Layout annotations in decoded text.

Spans are <|ref|>label<|/ref|><|det|>boxes<|/det|> and bare <|det|>label [boxes]<|/det|>.
A reference span's label runs to the first closing tag, and boxes must follow at once;
if they don't, the search goes on behind the opening tag. A tempered pattern says just
that, so no row leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from .vectors import let

REF = "(?s)<\\|ref\\|>((?:(?!<\\|/ref\\|>).)*+)<\\|/ref\\|><\\|det\\|>(.*?)<\\|/det\\|>"
DET = "<\\|det\\|>(?U:\\s*)([A-Za-z_][\\p{IsAlphabetic}\\p{N}_-]*+)(?U:\\s*+)(\\[[^\\]]+\\])(?U:\\s*+)<\\|/det\\|>"
NUMBER = "[+-]?(?:\\d+\\.?\\d*|\\.\\d+)"


def numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), 0), lambda n: n.cast("double"))


def boxes(text: Column) -> Column:
    """Numbers by fours, cut toward zero; what is left over at the end goes."""
    return let(numbers(text), lambda n: F.transform(F.filter(F.sequence(F.lit(0), F.floor(F.size(n) / 4).cast("int")), lambda k: k * 4 + 4 <= F.size(n)), lambda k: F.transform(F.slice(n, k * 4 + 1, 4), lambda x: x.cast("long"))))


def spans(text: Column) -> Column:
    """array<struct<full, label, box_text>>: all reference spans, then all bare ones."""

    def of(pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), lambda f: F.struct(f.alias("full"), F.regexp_extract(f, pattern, 1).alias("label"), F.regexp_extract(f, pattern, 2).alias("box_text")))

    return F.concat(of(REF), of(DET))


def is_image(span: Column) -> Column:
    return (T.trimmed(span["label"]) == "image") | F.contains(span["full"], F.lit("<|ref|>image<|/ref|>"))


def rescaled(coordinate: Column, extent: Column) -> Column:
    """From the 0 to 999 grid to pixels, cut toward zero."""
    return (coordinate / F.lit(999.0) * extent).cast("long")


def image_mark(base: Column | str, index: Column) -> Column:
    return F.concat(F.lit("![](images/"), F.lit(base) if isinstance(base, str) else base, index.cast("string"), F.lit(".jpg)"))


def markdown(text: Column, base: Column | str = "") -> Column:
    """Image spans become numbered links, all others go; every occurrence is replaced."""

    def apply(found: Column) -> Column:
        images, others = F.filter(found, is_image), F.filter(found, lambda s: ~is_image(s))
        linked = F.aggregate(F.transform(images, lambda s, i: F.struct(s["full"].alias("full"), F.concat(image_mark(base, i), F.lit("\n")).alias("by"))), text, lambda t, s: F.replace(t, s["full"], s["by"]))
        clean = F.aggregate(others, linked, lambda t, s: F.replace(t, s["full"], F.lit("")))
        return F.replace(F.replace(clean, F.lit("\\coloneqq"), F.lit(":=")), F.lit("\\eqqcolon"), F.lit("=:"))

    return let(spans(text), apply)


def one_page(decoded: Column) -> Column:
    return let(T.strip_end(decoded), markdown)


def many_pages(decoded: Column, pages: Column) -> Column:
    """Chunks behind page marks; those from ``pages`` on stay as they are, trimmed."""
    chunks = let(F.split(T.strip_end(decoded), T.PAGE), lambda c: F.slice(c, 2, F.size(c)))
    done = F.transform(chunks, lambda p, i: let(T.trimmed(p), lambda t: F.when(i >= pages, t).otherwise(markdown(t, F.concat(F.lit("page_"), i.cast("string"), F.lit("_"))))))
    return F.concat(F.lit("<PAGE>\n"), F.array_join(done, "\n<PAGE>\n"))
