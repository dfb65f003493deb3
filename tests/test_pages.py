import zlib

from vellumspark.sources import pages as P


def pdf(*bodies, root=b"/Root 1 0 R"):
    out = b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, b) for k, b in bodies)
    return out + b"trailer\n<< " + root + b" >>\nstartxref\n0\n%%EOF"


CATALOG = (1, b"<< /Type /Catalog /Pages 2 0 R >>")


def order(spark, depth=64, **files):
    df = spark.createDataFrame([(k, v) for k, v in files.items()], "name string, content binary")
    rows = P.ordered_pages(P.page_nodes(df, "name"), "name", depth).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r["name"], r["page"] or 0)):
        out.setdefault(r["name"], []).append(r["error"] or r["node"])
    return out


def test_order_cycles_and_errors(spark):
    nested = pdf(CATALOG, (2, b"<</Kids[9 0 R 3 0 R 8 0 R]/Type/Pages>>"), (3, b"<</Type/Pages/Kids[2 0 R 7 0 R 3 0 R]>>"), *[(k, b"<</Type/Page>>") for k in (7, 8, 9)])
    later = nested + b"\n8 0 obj\n<</Type/Pages/Kids[6 0 R]>>\nendobj\n6 0 obj\n<</Type/Page/Contents 5 0 R>>\nendobj\n"
    twice = pdf(CATALOG, (2, b"<</Type/Pages/Kids[7 0 R 7 0 R]>>"), (7, b"<</Type/Page>>"))
    got = order(spark, nested=nested, later=later, twice=twice, empty=b"", null=None, none=pdf(CATALOG, (2, b"<</Type/Pages/Kids[]>>")), locked=pdf(CATALOG, root=b"/Root 1 0 R /Encrypt 5 0 R"))
    assert got == {"nested": [9, 7, 8], "later": [9, 7, 6], "twice": [7, 7], "empty": ["no container"], "null": ["no container"], "none": ["no pages"], "locked": ["encrypted"]}


def test_streams_hide_words_and_hold_objects(spark):
    packed = b"2 0 7 33 <</Type/Pages/Kids[7 0 R 8 0 R]>> <</Type/Page>>"
    first = packed.index(b"<<")
    packed = b"2 0 7 %d " % (packed.index(b"<</Type/Page>>") - first) + packed[first:]
    first = packed.index(b"<<")
    data = zlib.compress(packed)
    holder = b"<< /Type /ObjStm /N 2 /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (first, len(data), data)
    noise = b"x endobj 8 0 obj <</Type/Font>> endobj"
    body = pdf(CATALOG, (20, holder), (8, b"<</Type/Page>>"), (21, b"<< /Length %d >>\nstream\n%s\nendstream" % (len(noise), noise)))
    assert order(spark, packed=body, cut=body[: body.index(b"stream") + 30]) == {"packed": [7, 8], "cut": ["broken: object stream cut short"]}


def test_depth_is_bounded(spark):
    chain = pdf(CATALOG, *[(k, b"<</Type/Pages/Kids[%d 0 R]>>" % (k + 1)) for k in range(2, 8)], (8, b"<</Type/Page>>"))
    assert order(spark, chain=chain) == {"chain": [8]}
    assert order(spark, depth=3, chain=chain) == {"chain": ["too deep"]}
