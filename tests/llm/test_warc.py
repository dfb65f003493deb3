import base64
import hashlib
import io

import pytest
import zstandard

from vellumspark.llm import warc

SCHEMA = "page_id long, url string, html string, sha string, size int, first long"


def run(spark, rows, **how):
    pages = spark.createDataFrame([(p, u, h, "s", 1, 2) for p, u, h in rows], SCHEMA)
    listed = warc.write(pages, **how)
    return listed, warc.read(listed).collect()


@pytest.mark.parametrize(("least", "far"), [(0, False), (3, False), (0, True)])
def test_round_trip(spark, monkeypatch, least, far):
    if far:
        monkeypatch.setattr(warc, "BROADCAST_ROWS", -1)
    rows = [(i, f"http://a/{i} b\r\nx", f"<p>{i % 7}</p>" * (i % 5)) for i in range(60)]
    rows += [(100, None, None), (101, "u", ""), (102, "u", "é" * 400_000), (103, "u", "é" * 400_000), (104, "", "ab"), (105, "", "ab"), (None, "u", "<p>1</p>"), (None, "u", "own")]
    rows += [(106, "u", "own twice"), (106, "u", "own twice")]
    listed, got = run(spark, rows, min_payload=least)
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    want = []
    for p, u, h in rows:
        data = (h or "").encode()
        refers = first.get(h or "") if len(data) >= least else None
        refers = None if refers == p else refers
        want.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if refers is None else "revisit", refers, data if refers is None else None))
    key = lambda r: tuple(map(repr, r))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload and bytes(r.payload) if r.record_type == "response" and r.payload_bytes else r.payload if r.record_type == "revisit" else b"") for r in got), key=key) == sorted(want, key=key)
    assert listed.agg({"records": "sum"}).first()[0] == len(rows)


def test_empty(spark):
    assert run(spark, [])[1] == []


def test_archives_roll_over_and_frames_stand_alone(spark):
    rows = [(i, "http://a/", f"<p>page {i} of some words</p>" * 500) for i in range(200)]
    listed, got = run(spark, rows, archive_bytes=200_000)
    paths = [r.path for r in listed.collect()]
    assert len(paths) > 4 and sorted(r.page_id for r in got) == list(range(200))
    content = open(paths[0].removeprefix("file://"), "rb").read()
    assert content[:4] == bytes.fromhex("5D2A4D18")
    size = int.from_bytes(content[4:8], "little")
    unpack, rest, frames = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content[8 : 8 + size])), content[8 + size :], 0
    while rest:
        one = unpack.decompressobj()
        data = one.decompress(rest)
        assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n")
        rest, frames = one.unused_data, frames + 1
    assert frames == next(r.records for r in listed.collect() if r.path == paths[0])


def test_damage_is_found():
    data = warc.record(1, "u", b"abc", None, base64.b32encode(hashlib.sha1(b"abc").digest()).decode(), 3)
    frame = zstandard.ZstdCompressor().compress
    good = b"\x5d\x2a\x4d\x18\0\0\0\0"
    assert [warc.row_of(*r, True)[0] for r in warc.parse(good + frame(data))] == [1]
    with pytest.raises(ValueError):
        list(warc.parse(frame(data)))
    with pytest.raises(ValueError):
        list(warc.parse(good + frame(data[:-6])))
    with pytest.raises(ValueError):
        [warc.row_of(*r, True) for r in warc.parse(good + frame(data.replace(b"abc", b"abd")))]
    assert io.BytesIO(data).readline() == b"WARC/1.1\r\n"
