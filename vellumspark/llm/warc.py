"""WARC archives in the dictionary form of Zstandard: written by tasks, read by tasks.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds a dictionary
built from a bounded sample of the archive's own records; every record then is a frame
of its own. A task writes its archives to the shared folder under names of its own and
returns them as rows; only archives in the stored list exist for readers, so a task
that is run again leaves at most an unlisted file.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, kept

#: Raw bytes after which a task starts another archive, and of records sampled for its dictionary.
ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES = 64 << 20, 2 << 20, 64 << 10
#: Longest start of a record that is used as a sample.
SAMPLE_RECORD = 16 << 10
LEVEL = 3
MAGIC = 0x184D2A5D
#: Up to so many groups of equal payloads are sent to all tasks; beyond it they are joined.
BROADCAST_ROWS = 50_000

ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def record_id(page: int | None) -> str:
    return f"<urn:x-page:{'none' if page is None else page}>"


def page_of(record: str) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(none|-?\d+)>", record)
    if not found:
        raise ValueError(f"not a record id of these archives: {record}")
    return None if found[1] == "none" else int(found[1])


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str, size: int) -> bytes:
    """One WARC/1.1 record: the payload as an HTTP response, or of a revisit its head."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; the samples' end where they are too few to train on."""
    if sum(map(len, samples)) >= 8 * 1024 and len(samples) >= 16:
        try:
            return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 8), samples, k=256, d=8).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-DICTIONARY_BYTES:]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if len(data) >= 8 else None


class Archive:
    """Writes one archive. Records are held until the sample is full, then streamed."""

    def __init__(self, path: str):
        self.path, self.held, self.raw, self.records, self.packer = path, [], 0, 0, None
        system, at = fs.FileSystem.from_uri(path)
        if isinstance(system, fs.LocalFileSystem):
            system.create_dir(at.rpartition("/")[0], recursive=True)
        self.out = system.open_output_stream(at, compression=None)

    def add(self, data: bytes) -> None:
        self.raw, self.records = self.raw + len(data), self.records + 1
        if self.packer:
            self.out.write(self.packer.compress(data))
        else:
            self.held.append(data)
            if self.raw >= SAMPLE_BYTES:
                self._start()

    def _start(self) -> None:
        data = build_dictionary([x[:SAMPLE_RECORD] for x in self.held])
        self.out.write(struct.pack("<II", MAGIC, len(data)) + data)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(data), write_checksum=True)
        for x in self.held:
            self.out.write(self.packer.compress(x))
        self.held = []

    def close(self) -> tuple[str, int, int]:
        if not self.packer:
            self._start()
        self.out.close()
        return self.path, self.records, self.raw


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive."""
    magic, size = struct.unpack_from("<II", content)
    if magic != MAGIC:
        raise ValueError("the archive has no dictionary frame")
    reader = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=_dictionary(content[8 : 8 + size])).stream_reader(io.BytesIO(memoryview(content)[8 + size :]), read_across_frames=True), 1 << 20)
    while line := reader.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError("a record does not start where it should")
        head = {}
        while (line := reader.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            head[name] = value
        block = reader.read(int(head["Content-Length"]))
        if len(block) != int(head["Content-Length"]) or reader.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        yield head, block


def row_of(head: dict[str, str], block: bytes, payloads: bool) -> tuple:
    """ROWS' values; a response's digest and length are of the payload that was read."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    said = head["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = head["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != said):
        raise ValueError(f"the payload of {head['WARC-Record-ID']} is not what was written")
    return page_of(head["WARC-Record-ID"]), size, said, head["WARC-Type"], page_of(head["WARC-Refers-To"]) if revisit else None, head.get("WARC-Target-URI"), payload if payloads and not revisit else None


def revisits(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """(page_id, url, payload, sha, refers_to): rows whose payload of at least
    ``min_payload`` bytes another row with a smaller page_id has refer to the smallest.
    Rows repeating the smallest page_id are responses each."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload"))).withColumn("size", F.octet_length("payload").cast("long"))
    shared = kept(rows.where(F.col("size") >= min_payload).groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").drop("n"), "payloads")
    again = F.col("page_id").eqNullSafe(F.col("first"))
    if shared.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        named = rows.join(F.broadcast(shared), ["sha", "size"], "left")
    else:  # only ids meet on the payload's digest, whose rows may be many; payloads go by page
        ids = rows.select("page_id", "sha", "size").join(shared, ["sha", "size"]).where(~again).select(F.col("page_id").alias("_page"), F.col("sha").alias("_sha"), "first").distinct()
        named = rows.join(ids, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("sha") == F.col("_sha")), "left")
    return named.select("page_id", "url", "payload", "sha", "size", F.when(~again, F.col("first")).alias("refers_to"))


def write(pages: DataFrame, folder: str | None = None, min_payload: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archive (page_id, url, html) and return the stored list (path, records, raw_bytes).

    Null html is an empty payload; null urls and page_ids are kept as such. ``folder``
    (the shared folder by default) must be reachable from every executor.
    """
    target = folder or fresh_path(pages.sparkSession, "warc")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now = [], None
        for b in it:
            for page, url, payload, sha, size, refers in zip(*(c for c in b.columns), strict=True):
                if now is None:
                    now = Archive(f"{target}/{uuid.uuid4().hex}.warc.zst")
                now.add(record(page.as_py(), url.as_py(), payload.as_py(), refers.as_py(), base64.b32encode(sha.as_py()).decode(), size.as_py()))
                if now.raw >= archive_bytes:
                    done.append(now.close())
                    now = None
        if now is not None:
            done.append(now.close())
        if done:
            yield pa.record_batch([pa.array(c) for c in zip(*done, strict=True)], names=["path", "records", "raw_bytes"])

    return kept(revisits(pages, min_payload).mapInArrow(batches, "path string, records long, raw_bytes long"), "archives")


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the listed archives, digests checked: ROWS. An archive is read
    whole by one task; ARCHIVE_BYTES bounds it."""
    spark = archives.sparkSession

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])

        def out(rows: list) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for b in it:
            for content in b.column(0):
                rows, held = [], 0
                for head, block in parse(content.as_py()):
                    rows.append(row_of(head, block, payloads))
                    held += len(block) if payloads else 100
                    if held >= 8 << 20:
                        yield out(rows)
                        rows, held = [], 0
                if rows:
                    yield out(rows)

    folders = [r.folder for r in archives.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).distinct().limit(2).collect()]
    if not folders:
        return spark.createDataFrame([], ROWS)
    if len(folders) > 1:
        raise ValueError("the listed archives must lie in one folder")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folders[0])
    name = lambda c: F.regexp_extract(c, "[^/]+$", 0)
    listed = archives.select(name(F.col("path")).alias("name"))
    return files.select(name(F.col("path")).alias("name"), "content").join(F.broadcast(listed) if listed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else listed, "name", "left_semi").select("content").mapInArrow(batches, ROWS)
