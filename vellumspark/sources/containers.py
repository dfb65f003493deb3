"""Tensor containers as tables, and tables as tensor containers.

``formats`` sniffs leading bytes, ``directory`` reads headers into one row a tensor,
``values`` decodes the tensors asked for by name and ``write`` makes a container of each
file's rows. The formats are a 64-bit header length and a JSON directory (safetensors),
and this library's own: MAGIC, version, JSON directory and 64-byte-aligned payload with
a SHA-256. Files are listed by Spark's binaryFile source. By default it also reads them
whole; with ``ranges`` tasks read headers and tensors in place through Arrow's file
systems, which files over 2 GiB need.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.operators.tables import visible

MAGIC, VERSION, ALIGN = b"VLMT", 1, 64
PIECE = 1 << 20
WIDTHS = {"F32": 4, "F16": 2, "BF16": 2, "I8": 1, "U8": 1, "I32": 4, "I64": 8}
KINDS = {"F32": "<f4", "F16": "<f2", "I8": "i1", "U8": "u1", "I32": "<i4", "I64": "<i8"}
DIRECTORY = "path string, format string, name string, dtype string, shape array<bigint>, byte_offset bigint, byte_len bigint"
VALUES = "path string, name string, dtype string, shape array<bigint>, values array<float>"


def sniff(content: bytes) -> str | None:
    """'own', 'safetensors' or None, from the first bytes only."""
    if content[:4] == MAGIC:
        return "own"
    if len(content) >= 9 and content[8:9] == b"{" and struct.unpack_from("<Q", content)[0] <= 1 << 32:
        return "safetensors"
    return None


def entries(content: bytes | BinaryIO, verify: bool = True) -> list[tuple[str, str, list[int], int, int]]:
    """(name, dtype, shape, offset in the file, bytes) of every tensor, checked: ranges lie
    in the payload, and bytes are what shape and dtype make. The payload is read only to
    ``verify`` its digest, a piece at a time."""
    f = io.BytesIO(content) if isinstance(content, bytes) else content
    length = f.seek(0, io.SEEK_END)
    f.seek(0)
    lead = f.read(16)
    kind = sniff(lead)
    if kind == "safetensors":
        size = struct.unpack_from("<Q", lead)[0]
        f.seek(8)
        head = json.loads(f.read(size))
        rows = [(n, e["dtype"], e["shape"], 8 + size + e["data_offsets"][0], e["data_offsets"][1] - e["data_offsets"][0]) for n, e in head.items() if n != "__metadata__"]
    elif kind == "own":
        version, size = struct.unpack_from("<IQ", lead, 4)
        if version != VERSION:
            raise ValueError(f"container version {version} is not known")
        head = json.loads(f.read(size))
        start = -(-(16 + size) // ALIGN) * ALIGN
        if verify and _digest(f, start) != head["sha256"]:
            raise ValueError("the payload is not what was written")
        rows = [(e["name"], e["dtype"], e["shape"], start + e["offset"], e["bytes"]) for e in head["tensors"]]
    else:
        raise ValueError("not a tensor container")
    for name, dtype, shape, offset, size in rows:
        if offset < 0 or offset + size > length:
            raise ValueError(f"{name}: {size} bytes at {offset} are not within the file")
        fits(name, dtype, shape, size)
    return rows


def fits(name: str, dtype: str, shape: list[int], size: int) -> None:
    want = WIDTHS[dtype] * int(np.prod(shape, dtype=object)) if len(shape) else WIDTHS[dtype]
    if size != want:
        raise ValueError(f"{name}: {size} bytes don't fit {dtype} {list(shape)}")


def _digest(f: BinaryIO, start: int) -> str:
    f.seek(start)
    sha = hashlib.sha256()
    while piece := f.read(PIECE):
        sha.update(piece)
    return sha.hexdigest()


def decode(data: bytes, dtype: str) -> np.ndarray:
    """Widened to 32-bit floats, exactly."""
    if dtype == "BF16":
        return (np.frombuffer(data, "<u2").astype("<u4") << 16).view("<f4")
    return np.frombuffer(data, KINDS[dtype]).astype("<f4")


def encoded(values: list[float] | list[int], dtype: str) -> bytes:
    """What decode widens, narrowed again; whole numbers don't pass through floats."""
    if dtype == "BF16":
        return (np.asarray(values, "<f4").view("<u4") >> 16).astype("<u2").tobytes()
    given = np.asarray(values)
    return (given if given.dtype.kind in "iu" else given.astype(float)).astype(KINDS[dtype]).tobytes()


def _laid(tensors: list[tuple[str, str, list[int], bytes]], align: int) -> tuple[list[tuple[str, str, list[int], int, int]], bytes]:
    names = [t[0] for t in tensors]
    if len(set(names)) != len(names):
        raise ValueError("a tensor name occurs twice")
    parts, rows, at = [], [], 0
    for name, dtype, shape, data in sorted(tensors):
        fits(name, dtype, shape, len(data))
        parts += [b"\0" * (-at % align), data]
        at += -at % align
        rows.append((name, dtype, [int(x) for x in shape], at, len(data)))
        at += len(data)
    return rows, b"".join(parts)


def build(tensors: list[tuple[str, str, list[int], bytes]]) -> bytes:
    """The library's own container, the same bytes for the same tensors in any order."""
    rows, payload = _laid(tensors, ALIGN)
    listed = [{"name": n, "dtype": d, "shape": s, "offset": at, "bytes": size} for n, d, s, at, size in rows]
    head = json.dumps({"sha256": hashlib.sha256(payload).hexdigest(), "tensors": listed}, sort_keys=True).encode()
    out = MAGIC + struct.pack("<IQ", VERSION, len(head)) + head
    return out + b"\0" * (-len(out) % ALIGN) + payload


def build_safetensors(tensors: list[tuple[str, str, list[int], bytes]]) -> bytes:
    rows, payload = _laid(tensors, 1)
    head = json.dumps({n: {"dtype": d, "shape": s, "data_offsets": [at, at + size]} for n, d, s, at, size in rows}).encode()
    return struct.pack("<Q", len(head)) + head + payload


def _opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), path[5:].replace("//", "", 1) if path.startswith("file://") else path[5:]
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)


def _files(spark: SparkSession, path: str, glob: str | None, ranges: bool) -> DataFrame:
    visible(spark)
    reader = spark.read.format("binaryFile")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return files.select("path", F.lit(None).cast("binary").alias("content")) if ranges else files.select("path", "content")


def _streams(b: pa.RecordBatch) -> Iterator[tuple[str, BinaryIO]]:
    for p, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
        if content.is_valid:
            yield p, io.BytesIO(content.as_py())
        else:
            fs, at = _opened(p)
            with fs.open_input_file(at) as f:
                yield p, f


def formats(spark: SparkSession, path: str, glob: str | None = None, ranges: bool = False) -> DataFrame:
    """(path, format): 'own', 'safetensors' or null, from the first bytes."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = [(p, sniff(f.read(16))) for p, f in _streams(b)]
            if rows:
                yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["path", "format"])

    return _files(spark, path, glob, ranges).mapInArrow(batches, "path string, format string")


def directory(spark: SparkSession, path: str, glob: str | None = None, ranges: bool = False, verify: bool = True) -> DataFrame:
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int64()]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for p, f in _streams(b):
                kind = sniff(f.read(16))
                rows = [(p, kind, *e) for e in entries(f, verify)]
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["path", "format", "name", "dtype", "shape", "byte_offset", "byte_len"])

    return _files(spark, path, glob, ranges).mapInArrow(batches, DIRECTORY)


def values(spark: SparkSession, path: str, names: list[str] | None, glob: str | None = None, ranges: bool = False, rank: int | None = None, dtype: str | None = None) -> DataFrame:
    """Only the named tensors (all, if None) are read and decoded; a name that no file has is simply
    absent. A named tensor of another ``rank`` or ``dtype`` than asked for is an error."""
    wanted = None if names is None else set(names)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for p, f in _streams(b):
                for name, kind, shape, at, size in entries(f, verify=False):
                    if wanted is None or name in wanted:
                        if rank not in (None, len(shape)) or dtype not in (None, kind):
                            raise ValueError(f"{name} is {kind} {shape}")
                        f.seek(at)
                        yield pa.record_batch([pa.array([p]), pa.array([name]), pa.array([kind]), pa.array([shape], pa.list_(pa.int64())), pa.array([decode(f.read(size), kind)], pa.list_(pa.float32()))], names=["path", "name", "dtype", "shape", "values"])

    return _files(spark, path, glob, ranges).mapInArrow(batches, VALUES)


def write(tensors: DataFrame, path: str, form: str = "own") -> DataFrame:
    """One container for each ``file`` of (file, name, dtype, shape, values): a table of
    (file, path, bytes), written as it is computed. A file's tensors are one task's, as
    they are one file; a task that runs again writes the same bytes."""
    visible(tensors.sparkSession)
    make = {"own": build, "safetensors": build_safetensors}[form]

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(r.name, r.dtype, list(r.shape), encoded(r.values, r.dtype)) for r in pdf.itertuples(index=False)]
        data = make(rows)
        to = f"{path}/{key[0]}.{form}"
        fs, at = _opened(to)
        fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(at) as f:
            f.write(data)
        return pd.DataFrame({"file": [key[0]], "path": [to], "bytes": [len(data)]})

    return tensors.groupBy("file").applyInPandas(one, f"file {tensors.schema['file'].dataType.simpleString()}, path string, bytes long")


def is_pdf(path, content):
    """By extension in any case, or by its first five bytes."""
    return F.lower(path).endswith(".pdf") | F.coalesce(F.substring(content, 1, 5) == F.lit(b"%PDF-"), F.lit(False))
