"""Tensors as a Python data source: ranges of tensors are its partitions.

``spark.read.format("tensors").load(path)`` reads containers and NumPy arrays (a tensor
named after its file) into rows of TENSORS, one for each slice of ``slice`` values, whole
numbers exactly. One large file is many tasks. With ``names`` only these tensors are read;
where spark.sql.python.filterPushdown.enabled is set, filters on ``name`` and ``start`` are
pushed down too, and bytes of other tensors and slices are not read. Files whose name begins with a dot or an underscore are no fixtures.

Planning reads headers, several at a time, and the driver holds one entry for each tensor
and for each ``bytes`` of a larger one; values never pass through it. A file that is none
of these formats, or is cut short, is an error; a folder without files has no rows.
"""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from vellumspark.operators.tables import visible

from . import containers

TENSORS = "path string, name string, dtype string, shape array<bigint>, start bigint, floats array<double>, wholes array<bigint>"
NPY = b"\x93NUMPY"
HEADERS = 16
FIELDS = [pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64())]


@dataclass(frozen=True)
class Range:
    """Values ``start`` to ``stop`` of a tensor whose first value is at ``offset``."""

    path: str
    name: str
    dtype: str
    shape: tuple[int, ...]
    offset: int
    start: int
    stop: int


@dataclass
class Ranges(InputPartition):
    held: list[Range]


def array_entry(f: BinaryIO, name: str) -> tuple[str, str, list[int], int, int]:
    """(name, dtype, shape, offset, bytes) of a NumPy file, in C order and little-endian."""
    length = f.seek(0, 2)
    f.seek(0)
    version = np.lib.format.read_magic(f)
    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    known = {np.dtype(v): k for k, v in containers.KINDS.items()}
    if kind not in known or (fortran and len(shape) > 1):
        raise ValueError(f"{name}: {kind} in {'Fortran' if fortran else 'C'} order is not read")
    size = int(np.prod(shape, dtype=object)) * kind.itemsize
    if f.tell() + size > length:
        raise ValueError(f"{name}: {length - f.tell()} bytes of {size}")
    return name, known[kind], list(shape), f.tell(), size


def _entries(path: str) -> list[tuple[str, str, list[int], int, int]]:
    store, at = containers._opened(path)
    with store.open_input_file(at) as f:
        lead = f.read(6)
        return [array_entry(f, at.rsplit("/", 1)[-1].removesuffix(".npy"))] if lead == NPY else containers.entries(f, verify=False)


def files(path: str, glob: str = "*") -> list[str]:
    store, at = containers._opened(path)
    scheme = path[: len(path) - len(at)] if path.endswith(at) else ""
    found = store.get_file_info(at)
    if found.type == fs.FileType.File:
        return [path]
    below = [x.path for x in store.get_file_info(fs.FileSelector(at, recursive=True)) if x.type == fs.FileType.File]
    names = [p[len(at) :].strip("/").split("/") for p in below]
    return sorted(scheme + p for p, n in zip(below, names, strict=True) if fnmatch.fnmatch(n[-1], glob) and not any(x[:1] in "._" for x in n))


class TensorReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.glob = options["path"].rstrip("/"), options.get("glob", "*")
        self.slice, self.bytes = int(options.get("slice", 1 << 16)), int(options.get("bytes", 1 << 27))
        self.names: set[str] | None = set(json.loads(options["names"])) if "names" in options else None
        self.low, self.high = 0, None

    def partitions(self) -> list[Ranges]:
        """Ranges of whole slices, as many as ``bytes`` hold; at least one slice each."""
        out, room = [], 0
        paths = files(self.path, self.glob)
        with ThreadPoolExecutor(HEADERS) as pool:
            for path, listed in zip(paths, pool.map(_entries, paths), strict=True):
                for name, dtype, shape, offset, size in listed:
                    if self.names is not None and name not in self.names:
                        continue
                    width = containers.WIDTHS[dtype]
                    count = size // width
                    start = -(-self.low // self.slice) * self.slice
                    stop = count if self.high is None else min(count, self.high // self.slice * self.slice + self.slice)
                    step = max(self.bytes // (self.slice * width), 1) * self.slice
                    for at in range(start, stop, step):
                        part = Range(path, name, dtype, tuple(shape), offset, at, min(at + step, stop))
                        cost = (part.stop - at) * width
                        if cost > room:
                            out.append(Ranges([]))
                            room = self.bytes
                        out[-1].held.append(part)
                        room -= cost
        return out or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for r in partition.held:
            width = containers.WIDTHS[r.dtype]
            store, at = containers._opened(r.path)
            with store.open_input_file(at) as f:
                f.seek(r.offset + r.start * width)
                for start in range(r.start, r.stop, self.slice):
                    size = (min(start + self.slice, r.stop) - start) * width
                    data = f.read(size)
                    if len(data) < size:
                        raise ValueError(f"{r.path} ends within {r.name}")
                    whole = r.dtype[0] in "IU"
                    values = np.frombuffer(data, containers.KINDS[r.dtype]).astype("<i8") if whole else containers.decode(data, r.dtype).astype("<f8")
                    row = [r.path, r.name, r.dtype, list(r.shape), start, None if whole else values, values if whole else None]
                    yield pa.record_batch([pa.array([x], t) for x, t in zip(row, FIELDS, strict=True)], names=[c.split()[0] for c in TENSORS.split(", ")])


class PushedReader(TensorReader):
    """With filters, which Spark hands over only where its setting says so."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            told = getattr(f, "attribute", None), getattr(f, "value", None)
            if told[0] == ("name",) and isinstance(f, (EqualTo, In)):
                names = {told[1]} if isinstance(f, EqualTo) else set(told[1])
                self.names = names if self.names is None else self.names & names
                continue
            if told[0] == ("start",):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, told[1])
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = told[1] if self.high is None else min(self.high, told[1])
            yield f


class Tensors(DataSource):
    """Options: path, glob, names (a JSON list), slice (values a row), bytes (a partition)
    and pushed, true where filters may be handed over."""

    @classmethod
    def name(cls) -> str:
        return "tensors"

    def schema(self) -> str:
        return TENSORS

    def reader(self, schema) -> TensorReader:
        options = dict(self.options)
        return (PushedReader if options.get("pushed") == "true" else TensorReader)(options)


def read(spark: SparkSession, path: str, names: list[str] | None = None, **options: object) -> DataFrame:
    visible(spark)
    spark.dataSource.register(Tensors)
    told = {k: str(v) for k, v in options.items()} | ({} if names is None else {"names": json.dumps(names)})
    return spark.read.format("tensors").options(pushed=spark.conf.get("spark.sql.python.filterPushdown.enabled"), **told).load(path)


def write_arrays(arrays: DataFrame, path: str) -> DataFrame:
    """One NumPy file for each row of (file, dtype, shape, values); (file, bytes), written
    as it is computed. A task that runs again writes the same bytes."""
    visible(arrays.sparkSession)

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            sizes = []
            for r in pdf.itertuples(index=False):
                data = np.frombuffer(containers.encoded(r.values, r.dtype), containers.KINDS[r.dtype]).reshape([int(x) for x in r.shape])
                store, at = containers._opened(f"{path}/{r.file}.npy")
                store.create_dir(at.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(at) as f:
                    np.lib.format.write_array(f, data, allow_pickle=False)
                sizes.append(data.nbytes)
            yield pd.DataFrame({"file": pdf["file"].astype(str), "bytes": pd.Series(sizes, dtype="int64")})

    return arrays.select("file", "dtype", "shape", "values").mapInPandas(batches, "file string, bytes bigint")
