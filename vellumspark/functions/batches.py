"""Arrow batches worked through a few rows at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa

#: Bytes of an Arrow column that become Python objects together.
TOGETHER = 1 << 20


def by_rows(batches: Iterator[pa.RecordBatch], key: list[str], name: str, kind: pa.DataType, one: Callable) -> Iterator[pa.RecordBatch]:
    """(key, name) from (key, value): ``one`` of every value, null of null. A batch is cut
    into slices of about TOGETHER bytes, one row at least, each handed on before the next
    is read, so what a worker holds does not grow with the rows of a batch."""
    for b in batches:
        step = max(1, b.num_rows * TOGETHER // max(1, b.column(len(key)).nbytes))
        for at in range(0, b.num_rows, step):
            part = b.slice(at, step)
            made = [None if v is None else one(v) for v in part.column(len(key)).to_pylist()]
            yield pa.record_batch([*part.columns[: len(key)], pa.array(made, kind)], names=[*key, name])
