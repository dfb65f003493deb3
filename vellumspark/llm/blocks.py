"""Sorted partitions read as blocks of whole groups, for Arrow functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows and bytes at which a block is handed on. A group that is larger is still whole, so
#: callers bound their groups before.
BLOCK_ROWS, BLOCK_BYTES = 1 << 15, 1 << 26


def whole(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Blocks of whole groups of sorted rows, with the rows' group numbers in the block."""

    def changes(t: pa.Table) -> np.ndarray:
        differ = np.zeros(len(t), bool)
        for key in keys:
            c = t[key].combine_chunks()
            values, null = c.fill_null(0).to_numpy(zero_copy_only=False), c.is_null().to_numpy(zero_copy_only=False)
            differ[1:] |= (values[1:] != values[:-1]) | (null[1:] != null[:-1])
        return differ

    held: list[pa.Table] = []
    for b in batches:
        held.append(pa.Table.from_batches([b]))
        if sum(map(len, held)) < BLOCK_ROWS and sum(t.nbytes for t in held) < BLOCK_BYTES:
            continue
        t = pa.concat_tables(held)
        starts = np.flatnonzero(changes(t))
        held = [t]
        if len(starts):
            ready = t.slice(0, int(starts[-1]))
            held = [t.slice(int(starts[-1]))]
            yield ready, np.cumsum(changes(ready))
    if held and sum(map(len, held)):
        t = pa.concat_tables(held)
        yield t, np.cumsum(changes(t))
