"""Byte-pair merging by rank, with vocabularies as parameters; nothing is trained.

Merging is iterative, so it runs in Arrow batches; words are remembered by a worker.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import by_rows
from .merging import merge_linked

#: How the public rank files cut text before merging (fixed pattern).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    """A rank file: lines of base64 bytes and a rank; the first rank of a token counts."""
    found: dict[bytes, int] = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                found.setdefault(base64.b64decode(token), int(rank))
    return found


def merge(piece: bytes, known: dict[bytes, int]) -> list[bytes]:
    """A known piece is one token; else the adjacent pair of least rank merges, the
    leftmost of equals, until no pair is known."""
    if piece in known:
        return [piece]
    return merge_linked([piece[i : i + 1] for i in range(len(piece))], lambda a, b: known.get(a + b))


def encode(texts: DataFrame, path: str, key: list[str], text: str = "text", added: dict[str, int] | None = None) -> DataFrame:
    """(key, ids array<int>) of raw-byte merging; null text has null ids. A byte that the
    vocabulary lacks is an error. ``added`` tokens are found in place, the longest first;
    nothing is put before or after a text."""
    kinds = dict(texts.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in key), "ids array<int>"])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        known, cut = ranks(path), regex.compile(PATTERN)
        ids = functools.lru_cache(200_000)(lambda p: [known[x] for x in merge(p.encode(), known)])
        own = added or {}
        marks = regex.compile("|".join(regex.escape(a) for a in sorted(own, key=len, reverse=True)) or "(?!)")

        def all_ids(t: str) -> Iterator[int]:
            at = 0
            for m in marks.finditer(t):
                yield from (i for p in cut.findall(t[at : m.start()]) for i in ids(p))
                yield own[m[0]]
                at = m.end()
            yield from (i for p in cut.findall(t[at:]) for i in ids(p))

        return by_rows(it, key, "ids", pa.list_(pa.int32()), lambda t: list(all_ids(t)))

    return texts.select(*key, F.col(text).cast("string")).mapInArrow(batches, schema)


def decode(rows: DataFrame, path: str, key: list[str], strict: bool = False, added: dict[str, int] | None = None) -> DataFrame:
    """(key, text) from (key, ids). Bytes that are no UTF-8 become U+FFFD, or an error if
    ``strict``; an unknown id is an error."""
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in key), "text string"])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = {i: t for t, i in ranks(path).items()} | {i: t.encode() for t, i in (added or {}).items()}
        return by_rows(it, key, "text", pa.string(), lambda ids: b"".join(back[i] for i in ids).decode("utf-8", "strict" if strict else "replace"))

    return rows.select(*key, "ids").mapInArrow(batches, schema)
