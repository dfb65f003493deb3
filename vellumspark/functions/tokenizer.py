"""A whole byte-level tokenizer: added tokens in place, four pre-tokenizing stages, merges by
rank, and back. Cutting a text is Spark functions; merging, which is iterative, runs over
Arrow batches with each worker remembering pieces. Vocabulary files are parameters that
every executor can read; nothing is trained."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .batches import by_rows
from .merging import merge_linked

#: Pieces that a worker remembers.
REMEMBERED = 200_000


class Vocabulary:
    """A tokenizer file: vocabulary, merges in order of rank, added tokens. ``more`` adds
    tokens by content as (id, special)."""

    def __init__(self, path: str, more: tuple[tuple[str, int, bool], ...] = ()):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.ids: dict[str, int] = said["model"]["vocab"]
        self.ranks: dict[tuple[str, str], int] = {}
        for k, pair in enumerate(said["model"]["merges"]):
            self.ranks.setdefault(tuple(pair.split(" ", 1)) if isinstance(pair, str) else tuple(pair), k)
        own = [(a["content"], a["id"], a.get("special", False)) for a in said.get("added_tokens") or []]
        self.added = {content: number for content, number, _ in (*own, *more)}
        self.special = {number for _, number, special in (*own, *more) if special}

    def token_to_id(self, token: str) -> int | None:
        """Added tokens first."""
        found = self.added.get(token)
        return self.ids.get(token) if found is None else found

    @functools.cached_property
    def contents(self) -> dict[int, bytes]:
        """The bytes that each id stands for; an added token stands for its content."""
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        moved = [b for b in range(256) if b not in printable]
        back = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(moved)}
        base = {i: bytes(back[c] for c in t) for t, i in self.ids.items() if all(c in back for c in t)}
        return base | {i: content.encode() for content, i in self.added.items()}

    def piece_ids(self, piece: str) -> list[int]:
        """A byte-level piece; a symbol that the vocabulary lacks is an error."""
        parts = merge_linked(list(piece), lambda a, b: self.ranks.get((a, b)))
        missing = [p for p in parts if p not in self.ids]
        if missing:
            raise ValueError(f"no id for {missing[0]!r}")
        return [self.ids[p] for p in parts]


@functools.lru_cache(maxsize=8)
def vocabulary(path: str, more: tuple[tuple[str, int, bool], ...] = ()) -> Vocabulary:
    return Vocabulary(path, more)


def cut(text: Column, added: dict[str, int]) -> Column:
    """array<struct<piece, id>> in order: added tokens, the longest that fits, with their id;
    between them byte-level pieces without one. Nothing is dropped."""
    plain = lambda t: F.transform(T.pretokenized(t), lambda p: F.struct(T.byte_level(p).alias("piece"), F.lit(None).cast("int").alias("id")))
    if not added:
        return plain(text)
    marks = "|".join(re.escape(a) for a in sorted(added, key=len, reverse=True))
    known = F.create_map(*[F.lit(x) for pair in added.items() for x in pair])
    tokens = F.regexp_extract_all(text, F.lit(marks), F.lit(0))
    marked = F.transform(tokens, lambda t: F.struct(t.alias("piece"), known[t].cast("int").alias("id")))
    between = F.transform(F.split(text, marks, -1), plain)
    return F.flatten(F.zip_with(between, marked, lambda b, m: F.concat(b, F.when(m.isNull(), F.slice(b, 1, 0)).otherwise(F.array(m)))))


def encode(rows: DataFrame, path: str, key: list[str], text: str = "text", more: tuple[tuple[str, int, bool], ...] = ()) -> DataFrame:
    """(key, ids array<int>); nothing is put before or after a text, null has null ids."""
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in key), "ids array<int>"])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = functools.lru_cache(REMEMBERED)(vocabulary(path, more).piece_ids)

        def ids(line: str) -> list[int]:
            return [i for p in line.split(" ") if p for i in ((int(p[1:]),) if p[0] == "\t" else known(p))]

        return by_rows(it, key, "ids", pa.list_(pa.int32()), ids)

    # byte-level pieces hold neither spaces nor tabs, so a text's pieces are one string
    one = lambda p: F.coalesce(F.concat(F.lit("\t"), p["id"].cast("string")), p["piece"])
    pieces = F.array_join(F.transform(cut(F.col(text).cast("string"), vocabulary(path, more).added), one), " ")
    return rows.select(*key, pieces.alias("_pieces")).mapInArrow(batches, schema)


def decode(rows: DataFrame, path: str, key: list[str], skip_special: bool = False, more: tuple[tuple[str, int, bool], ...] = ()) -> DataFrame:
    """(key, text) from (key, ids): bytes are joined first, so characters may lie across ids.
    An unknown id, or bytes that are no UTF-8, are an error."""
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in key), "text string"])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path, more)
        known = own.contents | dict.fromkeys(own.special if skip_special else (), b"")

        def one(ids: list[int]) -> str:
            try:
                content = b"".join([known[i] for i in ids])
            except KeyError as unknown:
                raise ValueError(f"unknown token id {unknown.args[0]}") from None
            return content.decode("utf-8", "strict")

        return by_rows(it, key, "text", pa.string(), one)

    return rows.select(*key, "ids").mapInArrow(batches, schema)
