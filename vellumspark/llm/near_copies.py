"""Near copies by fingerprints and by the exact Jaccard similarity of five-word shingles.

Fingerprints and their pigeonring links (simhash.py) find what differs in few bits. A
similarity of 0.8 is 10 bits of 64 on average, for which no pigeonring join is selective,
so the rest is found by shingles. Equal texts merge first, whatever their number. Then
every text posts a prefix of its shingles in one global order: of n shingles,
n - ceil(0.8 n) + 1. Two texts of similarity 0.8 share a shingle of their prefixes. Texts
that post the same shingle gather in cells of bounded size, and cells that meet are
compared inside tasks, so that a large group of copies makes no rows for its pairs.
Any order gives the same links. Here shingles that are frequent in a sample come last, so
that few texts post them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import WORD, forget, free_name, kept, stored, trimmed
from .components import connected_components
from .groups import Groups

SHINGLE, SEED = 5, 42
#: Similarity that links, as a fraction: of whole numbers, so that it is met exactly.
PART, WHOLE = 4, 5
#: The order's sample: one text of SAMPLE; shingles that OFTEN of them have come last,
#: the HOT most frequent of these. None of it changes results.
SAMPLE, OFTEN, HOT = 32, 2, 200_000
#: Texts and shingles of a cell, about; columns of a comparison at once.
CELL_TEXTS, CELL_SHINGLES, COLUMNS = 384, 400_000, 4096
#: The side of texts that are compared within their cell.
WITHIN = 2
#: Shingles of one text in a row batch.
ROWS = 100_000
#: Distinct words, and texts, that a worker remembers.
HELD = 200_000
#: Dropped keys, and roles of texts in comparisons, that are sent to all tasks; beyond it
#: they are joined.
BROADCAST_KEYS, BROADCAST_ROLES = 200_000, 1_000_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """Word -> hash."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh64_intdigest(word, SEED)
        return found


def shingles(text: bytes, known: Words) -> np.ndarray:
    """Sorted distinct hashes of runs of SHINGLE words; of fewer words one of all."""
    words = text.lower().split()
    if len(known) > HELD:
        known.clear()
    codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(codes))
    n = len(codes) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = (out + codes[k : k + n]) * MULTIPLIER
        out ^= out >> np.uint64(29)
    return np.unique(out)


def fingerprint_links(texts: DataFrame) -> DataFrame:
    """(key, text), no text blank -> (a, b): keys of texts whose fingerprints of SHINGLE
    words link, enough of them to connect all that link."""
    prints = kept(simhash.fingerprints(texts.select(F.col("key").alias("doc_id"), "text"), SHINGLE).distinct(), "prints")
    first = kept(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    equal = prints.join(first, "fp").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    return simhash.connecting_links(first).unionByName(equal)


def text_key(text: Column) -> Column:
    """Identity of a text; null, empty and blank ones are the same."""
    return F.when(text.rlike(WORD), F.xxhash64(text)).otherwise(F.lit(0).cast("long"))


def _texts(b: pa.RecordBatch, seen: set[int]) -> Iterator[tuple[int, bytes]]:
    """(key, text), most copies left out."""
    for key, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()), strict=True):
        if key not in seen:
            if len(seen) > HELD:
                seen.clear()
            seen.add(key)
            yield key, text.as_py()


def _sets(texts: DataFrame) -> DataFrame:
    """(key, text) -> (key, shingle) of every distinct shingle."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = Words(), set()
        for b in it:
            for key, text in _texts(b, seen):
                own = shingles(text, known).view(np.int64)
                for at in range(0, len(own), ROWS):
                    part = own[at : at + ROWS]
                    yield pa.record_batch([pa.array(np.full(len(part), key)), pa.array(part)], names=["key", "s"])

    return texts.mapInArrow(lambda it: trimmed(batches(it)), "key long, s long")


def _posts(texts: DataFrame, often: dict[int, int]) -> DataFrame:
    """(key, text) -> (s, key, n, at): the prefix's shingles, and where they are in it."""
    table = np.array(sorted(often), np.uint64)
    counts = np.array([often[int(s)] for s in table], np.int64)
    shared = texts.sparkSession.sparkContext.broadcast((table, counts))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = Words(), set()
        table, counts = shared.value
        parts: list[tuple] = []

        def out() -> pa.RecordBatch:
            lengths = [len(p[1]) for p in parts]
            cols = [np.concatenate([p[1] for p in parts]).view(np.int64), np.repeat(np.array([p[0] for p in parts], np.int64), lengths), np.repeat(np.array([p[2] for p in parts], np.int64), lengths), np.concatenate([np.arange(k) for k in lengths])]
            parts.clear()
            return pa.record_batch([pa.array(c) for c in cols], names=["s", "key", "n", "at"])

        for b in it:
            held = 0
            for key, text in _texts(b, seen):
                own = shingles(text, known)
                rank = np.zeros(len(own), np.int64)
                if len(table):
                    at = np.minimum(np.searchsorted(table, own), len(table) - 1)
                    rank = np.where(table[at] == own, counts[at], 0)
                first = len(own) - -(-PART * len(own) // WHOLE) + 1
                parts.append((key, own[np.lexsort((own, rank))[:first]], len(own)))
                held += first
                if held > 100_000:
                    yield out()
                    held = 0
            if parts:
                yield out()

    return texts.mapInArrow(lambda it: trimmed(batches(it)), "s long, key long, n long, at long")


def _often(texts: DataFrame) -> dict[int, int]:
    """Shingle -> its texts in the sample, of the most frequent."""
    counts = _sets(texts.where(F.pmod("key", F.lit(SAMPLE)) == 0)).groupBy("s").agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    return {r.s % 2**64: r.n for r in counts.where("lo < hi").where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "s").limit(HOT).collect()}


def enough(both: Column | np.ndarray, total: Column | np.ndarray) -> Column | np.ndarray:
    """Whether sets of ``total`` shingles together that have ``both`` in common link."""
    return (PART + WHOLE) * both >= PART * total


def posted(texts: DataFrame, done: list[str] | None = None) -> DataFrame:
    """(key, text) -> (s, key, n, cell) of every posted shingle that two texts post.

    The smallest key that posts a shingle leads it, and a text's star is the smallest key
    that leads one of its shingles. A cell is a part of bounded size of a star. ``done``
    gets the tables that nothing reads once the result is written.
    """
    same = Window.partitionBy("s")
    several = _posts(texts, _often(texts)).withColumns({"lo": F.min("key").over(same), "hi": F.max("key").over(same)}).where("lo < hi")
    met, met_path = stored(several.select("s", "key", "n", "lo").distinct(), "met")
    members, members_path = stored(met.groupBy("key").agg(F.min("lo").alias("star"), F.first("n").alias("n")), "members")
    if done is not None:
        done += [met_path, members_path]
    sizes = members.groupBy("star").agg(F.ceil(F.greatest(F.count("*") / CELL_TEXTS, F.sum("n") / CELL_SHINGLES)).cast("int").alias("parts"))
    cells = members.join(sizes, "star").select("key", F.xxhash64("star", F.pmod(F.xxhash64("key"), F.col("parts"))).alias("cell"))
    return met.join(cells, "key").select("s", "key", "n", "cell")


def roles(met: DataFrame, done: list[str] | None = None) -> DataFrame:
    """posted() -> (key, roles): of every text the comparisons (pair, side) that it is in.

    A comparison is of the texts of two cells, or one, that post the same shingles and
    whose sizes fit; so a group of copies is compared by cells and its pairs are no rows.
    Of n and m shingles similar texts have c = ceil(4/9 (n + m)) in common, and of these
    the first c - ceil(0.8 n) + 1 lie in the prefix of n, and likewise of m: a text that
    posts fewer shingles of the other cell is like none of it.
    """
    fit = lambda a, b: (WHOLE * F.col(f"{a}_most") >= PART * F.col(f"{b}_least")) & (WHOLE * F.col(f"{b}_most") >= PART * F.col(f"{a}_least"))
    at, at_path = stored(met.groupBy("s", "cell").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("k")), "cells")
    if done is not None:
        done.append(at_path)
    x, y = (at.select("s", *[F.col(c).alias(f"{side}_{c}") for c in ("cell", "least", "most", "k")]) for side in "ab")
    meet = x.join(y, "s").where(((F.col("a_cell") < F.col("b_cell")) | (F.col("a_cell") == F.col("b_cell")) & (F.col("a_k") > 1)) & fit("a", "b"))
    pair = F.xxhash64("a_cell", "b_cell").alias("pair")
    one = F.col("a_cell") == F.col("b_cell")
    own = lambda side, other, which: meet.select("s", F.col(f"{side}_cell").alias("cell"), pair, F.when(one, WITHIN).otherwise(which).alias("side"), F.col(f"{other}_least").alias("b_least"), F.col(f"{other}_most").alias("b_most"))
    both = own("a", "b", 0).unionByName(own("b", "a", 1).where(F.col("side") != WITHIN))
    texts = met.select("s", "cell", "key", "n", F.col("n").alias("a_least"), F.col("n").alias("a_most"))
    found = texts.join(both, ["s", "cell"]).where(fit("a", "b")).groupBy("key", "pair", "side").agg(F.count("*").alias("shared"), F.first("n").alias("n"), F.min("b_least").alias("least"), F.max("b_most").alias("most"))
    least, most = F.greatest("least", F.ceil(PART * F.col("n") / WHOLE)), F.least("most", F.floor(WHOLE * F.col("n") / PART))
    common = lambda m: F.ceil(PART * (F.col("n") + m) / (PART + WHOLE))
    needed = F.least(common(least) - F.ceil(PART * F.col("n") / WHOLE) + 1, common(most) - F.ceil(PART * most / WHOLE) - 1)  # two less: rounding
    return found.where(F.col("shared") >= needed).groupBy("key").agg(F.collect_list(F.struct("pair", "side")).alias("roles"))


def linked(sets: list[np.ndarray], firsts: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of sets that connect all that link: of the first ``firsts`` with the
    others, or among all if there are no others. Fewer pairs than sets."""
    rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, rows = values[order], rows[order]
    start = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    n = np.diff(np.append(start, len(values)))
    left = np.add.reduceat(rows < firsts, start)
    same = firsts == len(sets)
    use = n > 1 if same else (left > 0) & (left < n)
    rows, column = rows[np.repeat(use, n)], np.repeat(np.arange(use.sum()), n[use])
    others = np.arange(0 if same else firsts, len(sets))
    both = np.zeros((firsts, len(others)), np.float32)
    cuts = np.searchsorted(column, np.arange(0, use.sum() + COLUMNS, COLUMNS))
    for k, (i, j) in enumerate(pairwise(cuts.tolist())):
        if i < j:
            has = np.zeros((len(sets), COLUMNS), np.float32)
            has[rows[i:j], column[i:j] - k * COLUMNS] = 1
            both += has[:firsts] @ has[others].T
    sizes = np.array([len(x) for x in sets])
    a, b = np.nonzero(enough(both.astype(np.int64), sizes[:firsts, None] + sizes[None, others]))
    a, b = (a[a < b], b[a < b]) if same else (a, b + firsts)
    groups = Groups(len(sets))
    groups.join(a, b)
    moved = np.flatnonzero(groups.root != np.arange(len(sets)))
    return moved, groups.root[moved]


def _compared(rows: DataFrame) -> DataFrame:
    """(pair, side, key, own), rows of a pair together, -> (a, b) of linked keys."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}

        def out() -> pa.RecordBatch:
            both = sorted((side, key) for key, (side, _) in held.items())
            keys = np.array([key for _, key in both], np.int64)
            a, b = linked([np.frombuffer(held[key][1], np.int64) for _, key in both], sum(side != 1 for side, _ in both))
            return pa.record_batch([pa.array(keys[a]), pa.array(keys[b])], names=["a", "b"])

        def ready() -> bool:
            return len(held) > 1 and len({side for side, _ in held.values()} - {WITHIN}) != 1

        for batch in it:
            for pair, side, key, own in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3), strict=True):
                if pair != now:
                    if ready():
                        yield out()
                    now, held = pair, {}
                held[key] = side, own.as_py()
        if ready():
            yield out()

    return rows.mapInArrow(lambda it: trimmed(batches(it)), "a long, b long")


def links(texts: DataFrame) -> DataFrame:
    """(key, text), no text blank -> (a, b): keys of texts whose shingles have Jaccard
    similarity PART / WHOLE or more, enough of them to connect all that link."""
    spark, done = texts.sparkSession, []
    posts, path = stored(posted(texts, done), "posted")
    for old in done:
        forget(spark, old)
    done = [path]
    asked = kept(roles(posts, done), "asked")
    for old in done:
        forget(spark, old)
    few = asked.agg(F.coalesce(F.sum(F.size("roles") + 2), F.lit(0))).first()[0] <= BROADCAST_ROLES
    own = _shingled(texts.join(F.broadcast(asked) if few else asked, "key").select("key", "text", "roles"))
    rows = own.select("key", "own", F.explode("roles").alias("r")).select("r.pair", "r.side", "key", "own")
    return _compared(rows.repartition("pair").sortWithinPartitions("pair")).distinct()


def _shingled(texts: DataFrame) -> DataFrame:
    """(key, text, roles) -> (key, own, roles): the sorted shingles as bytes."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = Words(), set()
        for b in it:
            fresh, own, held = [], [], 0
            keys = b.column(0).to_pylist()
            texts = b.column(1).cast(pa.large_binary())

            def out() -> pa.RecordBatch:
                return pa.record_batch([pa.array([keys[i] for i in fresh], pa.int64()), pa.array(own, pa.binary()), b.column(2).take(pa.array(fresh, pa.int64()))], names=["key", "own", "roles"])  # noqa: B023

            for i, key in enumerate(keys):
                if key in seen:
                    continue
                if len(seen) > HELD:
                    seen.clear()
                seen.add(key)
                fresh.append(i)
                own.append(shingles(texts[i].as_py(), known).tobytes())
                held += len(own[-1])
                if held > 4 << 20:
                    yield out()
                    fresh, own, held = [], [], 0
            if fresh:
                yield out()

    return texts.mapInArrow(lambda it: trimmed(batches(it)), "key long, own binary, roles array<struct<pair:long,side:int>>")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without the near copies: of every component of texts that ``links`` or
    ``fingerprint_links`` connect the row of smallest doc_id stays (then of smallest key
    of its text).

    Words are compared without the case of ASCII letters. Null, empty and blank texts
    are copies of each other. A row goes by its doc_id and text together; a null doc_id
    comes after all others. Columns and their order stay.
    """
    names = [free_name(docs, "_near_id"), free_name(docs, "_near_key")]
    key = text_key(F.col("text").cast("string"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), F.col("text").cast("string").alias("text"))
    prints = kept(rows.groupBy("doc_id", "key").agg(F.count("*").alias("rows")), "prints")
    texts = rows.where("key <> 0").select("key", "text")
    # one after the other: tasks of both at once would share an executor's memory
    near = [kept(way(texts), "links") for way in (fingerprint_links, links)]
    found = connected_components(near[0].unionByName(near[1]))
    groups = prints.join(found, prints["key"] == found["node"], "left").select("doc_id", "key", F.coalesce("component", "key").alias("component"))
    first = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("f")).select(F.col("f.doc_id").alias("doc_id"), F.col("f.key").alias("key"))
    same = lambda a, b: (a["key"] == b["key"]) & a["doc_id"].eqNullSafe(b["doc_id"])
    gone = kept(prints.join(first, same(prints, first), "left_anti").select(F.col("doc_id").alias(names[0]), F.col("key").alias(names[1])), "gone")
    few = gone.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return docs.join(F.broadcast(gone) if few else gone, (key == F.col(names[1])) & F.col("doc_id").cast("long").eqNullSafe(F.col(names[0])), "left_anti")
