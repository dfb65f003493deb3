"""SimHash near-duplicates: fingerprints in Arrow batches, links by pigeonring chains.

A 64-bit fingerprint is cut into five ring-ordered segments. If two fingerprints
differ in at most ``budget`` bits, some start segment exists from which every chain
of l consecutive segments differs in at most floor(l * budget / 5) bits. With a
budget of 4 the first segment is then equal and the second differs in one bit at
most, so an equi-join on 25-26 bits finds every pair: one side carries its own two
segments, the other also those with one zero bit of the second segment set. The
longer chains and last the whole distance are checked where fingerprints of a key meet.
There a union-find keeps only as many links as connect them, so a ball of near copies makes
no rows for its pairs. Equal fingerprints are merged before, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, kept, trimmed
from .components import connected_components
from .groups import Groups

SHINGLE, SEED, BUDGET = 4, 42, 4
WIDTHS = (13, 13, 13, 13, 12)
#: Shingles whose bits are unpacked at once; bounds memory on very long texts.
CHUNK = 1 << 16
#: Fingerprints of a key that meet in one block, differences and links held at once.
CELL, MATRIX, FOREST = 4096, 1 << 18, 1 << 20
#: Ids of dropped documents that are sent to all tasks; beyond it they are joined.
BROADCAST_IDS = 200_000


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of UTF-8 text; null, empty and blank text give 0."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, SEED)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
    values = np.array(hashes, dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(values), CHUNK):
        part = values[at : at + CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(values), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every document; whole texts, no shuffle."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = b.column(1).cast(pa.large_binary())
            fps = [fingerprint(t.as_py(), shingle) for t in texts]
            yield pa.record_batch([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lambda it: trimmed(batches(it)), "doc_id long, fp long")


def segments(fp: Column) -> list[Column]:
    """The ring's five segments, from the lowest bit."""
    at = np.concatenate([[0], np.cumsum(WIDTHS)]).tolist()
    return [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in pairwise(at)]


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _keys(fp: Column, probing: bool, own: bool = True) -> Column:
    """array<struct<start, key>>: two consecutive segments from each start, if ``own``;
    probing adds the keys with one zero bit of the second segment set."""
    seg, n = segments(fp), len(WIDTHS)

    def from_start(i: int) -> list[Column]:
        width, second_segment = WIDTHS[(i + 1) % n], seg[(i + 1) % n]

        def key(second: Column) -> Column:
            return F.struct(F.lit(i).alias("start"), F.shiftleft(seg[i], width).bitwiseOR(second).alias("key"))

        found = [F.array(key(second_segment))] if own else []
        if probing:
            free = F.filter(F.array(*[F.lit(1 << k).cast("long") for k in range(width)]), lambda bit: second_segment.bitwiseAND(bit) == 0)
            found.append(F.transform(free, lambda bit: key(second_segment.bitwiseOR(bit))))
        return found

    parts = [p for i in range(n) for p in from_start(i)]
    return F.concat(*parts)


def links(prints: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(fp, rep) with distinct fp -> (a, b): reps whose fingerprints differ in at most
    ``budget`` bits (4 at most, for which the join keys are made)."""
    if not 0 <= budget <= BUDGET:
        raise ValueError(f"budget must be 0 to {BUDGET}")
    n = len(WIDTHS)

    def side(name: str, probing: bool) -> DataFrame:
        return prints.select(F.col("fp").alias(f"{name}_fp"), F.col("rep").alias(name), F.explode(_keys(F.col("fp"), probing)).alias("k")).select(f"{name}_fp", name, F.col("k.start").alias(f"{name}_start"), F.col("k.key").alias(f"{name}_key"))

    left, right = side("a", True), side("b", False)
    a, b = F.col("a_fp"), F.col("b_fp")
    differ = [_distance(x, y) for x, y in zip(segments(a), segments(b), strict=True)]
    ring = F.lit(False)
    for i in range(n):
        chain, total = F.col("a_start") == i, F.lit(0)
        for length in range(1, n):
            total = total + differ[(i + length - 1) % n]
            chain = chain & (total <= length * budget // n)
        ring = ring | chain
    on = (F.col("a_start") == F.col("b_start")) & (F.col("a_key") == F.col("b_key")) & (a != b)
    return left.join(right, on & ring & (_distance(a, b) <= budget)).select("a", "b")


def close(x: np.ndarray, y: np.ndarray, start: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (in x, in y) of unsigned fingerprints that link: chains of segments from
    ``start`` of every length within their share of the budget, the whole ring last."""
    at = np.concatenate([[0], np.cumsum(WIDTHS)]).tolist()
    masks, n = [], len(WIDTHS)
    for length in range(1, n + 1):
        ring = [(start + k) % n for k in range(length)]
        masks.append(np.uint64(sum(((1 << WIDTHS[i]) - 1) << at[i] for i in ring)))
    rows = max(1, MATRIX // max(len(y), 1))
    for first in range(0, len(x), rows):
        differ = x[first : first + rows, None] ^ y[None]
        i, j = np.nonzero(np.bitwise_count(differ & masks[2]) <= 3 * budget // n)
        differ = differ[i, j]
        for length in (1, 2, 4, 5):
            fits = np.bitwise_count(differ & masks[length - 1]) <= length * budget // n
            i, j, differ = i[fits], j[fits], differ[fits]
        yield i + first, j


def _linked(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """(start, key, block, probing, fp, rep), sorted by the first four -> (a, b): of a
    task's blocks fewer links than fingerprints, which connect all that link. A block's own
    fingerprints are held, those that probe it go by."""
    now, own, held_back, held_links = None, np.zeros((2, 0), np.int64), [], 0

    def forest() -> pa.RecordBatch:
        """What connects all links held back: fewer than their nodes."""
        nodes, at = np.unique(np.concatenate(held_back, axis=1), return_inverse=True)
        groups = Groups(len(nodes))
        groups.join(*at.reshape(2, -1))
        moved = np.flatnonzero(groups.root != np.arange(len(nodes)))
        held_back.clear()
        return pa.record_batch([pa.array(nodes[moved]), pa.array(nodes[groups.root[moved]])], names=["a", "b"])

    for b in batches:
        if not b.num_rows:
            continue
        where = np.stack([b.column(k).to_numpy() for k in range(3)])
        probing, both = b.column(3).to_numpy(zero_copy_only=False), np.stack([b.column(k).to_numpy() for k in (4, 5)])
        starts = np.flatnonzero(np.r_[True, (where[:, 1:] != where[:, :-1]).any(axis=0)])
        ends = np.r_[starts[1:], where.shape[1]]
        alone = (ends - starts == 1) | (np.add.reduceat(~probing, starts) == 0)
        alone[[0, -1]] = False
        for s, e in zip(starts[~alone].tolist(), ends[~alone].tolist(), strict=True):
            place = tuple(where[:, s].tolist())
            if place != now:
                now, own = place, np.zeros((2, 0), np.int64)
            cut = s + int((~probing[s:e]).sum())
            held = own.shape[1]
            rows = np.concatenate([own, both[:, s:e]], axis=1)
            own = rows[:, : held + cut - s]
            if rows.shape[1] < 2 or not own.shape[1]:
                continue
            groups, bits = Groups(rows.shape[1]), rows[0].view(np.uint64)
            for i, j in close(bits[: own.shape[1]], bits[held:], place[0], budget):
                groups.join(i, j + held)
            moved = np.flatnonzero(groups.root != np.arange(len(groups.root)))
            if len(moved):
                held_back.append(rows[1][np.stack([moved, groups.root[moved]])])
                held_links += len(moved)
            if held_links > FOREST:
                yield forest()
                held_links = 0
    if held_back:
        yield forest()


def connecting_links(prints: DataFrame, budget: int = BUDGET, cell: int = CELL) -> DataFrame:
    """As ``links``, but only links enough to connect all that link, a number that grows with
    the fingerprints and not with the pairs. A key of over ``cell`` fingerprints is cut into
    parts, and every two parts meet in a block of their own."""
    if not 0 <= budget <= BUDGET:
        raise ValueError(f"budget must be 0 to {BUDGET}")

    def side(probing: bool) -> DataFrame:
        keys = F.explode(_keys(F.col("fp"), probing, own=not probing))
        return prints.select("fp", "rep", keys.alias("k")).select("k.start", "k.key", F.lit(probing).alias("probing"), "fp", "rep")

    own, probes = side(False), side(True)
    crowded = kept(own.groupBy("start", "key").agg(F.ceil(F.count("*") / cell).cast("int").alias("parts")).where("parts > 1"), "crowded")
    rows = own.unionByName(probes)
    if crowded.isEmpty():
        rows = rows.withColumn("block", F.lit(0))
    else:
        apart = rows.join(crowded, ["start", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        every = F.sequence(F.lit(0), F.col("parts") - 1)
        # block = own part * parts + probing part; a cut key's own fingerprints also probe its other parts
        held = F.transform(every, lambda other: F.struct(F.lit(False).alias("probing"), (part * F.col("parts") + other).alias("block")))
        probe = F.transform(every, lambda mine: F.struct(F.lit(True).alias("probing"), (mine * F.col("parts") + part).alias("block")))
        blocks = F.when(F.col("probing"), probe).when(F.col("parts") == 1, held).otherwise(F.concat(held, F.filter(probe, lambda s: s["block"] % (F.col("parts") + 1) != 0)))
        rows = apart.select("start", "key", "fp", "rep", F.explode(blocks).alias("s")).select("start", "key", "s.probing", "fp", "rep", "s.block")
    order = ["start", "key", "block", "probing"]
    dealt = rows.select(*order, "fp", "rep").repartition("start", "key", "block").sortWithinPartitions(*order)
    return dealt.mapInArrow(lambda it: trimmed(_linked(it, budget)), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``.

    Fingerprints link at ``budget`` or fewer differing bits; component_id is the
    smallest doc_id reachable, itself included. Null, empty and blank texts have
    fingerprint zero and link like any other. Repeated rows stay repeated. A row with a
    null doc_id joins the component of its fingerprint and never names one (null if
    no other row is there). Other columns are not read; an empty table gives none.
    """
    prints = kept(fingerprints(docs, shingle), "prints")
    distinct = kept(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    found = connected_components(connecting_links(distinct.where("rep IS NOT NULL"), budget))
    groups = distinct.join(found, distinct["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    out = prints.join(groups, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """``docs`` without the near-duplicates: of each component the row with the
    smallest doc_id stays (rows without a doc_id stay)."""
    groups = near_duplicates(docs, shingle, budget)
    key = free_name(docs, "_gone")
    gone = kept(groups.where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct(), "gone")
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, F.col("doc_id").cast("long") == F.col(key), "left_anti")
