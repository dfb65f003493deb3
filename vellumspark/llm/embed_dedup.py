"""Exact cosine near-duplicates of vectors by dual traversal of cover trees.

On unit vectors a cosine of at least t is a distance of at most sqrt(2 - 2t). Equal
vectors are merged first and carry their number. The tree's upper levels are cells: a
crowded cell's pivots are a net of a sample of its vectors, and its vectors go to the
nearest; cells of few blocks are dealt into blocks of bounded size. Within a block,
nested nets with halving radii are the lower levels, and vectors the last. The dual
traversal descends from the root pair by joins, as only children of a pair that is near
enough meet, then within a pair of blocks: two nodes' children are compared only if
their covering radii let a pair be near enough; nodes all of whose pairs are near count
as a whole. Bounds are products of matrices in single precision, with slack for its
rounding; pairs of vectors that the slack leaves open are compared in double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import kept
from .components import connected_components
from .groups import Groups

COSINE = 0.9
#: Vectors expected in the sample that a cell's pivots are chosen from, pivots of a cell
#: at most, vectors of a block at least.
SAMPLE, FAN, BLOCK = 4096, 64, 5000
#: Where bounds prune nothing every pair of blocks is compared, and a vector is read once
#: for each block: so many blocks are a table, until a block has that many components.
PARTS, WHOLE = 16, 1 << 22
#: Cells of more blocks than this are split, this many times at most.
SPLIT, DEPTH = 4, 4
ROOT = 1
POINTS = "rep long, n long, h long, x binary"
#: Radii of the nets within a block.
RADII = (1.0, 0.5, 0.25, 0.125)
#: Slack on bounds for rounding; the comparison itself has none.
SLACK = 1e-9
#: Rows and columns of a product; fewer pairs than FEW are multiplied one by one.
ROWS, COLUMNS, FEW = 512, 1024, 256
#: A level's nodes are compared if products go down to GAIN of what they were, by LOOK of
#: its nodes; one of few pairs takes as long as ALONE in a matrix.
GAIN, LOOK, ALONE = 0.8, 256, 30
#: Pairs looked at together.
PAIRS = 1 << 16
#: Bytes of the vectors that are one row of a table of trees.
CHUNK = 1 << 13


def units(x: np.ndarray) -> np.ndarray:
    """Rows over their length; scaled first, so that large components don't overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def net(x: np.ndarray, radius: float, chunk: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Greedy net: rows chosen as centres, and for each row the position of a centre
    within ``radius`` of it, but for rounding."""
    owner, centres = np.full(len(x), -1), []
    left, least = np.arange(len(x)), 1 - radius * radius / 2
    while len(left):
        head = left[:chunk]
        near = x[head] @ x[head].T >= least
        fresh: list[int] = []
        for i in range(len(head)):
            if not near[i, fresh].any():
                fresh.append(i)
        first = len(centres)
        centres += head[fresh].tolist()
        for at in range(0, len(left), 8192):
            part = left[at : at + 8192]
            d = x[part] @ x[head[fresh]].T
            best = d.argmax(axis=1)
            hit = d[np.arange(len(part)), best] >= least
            owner[part[hit]] = first + best[hit]
        owner[head[fresh]] = np.arange(first, len(centres))
        left = left[owner[left] < 0]
    return np.array(centres, np.int64), owner


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (a @ b.T)))


class Tree:
    """Nested nets over one block, and its rows as the last level. Level k's nodes own
    consecutive rows of the ordered block; ``radius[k]`` is the largest distance from a
    node's mean to its rows."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, x: np.ndarray, path: np.ndarray):
        """``n``: rows that each vector stands for; ``path``: for each vector the node
        numbers of all nets, nested."""
        order = np.lexsort(path.T[::-1])
        self.ids, self.n, self.x, path = ids[order], n[order], x[order], path[order]
        self.starts, self.ends, self.means, self.radius, self.weight = [], [], [], [], []
        new = np.ones(len(path), bool)
        new[1:] = False
        for k in range(path.shape[1]):
            new[1:] |= path[1:, k] != path[:-1, k]
            self._level(np.flatnonzero(new))
        self._level(np.arange(len(path)))

    def _level(self, start: np.ndarray) -> None:
        end = np.append(start[1:], len(self.x))
        mean, radius = self.x[start], np.zeros(len(start))
        many = np.flatnonzero(end - start > 1)
        if len(many):
            rows, node = _span(start[many], end[many])
            first = np.flatnonzero(np.diff(node, prepend=-1))
            mean[many] = np.add.reduceat(self.x[rows], first, axis=0) / (end - start)[many, None]
            off = np.sqrt(((self.x[rows] - mean[many][node]) ** 2).sum(axis=1))
            radius[many] = np.maximum.reduceat(off, first)
        self.starts.append(start), self.ends.append(end), self.radius.append(radius)
        self.weight.append(np.add.reduceat(self.n, start))
        self.means.append(mean.astype(np.float32))

    def below(self, k: int, nodes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Range of a lower level's nodes within each of some of level k's."""
        return np.searchsorted(self.starts[level], self.starts[k][nodes]), np.searchsorted(self.starts[level], self.ends[k][nodes])

    def sides(self, k: int, reach: float, left: bool) -> np.ndarray:
        """Level k's nodes as rows of a matrix: a node of radius r and one of radius s,
        ``left`` and not, have the product ((reach + r + s)² - reach² - gap²) / 2, if
        gap is the distance of their means."""
        mean, r = self.means[k], self.radius[k]
        own = r * (r / 2 + reach) - np.einsum("ij,ij->i", mean, mean, dtype=float) / 2
        one = np.ones(len(r))
        return np.column_stack([mean, np.stack([r, own, one] if left else [r, one, own], axis=1).astype(np.float32)])


def node_path(x: np.ndarray) -> np.ndarray:
    """Node numbers of nested nets with RADII: each net is made within its parent's."""
    x = x.astype(np.float32)
    path = np.zeros((len(x), len(RADII)), np.int32)
    groups = [np.arange(len(x))]
    for k, radius in enumerate(RADII):
        after = []
        for rows in groups:
            if len(rows) == 1:
                continue
            _, owner = net(x[rows], radius)
            path[rows, k] = owner
            order = np.argsort(owner, kind="stable")
            after += [rows[g] for g in np.split(order, np.flatnonzero(np.diff(owner[order])) + 1) if len(g) > 1]
        groups = after
    return path


def _span(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges, and the range each is from."""
    sizes = hi - lo
    owner = np.repeat(np.arange(len(lo)), sizes)
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + lo[owner], owner


Ranges = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def products(x: np.ndarray, y: np.ndarray, ranges: Ranges, least: float, same: bool) -> Iterator[Found]:
    """(row of x, row of y, product) of every product of at least ``least``, a bounded
    number at once. ``ranges``: of rows of x, and of the rows of y that meet them; if
    ``same``, no row of y before that of x counts."""
    size = (ranges[1] - ranges[0]) * (ranges[3] - ranges[2])
    found, held = [], 0
    for part in chain(_large(x, y, [r[size >= FEW] for r in ranges], least, same), _small(x, y, [r[size < FEW] for r in ranges], least, same)):
        found.append(part)
        held += len(part[0])
        if held >= PAIRS:
            yield tuple(np.concatenate(t) for t in zip(*found, strict=True))
            found, held = [], 0
    if found:
        yield tuple(np.concatenate(t) for t in zip(*found, strict=True))


def _large(x: np.ndarray, y: np.ndarray, ranges: list[np.ndarray], least: float, same: bool) -> Iterator[Found]:
    for lo, hi, start, end in zip(*(r.tolist() for r in ranges), strict=True):
        for i in range(lo, hi, ROWS):
            rows = x[i : min(i + ROWS, hi)]
            for j in range(max(start, i) if same else start, end, COLUMNS):
                product = rows @ y[j : min(j + COLUMNS, end)].T
                if product.max() >= least:
                    at = np.flatnonzero(product >= least)
                    p, q = np.divmod(at, product.shape[1])
                    p, q, room = p + i, q + j, product.ravel()[at]
                    keep = p <= q if same else slice(None)
                    yield p[keep], q[keep], room[keep]


def _small(x: np.ndarray, y: np.ndarray, ranges: list[np.ndarray], least: float, same: bool) -> Iterator[Found]:
    lo, hi, start, end = ranges
    total = np.cumsum((hi - lo) * (end - start))
    cuts = np.searchsorted(total, np.arange(PAIRS, total[-1] + 1, PAIRS)) if len(total) else []
    for lo, hi, start, end in zip(*(np.split(r, cuts) for r in ranges), strict=True):
        rows, at = _span(lo, hi)
        q, own = _span(start[at], end[at])
        p = rows[own]
        if same:
            p, q = p[p <= q], q[p <= q]
        room = np.einsum("ij,ij->i", x[p], y[q])
        keep = room >= least
        yield p[keep], q[keep], room[keep]


def near_nodes(a: Tree, b: Tree, reach: float, same: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """(level, nodes of a, nodes of b, all near) that dual traversal leaves: pairs of
    nodes all of whose vectors are near at any level, others at the last. It goes down
    from a bounded number of pairs before it takes up the next, by the levels whose
    bounds save more products than they take."""
    last = len(a.starts) - 1
    # terms of a product come to 12 at most, each of them rounded as often as there are columns
    slack = 12 * (a.x.shape[1] + 11) * 2.0**-23
    least = -reach * reach / 2 - slack

    def all_near(room: np.ndarray, wide: np.ndarray) -> np.ndarray:
        return (wide < reach) & (2 * room.astype(float) + reach * reach - 2 * slack >= 4 * reach * wide)

    side, cost = {last: (a.sides(last, reach, True), b.sides(last, reach, False))}, float(len(a.x)) * len(b.x)
    levels = [last]
    for k in reversed(range(last)):
        nodes = len(a.starts[k]) * len(b.starts[k])
        if nodes > GAIN * cost:
            continue
        x, y = a.sides(k, reach, True), b.sides(k, reach, False)
        some, other = (slice(None, None, -(-len(m) // LOOK)) for m in (x, y))
        room = x[some] @ y[other].T
        share = ((room >= least) & ~all_near(room, a.radius[k][some, None] + b.radius[k][None, other])).mean()
        few = len(a.starts[levels[0]]) * len(b.starts[levels[0]]) < FEW * nodes
        if (took := nodes + share * cost * (ALONE if few else 1)) <= GAIN * cost:
            side[k], cost, levels = (x, y), took, [k, *levels]

    def below(at: int, ranges: Ranges) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
        k = levels[at]
        for p, q, room in products(*side[k], ranges, least, same):
            whole = all_near(room, a.radius[k][p] + b.radius[k][q])
            yield k, p[whole], q[whole], True
            p, q = p[~whole], q[~whole]
            if k == last:
                yield k, p, q, False
            elif len(p):
                yield from below(at + 1, (*a.below(k, p, levels[at + 1]), *b.below(k, q, levels[at + 1])))

    yield from below(0, (np.array([0]), np.array([len(side[levels[0]][0])]), np.array([0]), np.array([len(side[levels[0]][1])])))


def compare(a: Tree, b: Tree, same: bool, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted numbers of links that a's and b's vectors have across (within, if
    ``same``: then the two numbers of a vector add up), and (id, id) pairs, fewer than
    vectors, that connect what is linked."""
    count_a, count_b = np.zeros(len(a.ids) + 1, np.int64), np.zeros(len(b.ids) + 1, np.int64)
    groups, off = Groups(len(a.ids) + (0 if same else len(b.ids))), 0 if same else len(a.ids)

    def all_near(k: int, p: np.ndarray, q: np.ndarray) -> None:
        for count, own, x, other, y in ((count_a, a, p, b, q), (count_b, b, q, a, p)):
            add = np.zeros(len(own.starts[k]), np.int64)
            np.add.at(add, x, other.weight[k][y] * (np.where(p == q, count is count_a, 1) if same else 1))
            at, node = _span(own.starts[k], own.ends[k])
            count[at] += add[node]
        if same:
            at, _ = _span(a.starts[k][p[p == q]], a.ends[k][p[p == q]])
            count_a[at] -= a.n[at]
        for own, x, shift in ((a, p, 0), (b, q, off)):
            x = np.unique(x)
            at, node = _span(own.starts[k][x], own.ends[k][x])
            groups.join(at + shift, own.starts[k][x][node] + shift)
        groups.join(a.starts[k][p], b.starts[k][q] + off)

    def some_near(w: np.ndarray, c: np.ndarray) -> None:
        for i in range(0, len(w), PAIRS):
            x, y = w[i : i + PAIRS], c[i : i + PAIRS]
            near = np.einsum("ij,ij->i", a.x[x], b.x[y]) >= cosine
            if same:
                near &= x != y
            x, y = x[near], y[near]
            np.add.at(count_a, x, b.n[y])
            np.add.at(count_b, y, a.n[x])
            groups.join(x, y + off)

    for k, p, q, whole in near_nodes(a, b, float(np.sqrt(2 - 2 * cosine)), same):
        if len(p) and whole:
            all_near(k, p, q)
        elif len(p):
            some_near(p, q)
    ids = a.ids if same else np.concatenate([a.ids, b.ids])
    moved = groups.root != np.arange(len(ids))
    return count_a[:-1], count_b[:-1], np.stack([ids[moved], ids[groups.root[moved]]], axis=1)


def prepared(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(every row's vec_id and rep or null), (rep, n, x): equal usable vectors merged."""

    usable = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).withColumn("v", F.when(usable, F.transform("v", lambda c: c + 0.0)))
    rows = rows.withColumn("h", F.xxhash64("v"))
    merged = kept(rows.where("v IS NOT NULL AND vec_id IS NOT NULL").groupBy("h", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "vectors")
    return rows, merged


def duplicates(vectors: DataFrame, cosine: float = COSINE, block: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding).

    Links are pairs of rows with a cosine of at least ``cosine``, computed in double
    precision. Vectors that are null, empty, zero or hold null, NaN or infinite
    components link with nothing, nor do rows without a vec_id; vectors of different
    lengths don't link with each other. Rows repeating a vec_id are rows of their own
    and link. component_id is the smallest vec_id reachable. An empty table gives none.
    ``block``: vectors of a block at most, else ``block_size`` of each length's vectors.
    """
    if not 0 < cosine < 1:
        raise ValueError("cosine must lie between 0 and 1")
    rows, merged = prepared(vectors)
    single = vectors.schema["embedding"].dataType == ArrayType(FloatType(), vectors.schema["embedding"].dataType.containsNull)
    sizes = sorted(merged.groupBy(F.size("v")).count().collect())
    found = [_dimension(merged.where(F.size("v") == d), cosine, block or block_size(k, d), single) for d, k in sizes]
    spark = vectors.sparkSession
    counts, edges = (spark.createDataFrame([], "rep long, links long"), spark.createDataFrame([], "a long, b long"))
    for c, e in found:
        counts, edges = counts.unionByName(c), edges.unionByName(e)
    groups = connected_components(edges)
    whole = merged.join(counts.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left").join(groups, merged["rep"] == groups["node"], "left")
    whole = whole.select(F.col("h").alias("_h"), F.col("v").alias("_v"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(whole, (F.col("h") == F.col("_h")) & (F.col("v") == F.col("_v")) & F.col("vec_id").isNotNull(), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def block_size(vectors: int, components: int) -> int:
    """Vectors of a block, of so many in all."""
    return max(BLOCK, min(-(-vectors // PARTS), WHOLE // components))


def _dimension(merged: DataFrame, cosine: float, block: int, single: bool) -> tuple[DataFrame, DataFrame]:
    """(rep, links), (a, b) among merged vectors of one length."""
    kind = np.float32 if single else np.float64

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                x = np.array(b.column("v").flatten(), kind).reshape(b.num_rows, -1)
                yield pa.record_batch([b.column("rep"), b.column("n"), b.column("h"), pa.array([r.tobytes() for r in x], pa.binary())], names=["rep", "n", "h", "x"])

    def unit_rows(x: bytes, rows: int) -> np.ndarray:
        return units(np.frombuffer(x, kind).reshape(rows, -1).astype(float))

    def unpacked(pdf: pd.DataFrame) -> np.ndarray:
        return unit_rows(b"".join(pdf["x"]), len(pdf))

    points = merged.select("rep", "n", "h", "v").mapInArrow(pack, POINTS)
    placed, levels = _cells(points, block, unpacked)
    sizes = placed.groupBy("cell").agg(F.count("*").alias("k"))
    parts = F.ceil(F.col("k") / block)
    dealt = placed.join(sizes, "cell").withColumn("block", F.shiftleft("cell", 31) + F.pmod(F.xxhash64("h", "rep"), parts))

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = unpacked(pdf)
        mean = x.mean(axis=0)
        far = float(np.sqrt(((x - mean) ** 2).sum(axis=1)).max())
        rep, n, each, path = pdf["rep"].to_numpy(), pdf["n"].to_numpy(), pdf["x"].to_list(), node_path(x)
        step = max(1, CHUNK // len(each[0]))
        parts = [slice(i, i + step) for i in range(0, len(pdf), step)]
        packed = {c: [v[p].tobytes() for p in parts] for c, v in (("rep", rep), ("n", n), ("path", path))}
        return pd.DataFrame({"block": key[0], "cell": pdf["cell"].iloc[0], **packed, "x": [b"".join(each[p]) for p in parts], "centre": [mean if p.start == 0 else None for p in parts], "far": far})

    trees = kept(dealt.groupBy("block").applyInPandas(grow, "block long, cell long, rep binary, n binary, path binary, x binary, centre array<double>, far double"), "trees")
    levels.append(trees.where("centre IS NOT NULL").select(F.col("cell").alias("parent"), F.col("block").alias("child"), "centre", "far"))
    pairs = merged.sparkSession.createDataFrame([(ROOT, ROOT)], "a long, b long")
    for children in levels:
        pairs = kept(_descend(pairs, children, float(np.sqrt(2 - 2 * cosine))), "node-pairs")
    low, high = F.col("a").alias("low"), F.col("b").alias("high")
    partners = pairs.select(F.col("a").alias("block"), low, high).unionByName(pairs.where("a < b").select(F.col("b").alias("block"), low, high))
    # more tasks than pairs, so that few pairs share one by their hashes
    tasks = min(64 * merged.sparkSession.sparkContext.defaultParallelism, 3 * max(1, pairs.count()))
    shipped = trees.select("block", "rep", "n", "x", "path").join(partners, "block").repartition(tasks, "low", "high")

    def tree(pdf: pd.DataFrame) -> Tree:
        rep, n, path = (np.frombuffer(b"".join(pdf[c]), t) for c, t in (("rep", np.int64), ("n", np.int64), ("path", np.int32)))
        return Tree(rep, n, unit_rows(b"".join(pdf["x"]), len(rep)), path.reshape(len(rep), -1))

    def match(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        same = key[0] == key[1]
        a = tree(pdf[pdf["block"] == key[0]])
        b = a if same else tree(pdf[pdf["block"] == key[1]])
        count_a, count_b, edges = compare(a, b, same, cosine)
        ids, count = (a.ids, count_a + count_b) if same else (np.concatenate([a.ids, b.ids]), np.concatenate([count_a, count_b]))
        hit = count > 0
        return pd.DataFrame({"rep": np.concatenate([ids[hit], edges[:, 0]]), "links": np.concatenate([count[hit], np.zeros(len(edges), np.int64)]), "other": np.concatenate([ids[hit], edges[:, 1]])})

    out = kept(shipped.groupBy("low", "high").applyInPandas(match, "rep long, links long, other long"), "matches")
    return out.where("links > 0").select("rep", "links"), out.where("rep <> other").select(F.col("rep").alias("a"), F.col("other").alias("b"))


def _cells(points: DataFrame, block: int, unpacked: Callable[[pd.DataFrame], np.ndarray]) -> tuple[DataFrame, list[DataFrame]]:
    """Vectors with the lowest cell they are in, and for every level its cells (parent,
    child, centre, far). Cells of more than SPLIT blocks are split again, DEPTH times at
    most; others are their own only child."""
    placed, levels = kept(points.withColumn("cell", F.lit(ROOT).cast("long")), "placed"), []
    for _ in range(DEPTH):
        sizes = kept(placed.groupBy("cell").agg(F.count("*").alias("k"), F.ceil(F.count("*") / block).alias("parts")), "cells")
        if sizes.where(F.col("parts") > SPLIT).isEmpty():
            break
        placed, children = _split(placed, sizes, unpacked)
        if levels:
            calm = levels[-1].join(sizes.where(F.col("parts") <= SPLIT), F.col("child") == F.col("cell"))
            children = children.unionByName(calm.select(F.col("child").alias("parent"), "child", "centre", "far"))
        levels.append(kept(children, "level"))
    return placed, levels


def _split(placed: DataFrame, sizes: DataFrame, unpacked: Callable[[pd.DataFrame], np.ndarray]) -> tuple[DataFrame, DataFrame]:
    """Crowded cells' vectors go to the nearest of their cell's pivots."""
    rows = placed.join(sizes, "cell")
    crowded = rows.where(F.col("parts") > SPLIT)
    spot = F.pmod(F.xxhash64("h", "rep"), F.lit(1 << 30)) / (1 << 30)

    def choose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, most = unpacked(pdf.sort_values(["h", "rep"])), min(FAN, int(pdf["parts"].iloc[0]))
        radius, at = 2.0, np.zeros(1, np.int64)
        while len(at) < most and radius > 0.05:  # the coarser net stays whole, so that all are covered
            radius /= 2
            fine = net(x, radius)[0]
            at = np.concatenate([at, fine[~np.isin(fine, at)]])[:most]
        pivots = x[at]
        return pd.DataFrame({"parent": key[0], "child": key[0] * 2 * FAN + np.arange(len(pivots)), "centre": list(pivots), "parts": pdf["parts"].iloc[0]})

    pivots = kept(crowded.where(spot * F.col("k") < SAMPLE).groupBy("cell").applyInPandas(choose, "parent long, child long, centre array<double>, parts long"), "pivots")
    everywhere = pivots.select("parent", "child", "centre", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt"))

    def assign(own: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return pd.DataFrame({c: [] for c in ("rep", "n", "h", "x", "cell", "far")})
        centres, ids = np.stack(near["centre"].to_numpy()), near["child"].to_numpy()
        x = unpacked(own)
        cell = distances(x, centres).argmin(axis=1)
        far = np.sqrt(((x - centres[cell]) ** 2).sum(axis=1))
        return pd.DataFrame({"rep": own["rep"], "n": own["n"], "h": own["h"], "x": own["x"], "cell": ids[cell], "far": far})

    dealt = crowded.select("rep", "n", "h", "x", "cell", F.pmod("h", "parts").alias("salt"))
    out = kept(dealt.groupBy("cell", "salt").cogroup(everywhere.groupBy("parent", "salt")).applyInPandas(assign, f"{POINTS}, cell long, far double"), "split")
    children = pivots.drop("parts").join(out.groupBy("cell").agg(F.max("far").alias("far")), F.col("child") == F.col("cell")).drop("cell")
    return out.drop("far").unionByName(rows.where(F.col("parts") <= SPLIT).select(*placed.columns)), children


def _descend(pairs: DataFrame, children: DataFrame, reach: float) -> DataFrame:
    """Pairs of nodes whose covering radii let a pair of vectors be near, one level below
    ``pairs``: a pair's children meet each other only."""
    of = [children.select(F.col("parent").alias(s), F.col("child").alias(f"{s}_"), F.col("centre").alias(f"{s}x"), F.col("far").alias(f"{s}f")) for s in "ab"]
    met = pairs.join(of[0], "a").join(of[1], "b").where("a <> b OR a_ <= b_")
    gap = F.sqrt(F.aggregate(F.zip_with("ax", "bx", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, t: s + t))
    return met.where(gap <= F.col("af") + F.col("bf") + reach + SLACK).select(F.least("a_", "b_").alias("a"), F.greatest("a_", "b_").alias("b"))
