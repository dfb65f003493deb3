"""Approximate nearest neighbours: inverted lists, product-quantised residuals, exact
reranking.

Coarse centroids and the codebooks of residuals are learnt from a bounded sample; every
vector is indexed. A query visits the lists of its nearest centroids: as many as the
nearest rows of the sample and of a sample of the queries need, more if these hold too
few vectors, and if it lies farther from all centroids than the sample does, all within
two residuals of the nearest. A list is dealt into blocks of bounded size, so a crowded
list is many tasks; each block ranks its vectors for its queries by asymmetric distance
tables, reranks the best exactly, then every other vector that its code's own error
leaves a chance, and returns as many as are asked for, so the shares of all blocks hold
the best of all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept

TOP = 10
#: Vectors that the index is fitted on, at most, and so lists; lists per square root of
#: the vectors.
SAMPLE, LISTS = 16_384, 1.0
#: Of the sample, the share whose distance from its centroid is usual.
USUAL = 0.95
#: Distances that are computed at once, and queries of a list that meet one of its blocks.
CELLS, QUERIES = 1 << 22, 20_000
#: Of the sample's true nearest, the share that lies in the lists a query visits; sample
#: rows, and queries, that are asked for it; lists that are visited at least.
REACHED, ASKED, LEAST_PROBES = 0.97, 256, 8
#: Parts of a residual, codes of a part, vectors of a block, first exact distances of a block.
PARTS, CODES, BLOCK, RERANK = 16, 64, 4096, 150


def usable(v: Column) -> Column:
    return v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(v, lambda c: c != 0)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position and squared distance of each row's nearest centre."""
    at, far = np.zeros(len(x), np.int64), np.zeros(len(x))
    step = max(1, CELLS // len(centres))
    for i in range(0, len(x), step):
        d = squared(x[i : i + step], centres)
        at[i : i + step] = d.argmin(axis=1)
        far[i : i + step] = d[np.arange(len(d)), at[i : i + step]]
    return at, far


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """Lloyd's rounds from distinct rows; a centre without rows stays."""
    distinct = np.unique(x, axis=0)
    centres = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        own = nearest(x, centres)[0]
        n = np.bincount(own, minlength=len(centres))
        order = np.argsort(own, kind="stable")
        starts = (np.cumsum(n) - n)[n > 0]
        centres[n > 0] = np.add.reduceat(x[order], starts, axis=0) / n[n > 0, None]
    return centres


class Index:
    """Coarse centroids and codebooks for one dimension; ``queries`` are a sample of them
    (rows of both by id)."""

    def __init__(self, ids: np.ndarray, sample: np.ndarray, total: int, query_ids: np.ndarray, queries: np.ndarray):
        self.centroids = kmeans(sample, max(1, int(LISTS * np.sqrt(total))))
        own, far = nearest(sample, self.centroids)
        rest = sample - self.centroids[own]
        self.usual = float(np.sqrt(np.quantile(far, USUAL))) if len(far) else 0.0
        self.cuts = np.linspace(0, sample.shape[1], min(PARTS, sample.shape[1]) + 1).astype(int)
        self.books = [kmeans(rest[:, i:j], CODES, 6) for i, j in zip(self.cuts, self.cuts[1:], strict=False)]
        self.probes = min(len(self.centroids), LEAST_PROBES)
        some = np.linspace(0, len(sample) - 1, min(ASKED, len(sample))).astype(int)
        for asked, ask in ((ids[some], sample[some]), (query_ids, queries)):
            self.probes = min(len(self.centroids), max(self.probes, self._needed(ids, sample, own, asked, ask)))

    def _needed(self, ids: np.ndarray, sample: np.ndarray, own: np.ndarray, asked: np.ndarray, ask: np.ndarray) -> int:
        """Lists to visit, from the nearest rows of the sample. Of all vectors the nearest
        are nearer still, so that they lie in the first lists rather more often."""
        d = squared(ask, sample)
        d[asked[:, None] == ids[None]] = np.inf
        near = np.argsort(d, axis=1, kind="stable")[:, : min(TOP, len(sample) - 1)]
        place = np.argsort(np.argsort(squared(ask, self.centroids), axis=1, kind="stable"), axis=1)
        ranks = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
        return int(ranks[int(np.ceil(REACHED * len(ranks))) - 1]) + 1 if len(ranks) else 1

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = nearest(x, self.centroids)[0]
        rest = x - self.centroids[cell]
        code = [nearest(rest[:, i:j], book)[0] for i, j, book in zip(self.cuts, self.cuts[1:], self.books, strict=False)]
        return cell, np.stack(code, axis=1).astype(np.uint8)

    def visits(self, q: np.ndarray, sizes: np.ndarray, enough: int) -> list[np.ndarray]:
        """Each query's lists, which hold ``enough`` vectors if all do; ``sizes`` are the
        lists'."""
        d = np.sqrt(squared(q, self.centroids))
        order = np.argsort(d, axis=1, kind="stable")
        d = np.take_along_axis(d, order, axis=1)
        held = (np.cumsum(sizes[order], axis=1) < enough).sum(axis=1) + 1
        near = np.where(d[:, 0] > self.usual, (d <= d[:, :1] + 2 * self.usual).sum(axis=1), 0)
        most = np.maximum(self.probes, np.maximum(held, near))
        return [row[:k][sizes[row[:k]] > 0] for row, k in zip(order, most.tolist(), strict=True)]

    def errors(self, x: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Distances of vectors of a list from what their codes stand for."""
        return np.sqrt(((x - self.centroids[cell] - np.concatenate([book[codes[:, k]] for k, book in enumerate(self.books)], axis=1)) ** 2).sum(axis=1))

    def nearest_of(self, q: np.ndarray, own: np.ndarray, cell: int, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, top: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Each query's ``top`` nearest of a block of a list, as ids and distances; ``own``
        are the queries' ids. A vector is as near as its code but for its code's error, so
        those that may be among the nearest are all measured."""
        guess = self.estimates(q, cell, codes)
        mine = own[:, None] == ids[None]
        guess[mine] = np.inf
        errors = self.errors(x, cell, codes)
        first = min(len(x), RERANK + 1)
        best = np.argpartition(guess, first - 1, axis=1)[:, :first]
        d = ((x[best] - q[:, None]) ** 2).sum(axis=2)
        d[np.take_along_axis(mine, best, axis=1)] = np.inf
        bound = np.sqrt(np.partition(d, top - 1, axis=1)[:, top - 1]) if first >= top else np.full(len(q), np.inf)
        slack = 1e-6 * (np.sqrt(((q - self.centroids[cell]) ** 2).sum(axis=1))[:, None] + errors[None])
        chance = ~mine & (np.sqrt(guess) <= bound[:, None] + errors[None] + slack)
        some = np.flatnonzero(chance.any(axis=0))
        got = []
        if not len(some):
            return [(ids[:0], np.zeros(0))] * len(q)
        rest, x, ids = q - self.centroids[cell], x[some], ids[some]
        near = np.where(chance[:, some], squared(rest, x - self.centroids[cell]), np.inf)
        size = (rest**2).sum(axis=1) + ((x - self.centroids[cell]) ** 2).sum(axis=1).max()
        for i in range(len(q)):
            last = np.partition(near[i], top - 1)[top - 1] if len(some) > top else np.inf
            left = np.flatnonzero((near[i] <= last + 1e-11 * size[i]) & np.isfinite(near[i]))
            d = np.sqrt(((x[left] - q[i]) ** 2).sum(axis=1))
            order = np.lexsort((ids[left], d))[:top]
            got.append((ids[left][order], d[order]))
        return got

    def estimates(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries to coded vectors of a list: table lookups."""
        rest = q - self.centroids[cell]
        out = np.zeros((len(q), len(codes)))
        for k, (i, j, book) in enumerate(zip(self.cuts, self.cuts[1:], self.books, strict=False)):
            out += squared(rest[:, i:j], book)[:, codes[:, k]]
        return out


def _unpack(column: pd.Series, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def search(vectors: DataFrame, every: int = 100, top: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` rows nearest to each query.

    Queries are the rows of (vec_id, embedding) whose vec_id is divisible by ``every``,
    candidates all other rows; score is the Euclidean distance of the original vectors
    in double precision; nearest first, ties to the smaller vec_id. Vectors that are
    null, empty, zero or hold null, NaN or infinite components take no part, nor do rows
    without a vec_id; queries find vectors of their own length. Rows repeating a vec_id
    are one row each. Fewer candidates than ``top`` are all found. An empty table gives
    none.
    """
    rows = kept(vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v"))), "vectors")
    spark = vectors.sparkSession
    out = spark.createDataFrame([], "query_id long, vec_id long, score double")
    for d, total in sorted((r[0], r[1]) for r in rows.groupBy(F.size("v")).count().collect()):
        out = out.unionByName(_dimension(rows.where(F.size("v") == d), total, every, top))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _dimension(rows: DataFrame, total: int, every: int, top: int) -> DataFrame:
    spark = rows.sparkSession

    def some(of: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
        taken = list(of.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).toLocalIterator())
        return np.array([r.vec_id for r in taken], np.int64), np.array([r.v for r in taken])

    ids, sample = some(rows, SAMPLE)
    query_ids, queries = some(rows.where(F.col("vec_id") % every == 0), ASKED)
    index = Index(ids, sample, total, query_ids, queries.reshape(-1, sample.shape[1]))
    shared = spark.sparkContext.broadcast(index)

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                x = np.array(b.column("v").flatten()).reshape(b.num_rows, -1)
                cell, code = shared.value.encode(x)
                yield pa.record_batch([b.column("vec_id"), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary()), pa.array([v.tobytes() for v in x], pa.binary())], names=["vec_id", "cell", "code", "x"])

    coded = kept(rows.mapInArrow(encode, "vec_id long, cell int, code binary, x binary"), "coded")
    sizes = np.zeros(len(index.centroids), np.int64)
    for r in coded.groupBy("cell").agg(F.count("*").alias("k")).collect():  # one row a list
        sizes[r.cell] = r.k
    parts = -(-sizes // BLOCK)
    lists = F.broadcast(spark.createDataFrame([(i, k) for i, k in enumerate(parts.tolist()) if k], "cell int, parts int"))  # SAMPLE rows at most
    dealt = coded.join(lists, "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))

    def visit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, min(1024, CELLS // len(sizes)))
        for b in it:
            if b.num_rows:
                x = np.array(b.column("v").flatten()).reshape(b.num_rows, -1)
                for at in range(0, len(x), step):
                    seen = [(i, c, part) for i, cells in enumerate(shared.value.visits(x[at : at + step], sizes, 4 * top), at) for c in cells.tolist() for part in range(parts[c])]
                    which, cell, part = zip(*seen, strict=True)
                    yield pa.record_batch([b.column("vec_id").take(pa.array(which)), pa.array(cell, pa.int32()), pa.array(part, pa.int32()), pa.array([x[i].tobytes() for i in which], pa.binary())], names=["query_id", "cell", "part", "q"])

    asked = kept(rows.where(F.col("vec_id") % every == 0).mapInArrow(visit, "query_id long, cell int, part int, q binary"), "asked")
    slots = asked.groupBy("cell", "part").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("slots"))
    asked = asked.join(slots, ["cell", "part"]).withColumn("slot", F.pmod(F.xxhash64("query_id"), F.col("slots")).cast("int"))
    dealt = dealt.join(slots, ["cell", "part"]).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))

    def rank(key: tuple, block: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(block) or not len(ask):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        block = block.sort_values("vec_id", kind="stable")
        ids, x, codes = block["vec_id"].to_numpy(), _unpack(block["x"], float), _unpack(block["code"], np.uint8)
        got = []
        for at in range(0, len(ask), 128):
            part = ask.iloc[at : at + 128]
            q = _unpack(part["q"], float)
            own = part["query_id"].to_numpy()
            for query, (found, d) in zip(own, shared.value.nearest_of(q, own, int(key[0]), ids, x, codes, top), strict=True):
                got.append((np.full(len(found), query), found, d))
        q, v, d = (np.concatenate(c) for c in zip(*got, strict=True))
        return pd.DataFrame({"query_id": q, "vec_id": v, "score": d})

    by = ["cell", "part", "slot"]
    dealt, asked = dealt.select(*by, "vec_id", "code", "x"), asked.select(*by, "query_id", "q")
    found = dealt.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(rank, "query_id long, vec_id long, score double")
    return kept(found, "found")
