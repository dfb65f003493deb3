"""Quality by co-training a text view and a metadata view.

Both views are logistic regressions fitted on a bounded sample of labelled documents.
Over some rounds each view labels the documents of a bounded unlabelled pool that it is
surest of, and the other learns from them. Each view is calibrated on labelled documents
that neither was fitted on; their log odds add up, the prior counted once. Scoring reads
every document once, where it lies, and takes whole texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, trimmed

#: Documents with labels, and without, that fitting uses at most.
LABELLED, POOL = 12_000, 12_000
ROUNDS, EXCHANGE, SURE = 4, 0.05, 0.97
#: Probability of good quality below which a document is rejected.
KEEP = 0.4
WORD_BUCKETS, SOURCE_BUCKETS, LANG_BUCKETS = 128, 32, 16
#: Distinct words whose features a worker holds.
HELD = 200_000

WORD_FEATURES = ("one", "chars", "letters", "upper", "digits", "signs", "capital", "plain", "ends in signs", "signs only", "single", "beyond ascii")
TEXT_FEATURES = len(WORD_FEATURES) + 6 + WORD_BUCKETS
META_FEATURES = SOURCE_BUCKETS + LANG_BUCKETS + 3


def word_features(word: bytes) -> list[float]:
    text = word.decode("utf-8", "replace")
    letters = sum(c.isalpha() for c in text)
    digits = sum(c.isdigit() for c in text)
    signs = len(text) - letters - digits
    bare = text[:-1] if text[-1:] in ".,;:!?" else text
    return [1, len(text), letters, sum(c.isupper() for c in text), digits, signs, text[:1].isupper(), bare.isalpha(), signs >= 2 and not text[-2:].isalnum(), letters + digits == 0, len(text) == 1, sum(c > "\x7f" for c in text)]


class TextView(dict):
    """Features of whole texts from sums over words; a word's features are remembered."""

    def __init__(self):
        self.rows, self.bucket, self.used = np.zeros((1024, len(WORD_FEATURES))), np.zeros(1024, np.int64), 0

    def __missing__(self, word: bytes) -> int:
        if self.used == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.bucket = np.concatenate([self.bucket, np.zeros_like(self.bucket)])
        self.rows[self.used] = word_features(word)
        self.bucket[self.used] = zlib.crc32(word.lower()) % WORD_BUCKETS
        self[word] = self.used
        self.used += 1
        return self.used - 1

    def features(self, text: bytes | None) -> np.ndarray:
        """Null, empty and blank texts have zeros only."""
        out = np.zeros(TEXT_FEATURES)
        words = text.split() if text else []
        if not words:
            return out
        if self.used > HELD:
            self.clear()
            self.used = 0
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        k, n = len(WORD_FEATURES), len(words)
        sums = np.zeros(k)
        for i in range(0, n, 1 << 17):
            sums += self.rows[at[i : i + (1 << 17)]].sum(axis=0)
        lines = text.split(b"\n")
        out[:k] = sums / n
        out[0] = np.log1p(n)
        out[2:7] = sums[2:7] / max(1.0, sums[1])
        distinct = len(set(words))
        out[k] = np.log1p(distinct) / np.log1p(n)
        out[k + 1] = distinct / n
        out[k + 2] = len(set(zip(words, words[1:], strict=False))) / max(1, n - 1)
        out[k + 3] = len(set(lines)) / len(lines)
        out[k + 4] = np.log1p(n / len(lines))
        out[k + 5] = text.count(b"|") / n
        out[k + 6 :] = np.sqrt(np.bincount(self.bucket[at], minlength=WORD_BUCKETS) / n)
        return out


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    """Nulls have buckets of their own."""
    out = np.zeros(META_FEATURES)
    out[0 if source is None else 1 + zlib.crc32(source.encode()) % (SOURCE_BUCKETS - 1)] = 1
    out[SOURCE_BUCKETS + (0 if lang is None else 1 + zlib.crc32(lang.encode()) % (LANG_BUCKETS - 1))] = 1
    size = np.log1p(max(0, n_chars or 0))
    out[-3:] = size, size * size / 10, n_chars is None
    return out


@dataclass
class View:
    """Standardised logistic regression, then a calibrated slope and offset."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights[1:] + self.weights[0]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.raw(x) + self.offset


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 3.0, steps: int = 12) -> View:
    """Newton's method with an L2 penalty on all but the intercept."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = np.concatenate([np.ones((len(x), 1)), (x - mean) / scale], axis=1)
    w, ridge = np.zeros(z.shape[1]), np.full(z.shape[1], penalty)
    ridge[0] = 1e-3
    for _ in range(steps):
        p = _sigmoid(z @ w)
        step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-5:
            break
    return View(mean, scale, w)


def calibrate(view: View, x: np.ndarray, y: np.ndarray) -> None:
    """Platt scaling with smoothed targets; a view that tells nothing gets slope 0."""
    good, bad = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    line = fit(view.raw(x)[:, None], t, penalty=1.0)
    slope = float(line.weights[1] / line.scale[0])
    if slope <= 0:
        slope, offset = 0.0, float(np.log((good + 1) / (bad + 1)))
    else:
        offset = float(line.weights[0] - line.weights[1] * line.mean[0] / line.scale[0])
    view.slope, view.offset = slope, offset


@dataclass
class CoModel:
    text: View
    meta: View
    prior: float

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) of both views combined, of the text view, of the metadata view."""
        a, b = self.text.logit(text), self.meta.logit(meta)
        return _sigmoid(a + b - self.prior), _sigmoid(a), _sigmoid(b)


def cotrain(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray, rounds: int = ROUNDS) -> CoModel | None:
    """``y``: 1 good, 0 bad. Every fourth labelled document is for calibration. None if
    either class has under 8 documents."""
    if min(y.sum(), len(y) - y.sum()) < 8:
        return None
    held = np.arange(len(y)) % 4 == 3
    extra: dict[str, dict[int, float]] = {"text": {}, "meta": {}}  # pool row -> label that the other view gave

    def learn(name: str, x: np.ndarray, pool: np.ndarray) -> View:
        own = extra[name]
        rows = np.fromiter(own, np.int64, len(own))
        view = fit(np.concatenate([x[~held], pool[rows]]), np.concatenate([y[~held], np.fromiter(own.values(), float, len(own))]))
        calibrate(view, x[held], y[held])
        return view

    for turn in range(rounds + 1):
        a, b = learn("text", text, pool_text), learn("meta", meta, pool_meta)
        if turn == rounds or not len(pool_text):
            break
        for view, pool, other in ((a, pool_text, "meta"), (b, pool_meta, "text")):
            p = _sigmoid(view.logit(pool))
            most = max(1, int(EXCHANGE * len(p)))
            for label, rank in ((1.0, -p), (0.0, p)):
                order = np.argsort(rank, kind="stable")[:most]
                for i in order[(p[order] >= SURE) if label else (p[order] <= 1 - SURE)]:
                    extra[other].setdefault(int(i), label)
    return CoModel(a, b, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long"))


def _matrices(view: TextView, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    text = [view.features(t.as_py()) for t in b.column("text").cast(pa.large_binary())]
    meta = [meta_features(*r) for r in zip(*(b.column(c).to_pylist() for c in ("source", "lang", "n_chars")), strict=True)]
    return np.array(text).reshape(-1, TEXT_FEATURES), np.array(meta).reshape(-1, META_FEATURES)


def sample_features(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> tuple:
    """Features of the ``labelled`` labelled and ``pool`` unlabelled documents of smallest
    id hash: (text, meta, y, pool_text, pool_meta). Of repeated labels the worst counts,
    of rows that repeat a doc_id one, so that no more than the two bounds are gathered."""
    marks = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("y"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct().join(marks, "doc_id", "left")
    rank = F.xxhash64("doc_id")
    some = [ids.where(c).orderBy(rank, "doc_id").limit(n) for c, n in (("y IS NOT NULL", labelled), ("y IS NULL", pool))]
    chosen = some[0].unionByName(some[1]).select(F.col("doc_id").alias("id"), "y")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        view = TextView()
        for b in it:
            text, meta = _matrices(view, b)
            data = [np.concatenate(r).astype("<f4").tobytes() for r in zip(text, meta, strict=True)]
            yield pa.record_batch([b.column("doc_id"), b.column("y"), pa.array(data, pa.binary())], names=["doc_id", "y", "data"])

    rows = _rows(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("doc_id", "text", "source", "lang", "n_chars", F.col("y").cast("double"))
    once = rows.mapInArrow(lambda it: trimmed(batches(it)), "doc_id long, y double, data binary").groupBy("doc_id").agg(F.min("y").alias("y"), F.min("data").alias("data"))
    got = sorted(((r.doc_id, bytes(r.data), r.y) for r in once.toLocalIterator()), key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0], r[1]))
    x = np.frombuffer(b"".join(r[1] for r in got), "<f4").reshape(-1, TEXT_FEATURES + META_FEATURES).astype(float)
    y = np.array([np.nan if r[2] is None else float(r[2] > 0) for r in got])
    known = ~np.isnan(y)
    text, meta = x[:, :TEXT_FEATURES], x[:, TEXT_FEATURES:]
    return text[known], meta[known], y[known], text[~known], meta[~known]


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> CoModel | None:
    return cotrain(*sample_features(docs, labels, labelled, pool))


def score(docs: DataFrame, labels: DataFrame, keep: float = KEEP, labelled: int = LABELLED, pool: int = POOL) -> DataFrame:
    """(doc_id, score, text_score, meta_score, keep) of every row of ``docs``.

    ``score`` is the probability of good quality, from whole texts and (source, lang,
    n_chars). Null and empty texts and null metadata are scored as such; repeated rows
    count each. Without at least 8 labelled documents of either class nothing is known:
    every score is 0.5 and all documents are kept. Other columns are not read. Fitting
    takes at most ``labelled`` labelled documents and ``pool`` others that the views label
    for each other, whatever the table's size; all documents are scored.
    """
    model = train(docs, labels, labelled, pool)
    rows = _rows(docs)
    if model is None:
        half = [F.lit(0.5).alias(c) for c in ("score", "text_score", "meta_score")]
        return rows.select("doc_id", *half, F.lit(True).alias("keep"))
    return rows.mapInArrow(_scorer(model, keep, ["doc_id"]), "doc_id long, score double, text_score double, meta_score double, keep boolean")


def _scorer(model: CoModel, keep: float, carried: list[str]):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        view = TextView()
        for b in it:
            if b.num_rows:
                both, text, meta = model.scores(*_matrices(view, b))
                yield pa.record_batch([*(b.column(c) for c in carried), pa.array(both), pa.array(text), pa.array(meta), pa.array(both >= keep)], names=[*carried, "score", "text_score", "meta_score", "keep"])

    return batches


def keep_good(docs: DataFrame, labels: DataFrame, keep: float = KEEP, labelled: int = LABELLED, pool: int = POOL) -> DataFrame:
    """``docs`` without the rows that ``score`` would not keep, columns as they are."""
    model = train(docs, labels, labelled, pool)
    if model is None:
        return docs
    types, own = dict(docs.dtypes), {}
    for name, kind in (("text", "string"), ("source", "string"), ("lang", "string"), ("n_chars", "bigint")):
        own[name] = name if types[name] == kind else free_name(docs, f"_{name}")
    rows = docs.withColumns({new: F.col(name).cast("bigint" if name == "n_chars" else "string") for name, new in own.items() if new != name})

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        view = TextView()
        for b in it:
            if b.num_rows:
                read = pa.record_batch([b.column(new) for new in own.values()], names=list(own))
                yield b.filter(pa.array(model.scores(*_matrices(view, read))[0] >= keep))

    return rows.mapInArrow(lambda it: trimmed(batches(it)), rows.schema).select(*docs.columns)
