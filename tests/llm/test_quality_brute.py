"""Co-training from plain Python: own features, own descent, own calibration."""

import math
import zlib

import numpy as np

from vellumspark.llm import quality

SF = "/root/testdata/sf0.001"


def text_row(text):
    words = (text or "").encode().split()
    if not words:
        return [0.0] * quality.TEXT_FEATURES
    own = [w.decode() for w in words]
    n, chars = len(own), sum(map(len, own))
    count = lambda f: sum(f(c) for w in own for c in w)
    letters, upper, digits = count(str.isalpha), count(str.isupper), count(str.isdigit)
    signs = [sum(not c.isalpha() and not c.isdigit() for c in w) for w in own]
    bare = [w[:-1] if w[-1] in ".,;:!?" else w for w in own]
    lines = text.split("\n")
    out = [math.log1p(n), chars / n]
    out += [x / chars for x in (letters, upper, digits, sum(signs), sum(w[0].isupper() for w in own))]
    out += [sum(map(str.isalpha, bare)) / n, sum(k >= 2 and not w[-2:].isalnum() for k, w in zip(signs, own, strict=True)) / n]
    out += [sum(not any(c.isalpha() or c.isdigit() for c in w) for w in own) / n, sum(len(w) == 1 for w in own) / n, count(lambda c: c > "\x7f") / n]
    out += [math.log1p(len(set(own))) / math.log1p(n), len(set(own)) / n, len(set(zip(own, own[1:], strict=False))) / max(1, n - 1)]
    out += [len(set(lines)) / len(lines), math.log1p(n / len(lines)), text.count("|") / n]
    bins = [0] * quality.WORD_BUCKETS
    for w in words:
        bins[zlib.crc32(w.lower()) % quality.WORD_BUCKETS] += 1
    return out + [math.sqrt(b / n) for b in bins]


def meta_row(source, lang, n_chars):
    row = [0.0] * (quality.SOURCE_BUCKETS + quality.LANG_BUCKETS)
    row[0 if source is None else 1 + zlib.crc32(source.encode()) % (quality.SOURCE_BUCKETS - 1)] = 1
    row[quality.SOURCE_BUCKETS + (0 if lang is None else 1 + zlib.crc32(lang.encode()) % (quality.LANG_BUCKETS - 1))] = 1
    size = math.log1p(max(0, n_chars or 0))
    return [*row, size, size * size / 10, float(n_chars is None)]


def descend(x, y, penalty):
    """A standardised penalised logistic regression by damped descent on the loss."""
    x = np.asarray(x, float)
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    ridge = np.full(z.shape[1], penalty)
    ridge[0] = 1e-3
    loss = lambda w: np.sum(np.logaddexp(0, z @ w) - y * (z @ w)) + 0.5 * np.sum(ridge * w * w)
    w = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        gradient = z.T @ (p - y) + ridge * w
        step = np.linalg.lstsq(z.T * (p * (1 - p)) @ z + np.diag(ridge), gradient, rcond=None)[0]
        size = 1.0
        while loss(w - size * step) > loss(w) - 1e-4 * size * gradient @ step and size > 1e-6:
            size /= 2
        w = w - size * step
    return lambda q: ((np.asarray(q, float) - mean) / scale) @ w[1:] + w[0]


def logit(raw, x, y):
    good, bad = y.sum(), (1 - y).sum()
    target = np.array([(good + 1) / (good + 2) if v else 1 / (bad + 2) for v in y])
    line = descend(raw(x)[:, None], target, 1.0)
    at = line(np.array([[0.0], [1.0]]))
    if at[1] <= at[0]:
        return lambda q: np.full(len(q), math.log((good + 1) / (bad + 1)))
    return lambda q: (at[1] - at[0]) * raw(q) + at[0]


def brute(rows, labels):
    worst = {}
    for r in labels:
        if r.quality is not None:
            worst[r.doc_id] = min(r.quality, worst.get(r.doc_id, 1))
    order = sorted(rows, key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id))
    text, meta = {r.doc_id: text_row(r.text) for r in rows}, {r.doc_id: meta_row(r.source, r.lang, r.n_chars) for r in rows}
    known, pool = [r.doc_id for r in order if r.doc_id in worst], [r.doc_id for r in order if r.doc_id not in worst]
    fit_on, held = [d for i, d in enumerate(known) if i % 4 != 3], known[3::4]
    taught = {"text": {}, "meta": {}}
    views = {"text": text, "meta": meta}
    take = lambda view, ids: np.array([views[view][d] for d in ids])
    for turn in range(quality.ROUNDS + 1):
        now = {}
        for v in views:
            ids = [*fit_on, *taught[v]]
            y = np.array([*(float(worst[d] > 0) for d in fit_on), *taught[v].values()])
            now[v] = logit(descend(take(v, ids), y, 3.0), take(v, held), np.array([float(worst[d] > 0) for d in held]))
        if turn == quality.ROUNDS:
            break
        most = max(1, int(quality.EXCHANGE * len(pool)))
        for v, other in (("text", "meta"), ("meta", "text")):
            p = 1 / (1 + np.exp(-now[v](take(v, pool))))
            for label in (1.0, 0.0):
                for i in sorted(range(len(pool)), key=lambda i: -p[i] if label else p[i])[:most]:
                    if p[i] >= quality.SURE if label else p[i] <= 1 - quality.SURE:
                        taught[other].setdefault(pool[i], label)
    prior = math.log((sum(worst[d] > 0 for d in known) + 1) / (sum(worst[d] <= 0 for d in known) + 1))
    both = now["text"](take("text", [r.doc_id for r in rows])) + now["meta"](take("meta", [r.doc_id for r in rows])) - prior
    return {r.doc_id: 1 / (1 + math.exp(-z)) for r, z in zip(rows, both, strict=True)}


def test_scores_are_those_of_plain_cotraining(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    want = brute(docs.collect(), labels.collect())
    got = {r.doc_id: r for r in quality.score(docs, labels).collect()}
    assert set(got) == set(want)
    assert all(abs(got[d].score - p) < 0.02 for d, p in want.items())
    assert all(got[d].keep == (p >= quality.KEEP) for d, p in want.items() if abs(p - quality.KEEP) > 0.02)
    assert len({r.keep for r in got.values()}) == 2
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert kept == {d for d, r in got.items() if r.keep}


def test_rows_that_repeat_an_id_are_gathered_once(spark):
    docs = spark.createDataFrame([(i % 40, f"text {i}", "en", "s", 1) for i in range(400)], "doc_id int, text string, lang string, source string, n_chars int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    text, _, y, pool, _ = quality.sample_features(docs, labels, labelled=20, pool=5)
    assert len(text) == len(y) == 20 and len(pool) == 5
    assert quality.keep_good(docs, labels).schema == docs.schema
