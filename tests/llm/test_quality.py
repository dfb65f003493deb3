import random

import numpy as np

from vellumspark.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, y int"
LABELS = "doc_id long, quality int, toxic int"


def corpus(n=240):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(80))
        if not good:
            text = " ".join(w + "$%" for w in text.split()[:20]) * 3
        rows.append((i, text, "en", "good" if good ^ (rng.random() < 0.1) else "bad", len(text), "s", 1))
        labels.append((i, int(good), None))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    odd = [(1000, None, None, None, None, None, None), (1001, "", "", "", 0, "", 0), (None, rows[0][1], "en", "good", 5, "", 0), (1002, rows[0][1] * 300, "en", "good", 5, "", 0), (1002, rows[0][1] * 300, "en", "good", 5, "", 0)]
    known = [r for r in labels if r[0] % 2] + [(1, None, 1), (None, 0, 0), (7, labels[7][1], 0)]
    docs, marks = spark.createDataFrame(rows + odd, SCHEMA), spark.createDataFrame(known, LABELS)
    got = quality.score(docs, marks).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.keep == (r.score >= quality.KEEP) for r in got)
    by = {r.doc_id: r.keep for r in got}
    assert np.mean([by[i] == bool(q) for i, q, _ in labels if i % 2 == 0]) > 0.97
    left = quality.keep_good(docs, marks)
    assert left.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in left.collect()))) == sorted(str(r.doc_id) for r in got if r.keep)


def test_without_labels_all_stay(spark):
    rows, labels = corpus(30)
    docs = spark.createDataFrame(rows, SCHEMA)
    for known in ([], [r for r in labels if r[1] == 1]):
        marks = spark.createDataFrame(known, LABELS)
        assert all(r.keep and r.score == 0.5 for r in quality.score(docs, marks).collect())
        assert quality.keep_good(docs, marks).count() == 30
    assert quality.score(spark.createDataFrame([], SCHEMA), spark.createDataFrame(labels, LABELS)).collect() == []


def test_views_teach_each_other():
    rng = np.random.default_rng(2)
    y = (rng.random(2400) < 0.5).astype(float)
    text = np.stack([y * 6 - 3 + rng.normal(size=2400), rng.normal(size=2400)], axis=1)
    meta = np.stack([y * 3 - 1.5 + rng.normal(size=2400)] + [rng.normal(size=2400) for _ in range(60)], axis=1)
    few = slice(0, 160)
    alone = quality.cotrain(text[few], meta[few], y[few], text[:0], meta[:0])
    taught = quality.cotrain(text[few], meta[few], y[few], text[160:1400], meta[160:1400])
    right = [np.mean((m.meta.raw(meta[1400:]) > 0) == y[1400:]) for m in (alone, taught)]
    assert right[1] > right[0] and right[1] > 0.8
    both = taught.scores(text[1400:], meta[1400:])[0]
    assert np.mean((both > 0.5) == y[1400:]) > 0.98


def test_a_view_that_tells_nothing_is_calibrated_to_the_prior():
    rng = np.random.default_rng(3)
    y = (rng.random(400) < 0.8).astype(float)
    view = quality.fit(-y[:, None] + rng.normal(size=(400, 1)), 1 - y)
    view.weights = -view.weights
    quality.calibrate(view, -y[:, None], y)
    view.weights[1] = -abs(view.weights[1])
    x = rng.normal(size=(50, 1))
    if view.slope == 0:
        assert np.ptp(view.logit(x)) == 0
