import numpy as np
from pyspark.sql import functions as F

from vellumspark.llm import ann, embed_dedup

SCHEMA = "label string, vec_id long, embedding array<double>, score int, n int"


def vectors(seed, n, d, spread):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(max(2, n // 12), d))
    x = base[rng.integers(0, len(base), n)] + rng.normal(size=(n, d)) * rng.choice([0, spread, 3 * spread], n)[:, None]
    return (x * rng.choice([0.5, 1, 3], n)[:, None]).tolist()


def frame(spark, rows):
    return spark.createDataFrame([("l", i, v, 1, 2) for i, v in rows], SCHEMA)


ODD = [None, [], [0.0, 0.0, 0.0], [1.0, None, 0.0], [float("nan"), 1.0, 1.0], [float("inf"), 1.0, 1.0]]


def good(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute_links(rows):
    up = list(range(len(rows)))

    def root(i):
        return i if up[i] == i else root(up[i])

    n = [0] * len(rows)
    for i, (a, v) in enumerate(rows):
        for j, (b, w) in enumerate(rows[:i]):
            if a is not None and b is not None and good(v) and good(w) and len(v) == len(w) and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.9:
                n[i], n[j] = n[i] + 1, n[j] + 1
                up[root(i)] = root(j)
    low = {}
    for i, (a, _) in enumerate(rows):
        if a is not None:
            low[root(i)] = min(a, low.get(root(i), a))
    return sorted(((a is None, a or 0, n[i], low.get(root(i))) for i, (a, _) in enumerate(rows)), key=repr)


def test_links_against_all_pairs(spark):
    for d, spread, block in ((6, 0.05, 64), (24, 0.06, 8192)):
        rows = list(enumerate(vectors(d, 300, d, spread)))
        rows += [(1000 + i, v) for i, v in enumerate(ODD)] + [(None, rows[0][1]), (5, rows[5][1]), (2000, [1.0, 2.0, 3.0]), (2001, [2.0, 4.0, 6.0]), (2002, [-0.0, 0.0, 1.0]), (2003, [0.0, 0.0, 1.0])]
        got = embed_dedup.duplicates(frame(spark, rows), block=block).collect()
        assert sorted(((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id) for r in got), key=repr) == brute_links(rows)
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert sum(r.n_links for r in got) > 100


def test_cells_are_split_again(spark):
    """Blocks of twenty vectors: crowded cells have levels below them, others don't."""
    many = vectors(3, 40, 5, 0.05) + (np.ones((200, 5)) + np.random.default_rng(4).normal(size=(200, 5)) * 0.4).tolist()
    rows = list(enumerate(np.array(many, np.float32).astype(float).tolist()))
    whole = brute_links(rows)
    for kind in ("float", "double"):
        df = frame(spark, rows).withColumn("embedding", F.col("embedding").cast(f"array<{kind}>"))
        got = embed_dedup.duplicates(df, block=20).collect()
        assert sorted(((False, r.vec_id, r.n_links, r.component_id) for r in got), key=repr) == whole


def test_node_pairs_stay_few_on_clusters(spark):
    """Far clusters: of all pairs of blocks few are left, and no link is lost."""
    rng = np.random.default_rng(8)
    x = np.repeat(np.eye(24), 60, axis=0) + rng.normal(size=(1440, 24)) * 0.02
    got = embed_dedup.duplicates(frame(spark, list(enumerate(x.tolist()))), block=60)
    assert {(r.n_links, r.component_id == r.vec_id // 60 * 60) for r in got.collect()} == {(59, True)}
    points = spark.createDataFrame([(i, 1, hash((i, 7)), v.tobytes()) for i, v in enumerate(x)], embed_dedup.POINTS)
    placed, levels = embed_dedup._cells(points, 30, lambda pdf: embed_dedup.units(np.frombuffer(b"".join(pdf["x"])).reshape(len(pdf), -1)))
    pairs = spark.createDataFrame([(embed_dedup.ROOT, embed_dedup.ROOT)], "a long, b long")
    for children in levels:
        pairs = embed_dedup._descend(pairs, children, np.sqrt(0.2))
    cells = placed.select("cell").distinct().count()
    assert cells >= 24 and pairs.count() < cells * 4


def test_traversal_counts_whole_nodes():
    rng = np.random.default_rng(1)
    x = embed_dedup.units(np.concatenate([np.ones((400, 8)) + rng.normal(size=(400, 8)) * 0.01, rng.normal(size=(200, 8))]))
    n = rng.integers(1, 4, 600)
    ids = np.arange(600)
    t = embed_dedup.Tree(ids, n, x, embed_dedup.node_path(x))
    a, b, edges = embed_dedup.compare(t, t, True)
    near = t.x @ t.x.T >= 0.9
    np.fill_diagonal(near, False)
    assert (a + b == near @ t.n).all() and len(edges) < 600
    assert any(whole and len(p) for _, p, _, whole in embed_dedup.near_nodes(t, t, np.sqrt(0.2), True))


def test_large_tables_have_no_more_blocks(spark, monkeypatch):
    """Random vectors, for which bounds prune nothing: pairs of blocks don't grow with
    the square of the vectors, and no level is compared that saves nothing."""
    monkeypatch.setattr(embed_dedup, "BLOCK", 20)
    monkeypatch.setattr(embed_dedup, "PARTS", 4, raising=False)
    pairs, kept = [], embed_dedup.kept

    def counted(df, label):
        out = kept(df, label)
        if label == "node-pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(embed_dedup, "kept", counted)
    rng = np.random.default_rng(17)
    x = rng.normal(size=(600, 32))
    x[500:] = x[:100] + rng.normal(size=(100, 32)) * 0.2
    rows = list(enumerate(x.tolist()))
    got = embed_dedup.duplicates(frame(spark, rows)).collect()
    assert sorted(((False, r.vec_id, r.n_links, r.component_id) for r in got), key=repr) == brute_links(rows)
    assert sum(r.n_links for r in got) > 100 and pairs[-1] <= 8 * 9 // 2
    u = embed_dedup.units(rng.normal(size=(300, 64)))
    t = embed_dedup.Tree(np.arange(300), np.ones(300, int), u, embed_dedup.node_path(u))
    assert {k for k, p, _, _ in embed_dedup.near_nodes(t, t, np.sqrt(0.2), True) if len(p)} == {len(t.starts) - 1}
    assert embed_dedup.block_size(615_384, 64) * 16 >= 615_384 and embed_dedup.block_size(10**9, 64) == 2**16


def test_traversal_against_all_pairs():
    """Few and many dimensions, tight and loose groups, a threshold amid the distances."""
    rng = np.random.default_rng(18)
    base = rng.normal(size=(60, 48))
    for x, cosine in (
        (rng.normal(size=(700, 3)), 0.9),
        (rng.normal(size=(700, 8)) @ rng.normal(size=(8, 64)), 0.9),
        (base[rng.integers(0, 60, 700)] + rng.normal(size=(700, 48)) * rng.choice([0.02, 0.15, 0.4], 700)[:, None], 0.9),
        (rng.normal(size=(700, 300)) + 1, 0.5),
    ):
        x, n = embed_dedup.units(x), rng.integers(1, 4, 700)
        a, b = (embed_dedup.Tree(np.arange(700)[s], n[s], x[s], embed_dedup.node_path(x[s])) for s in (slice(0, 300), slice(300, None)))
        links = np.zeros(700, int)
        for p, q, same in ((a, a, True), (b, b, True), (a, b, False)):
            count_p, count_q, _ = embed_dedup.compare(p, q, same, cosine)
            links[p.ids] += count_p
            links[q.ids] += count_q
        near = x @ x.T >= cosine
        np.fill_diagonal(near, False)
        assert near.any() and (links == near @ n).all()


def brute_nearest(rows, every, top=10):
    out = []
    own = [(i, np.array(v)) for i, v in rows if i is not None and good(v)]
    for q, v in own:
        if q % every == 0:
            near = sorted((float(np.sqrt(((v - w) ** 2).sum())), i) for i, w in own if i != q and len(w) == len(v))[:top]
            out += [(q, k, i, d) for k, (d, i) in enumerate(near, 1)]
    return out


def test_nearest(spark):
    rows = list(enumerate(vectors(9, 1500, 16, 0.3)))
    rows += [(10_000 + i, v) for i, v in enumerate(ODD)] + [(None, rows[0][1])] + [(20_000 + i, rows[0][1]) for i in range(30)]
    got = ann.search(frame(spark, rows)).collect()
    want = brute_nearest(rows, 100)
    assert len(got) == len(want)
    by_id = {i: v for i, v in rows}
    for r in got:
        assert abs(r.score - np.sqrt(((np.array(by_id[r.query_id]) - np.array(by_id[r.vec_id])) ** 2).sum())) < 1e-12
    assert len({(r.query_id, r.vec_id) for r in got} & {(q, i) for q, _, i, _ in want}) >= 0.9 * len(want)
    order = sorted((r.query_id, r.rank, r.score, r.vec_id) for r in got)
    assert order == sorted(order, key=lambda r: (r[0], r[2], r[3]))


def test_few_and_none(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None)]
    assert sorted((r.query_id, r.rank, r.vec_id) for r in ann.search(frame(spark, rows)).collect()) == [(0, 1, 1), (0, 2, 2)]
    assert ann.search(frame(spark, [])).collect() == []
    assert embed_dedup.duplicates(frame(spark, [])).collect() == []


def test_outliers_find_their_nearest(spark, monkeypatch):
    """All queries lie far from everything else; one list's queries meet in several groups."""
    monkeypatch.setattr(ann, "QUERIES", 7)
    monkeypatch.setattr(ann, "CELLS", 2000)
    rng = np.random.default_rng(12)
    x = rng.normal(size=(3000, 8))
    far = rng.normal(size=(30, 8))
    x[::100] = 12 * far / np.linalg.norm(far, axis=1, keepdims=True)
    rows = list(enumerate(x.tolist()))
    got = ann.search(frame(spark, rows)).collect()
    want = brute_nearest(rows, 100)
    assert len(got) == len(want)
    assert len({(r.query_id, r.vec_id) for r in got} & {(q, i) for q, _, i, _ in want}) >= 0.9 * len(want)


def test_lists_of_few_vectors_are_not_enough(spark):
    rng = np.random.default_rng(13)
    rows = [(i, (rng.normal(size=4) * 1e-3 + (50 * (i % 40) if i % 3 else 0)).tolist()) for i in range(400)]
    got = ann.search(frame(spark, rows)).collect()
    assert len(got) == len(brute_nearest(rows, 100)) == 40


def test_codes_that_tell_nothing_lose_no_neighbour(spark, monkeypatch):
    """Scales over orders of magnitude: one list holds most vectors, whose codes are the
    same; its nearest are still found."""
    monkeypatch.setattr(ann, "LISTS", 0.02)
    rng = np.random.default_rng(14)
    x = rng.normal(size=(4000, 64)) * np.exp(3 * rng.normal(size=4000))[:, None]
    rows = list(enumerate(x.tolist()))
    want = {(q, i) for q, _, i, _ in brute_nearest(rows, 100)}
    got = {(r.query_id, r.vec_id) for r in ann.search(frame(spark, rows)).collect()}
    assert len(got) == len(want) and len(got & want) >= 0.95 * len(want)
