import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vellumspark.llm import simhash
from vellumspark.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, node string, rep int"


def plain(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if sum(h >> bit & 1 for h in hashes) * 2 > len(hashes))


def brute(rows):
    """doc_id -> (hex, component) from all pairs."""
    fps = [plain(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d is None, d or 0, f"{fps[i]:016x}", least.get(root(i))) for i, (d, _) in enumerate(rows))


def run(spark, rows):
    docs = spark.createDataFrame([(d, t, None, "x", 1) for d, t in rows], SCHEMA)
    out = simhash.near_duplicates(docs).collect()
    return sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in out)


def test_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = ["w%d" % k for k in rng.integers(0, 400, 300)]
    rows = [(i, " ".join("w%d" % k for k in rng.integers(0, 50, rng.integers(0, 9)))) for i in range(100)]
    for i in range(100, 160):
        copy = list(base)
        for k in rng.integers(0, 300, rng.integers(0, 4)):
            copy[k] = "x%d" % i
        rows.append((i, "\t ".join(copy).upper()))
    rows += [(500, None), (501, ""), (502, " \n\x0b"), (None, None), (None, "ä Ä only here now"), (7, "again"), (7, "again")]
    assert run(spark, rows) == brute(rows)


def test_fingerprints_within_four_bits_all_link(spark):
    rng = np.random.default_rng(3)
    fps = []
    for seed in range(40):
        f = int(rng.integers(-(2**63), 2**63))
        fps.append(f)
        for n in range(1, 7):
            g = f
            for bit in rng.choice(64, n, replace=False):
                g ^= 1 << int(bit)
                g = g - 2**64 if g >= 2**63 else g
            fps.append((g + 2**63) % 2**64 - 2**63)
    fps = sorted(set(fps))
    got = {tuple(sorted((r.a, r.b))) for r in simhash.links(spark.createDataFrame(list(enumerate(fps)), "rep long, fp long").select("fp", "rep")).collect()}
    want = {(i, j) for j in range(len(fps)) for i in range(j) if bin((fps[i] ^ fps[j]) & (2**64 - 1)).count("1") <= 4}
    assert got == want and want


def test_hash_is_sparks_own(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("ein wort für dich"))).first()[0]
    assert xxhash.xxh64_intdigest("ein wort für dich".encode(), 42) == row % 2**64


def test_empty_and_long(spark):
    assert run(spark, []) == []
    long = "lorem ipsum dolor " * 70_000
    assert run(spark, [(1, long), (2, long + "sit")])[1][3] == 1


def test_keep_one(spark):
    docs = spark.createDataFrame([(1, "a b c d e", None, "x", 1), (2, "a b c d e", None, "x", 1), (None, "q", None, "x", 1), (4, "z y x w v", None, "x", 1)], SCHEMA)
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns and sorted(str(r.doc_id) for r in out.collect()) == ["1", "4", "None"]


@pytest.mark.parametrize("pairs", [[], [(1, 2), (2, 3), (9, 8), (5, 5), (None, 4)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(50)]])
def test_components(spark, pairs):
    got = {(r.node, r.component) for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want, seen = set(), {}
    for a, b in pairs:
        if a is not None and b is not None and a != b:
            seen.setdefault(a, {a}), seen.setdefault(b, {b})
            merged = seen[a] | seen[b]
            for x in merged:
                seen[x] = merged
    want = {(n, min(g)) for n, g in seen.items() if n != min(g)}
    assert got == want


@pytest.mark.parametrize("cell", [4096, 100])
def test_a_ball_has_fewer_links_than_pairs(spark, cell):
    """1,500 fingerprints within two bits of one, and a chain beside them."""
    rng = np.random.default_rng(11)
    centre, fps = int(rng.integers(0, 2**62)), set()
    while len(fps) < 1500:
        f = centre
        for bit in rng.choice(64, rng.integers(0, 3), replace=False):
            f ^= 1 << int(bit)
        fps.add(f)
    chain = [int(rng.integers(0, 2**62))]
    for _ in range(30):
        f = chain[-1]
        for bit in rng.choice(64, 4, replace=False):
            f ^= 1 << int(bit)
        chain.append(f)
    nodes = [(i, f - 2**64 if f >= 2**63 else f) for i, f in enumerate([*sorted(fps), *dict.fromkeys(chain)])]
    prints = spark.createDataFrame(nodes, "rep long, fp long").select("fp", "rep")
    found = simhash.connecting_links(prints, cell=cell).distinct().cache()
    value = dict(nodes)
    assert all(bin((value[r.a] ^ value[r.b]) & (2**64 - 1)).count("1") <= 4 or r.b < r.a for r in found.collect())
    assert 1500 <= found.count() < len(nodes) * found.rdd.getNumPartitions() and found.count() < 10 * len(nodes)
    want = {(r.node, r.component) for r in connected_components(simhash.links(prints)).collect()}
    assert {(r.node, r.component) for r in connected_components(found).collect()} == want
