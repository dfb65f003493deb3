import numpy as np
import pytest

from vellumspark.operators import attention


def plain(streams, many, prefix, ring, scale):
    out = {}
    for name, rows in streams.items():
        for p in range(len(rows) - many, len(rows)):
            seen = [j for j in range(p + 1) if j < prefix or j > p - ring]
            s = np.array([rows[p] @ rows[j] * scale for j in seen])
            w = np.exp(s - s.max())
            out[name, p] = (s.max(), w.sum(), w @ np.array([rows[j] for j in seen]) / w.sum())
    return out


@pytest.mark.parametrize("block", [1, 3, 16, 1000])
@pytest.mark.parametrize("prefix, ring", [(0, 4), (5, 7), (9, 1), (40, 3)])
def test_any_split_gives_the_same(spark, block, prefix, ring):
    rng = np.random.default_rng(3)
    streams = {"a": rng.normal(0, 3, (30, 4)), None: rng.normal(0, 3, (12, 4)), "hot": rng.normal(0, 300, (25, 4))}
    rows = spark.createDataFrame([(n, i, r.tolist()) for n, v in streams.items() for i, r in enumerate(v)], "s string, t int, e array<double>")
    placed = attention.positions(rows, ["s"], ["t"])
    queries = attention.drafts(placed, ["s"], 6).selectExpr("s", "pos", "e AS q")
    out = attention.attend(queries, placed.selectExpr("s", "pos", "e AS k", "e AS v"), ["s"], prefix, ring, block=block, scale=0.5)
    got = {(r.s, r.pos): (r.top, r.total, r.attended) for r in out.collect()}
    want = plain(streams, 6, prefix, ring, 0.5)
    assert got.keys() == want.keys()
    for k, (top, total, mean) in want.items():
        assert got[k][0] == pytest.approx(top) and got[k][1] == pytest.approx(total) and np.allclose(got[k][2], mean)
