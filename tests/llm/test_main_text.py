import html
import itertools
import re

import numpy as np
import pytest

from vellumspark.llm import dom, main_text

SCHEMA = "page_id long, url string, html string, text string, n_chars int"


def leaves(page):
    t = dom.parse(page)
    return [x for x in t.text if x]


@pytest.mark.parametrize(
    "page, want",
    [
        ("<p>a  b\n<b>c</b>&nbsp;d<p>e<br>f", ["a b c d", "e f"]),
        ("<p>1 &lt; 2 &amp;amp; &#233;&#x41; &copy 3", ["1 < 2 &amp; éA © 3"]),
        ("x<script>var t='</p>';</script>y<style>p{}</style><!-- no > --><textarea>q</textarea>z", ["xyz"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", ["a", "b", "c", "d", "e"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("a<div class='x>y' id=\"<p>\">b</div><a href=x>c", ["a", "b", "c"]),
        ("<p>cut <b", ["cut"]),
        ("<script>never closed <p>a", []),
        ("a</div></p>b<select><option>o</select>c", ["a", "bc"]),
        ("<title>t</title>", []),
        ("", []),
    ],
)
def test_leaves(page, want):
    assert leaves(page) == want


def test_deep_and_long_pages():
    deep = "<div>" * 30_000 + "text" + "</div>" * 30_000
    assert leaves(deep) == ["text"]
    assert len(leaves("<p>word &amp; more" * 50_000)) == 50_000
    assert leaves("<a \"" * 3000 + "<p>x") and leaves("<!--" * 50_000) == []


def test_marginals_against_all_assignments():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 9):
        trees = []
        for _ in range(3):
            t = dom.Tree()
            for i in range(1, n):
                t.add(int(rng.integers(0, i)), "" if rng.random() < 0.3 else "p", text="x")
            trees.append(t)
        f = main_text.forest(trees)
        own, both = rng.normal(0, 2, 3 * n), rng.normal(0, 1, (2, 2, 2))
        got, pairs = main_text.marginals(f, own, both)
        for k in range(3):
            at, total, ones, joint = k * n, 0.0, np.zeros(n), np.zeros((n, 2, 2))
            for y in itertools.product((0, 1), repeat=n):
                w = sum(own[at + i] * y[i] for i in range(n))
                w = np.exp(w + sum(both[f.leaf[at + i], y[f.parent[at + i] - at], y[i]] for i in range(1, n)))
                total += w
                ones += w * np.array(y)
                for i in range(1, n):
                    joint[i, y[f.parent[at + i] - at], y[i]] += w
            assert np.allclose(got[at : at + n], ones / total) and np.allclose(pairs[at : at + n], joint / total)


def articles(page):
    """What the test tables' pages hold within their article, without any parser."""
    inside = re.search("<article>(.*?)</article>", page, re.S)[1]
    parts = re.split("</?(?:p|h1)>", inside)
    said = [" ".join(html.unescape(re.sub("</?b>", "", re.sub("<br>", " ", p))).split()) for p in parts]
    return "\n\n".join(p for p in said if p)


def test_whole_query(spark):
    import duckdb

    from vellumspark.llm import queries

    rows = duckdb.sql("SELECT page_id, url, html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()
    out = queries.queries()["op12_main_text"](spark, "/root/testdata/sf0.01")
    got = sorted(map(tuple, out.collect()))
    assert got == sorted((i, u, t, len(t)) for i, u, h in rows for t in [articles(h)])


def test_held_out_layouts():
    """Pages of layouts, names and mixtures that the fitted ones don't share."""
    import duckdb

    pages = [h for (h,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet' ORDER BY page_id").fetchall()]
    weights, both = main_text.fit(*main_text.labelled(pages[:120]))
    rng, wrong, total = np.random.default_rng(77), 0, 0
    held = [(x, v) for p in pages[120:] for t in [dom.parse(p)] for x, v in zip(t.text, main_text.declared(t)) if x]
    said, small = [x for x, v in held if v], [x for x, v in held if not v]
    for _ in range(150):
        tree = dom.parse(main_text.lay_out(rng, [said[int(k)] for k in rng.integers(0, len(said), 8)], small))
        want = main_text._marked(tree)
        f = main_text.forest([tree])
        chance = main_text.marginals(f, main_text.scores(f, weights), both)[0]
        wrong += sum((chance[i] > 0.5) != want[i] for i in range(len(want)) if tree.text[i])
        total += sum(map(bool, tree.text))
    assert wrong / total < 0.02
    own = '<div id="top-nav"><a href="/">Home</a> <a href="/b">Blog</a></div><div class="entry-content"><h2>Boats</h2><p>They came late, and nobody saw the lights.</p><p>Later.</p><div class="share-buttons"><a href="#">Tweet</a></div></div><div id="comments"><p>I saw them, and so did my neighbour, who was awake.</p></div><div class="cookie-consent">We use cookies to remember you.</div><div class="site-footer">© 2020 Boats</div>'
    assert main_text.texts([own], weights, both) == ["Boats\n\nThey came late, and nobody saw the lights.\n\nLater."]


def test_nulls_repeats_and_no_labelled_page(spark):
    rows = [(1, None, None, "t", 1), (None, "u", "", "t", 1), (2, "u", "<p>", None, None), (3, "u", "<div class='content'><p>A first sentence, with a comma.</p></div><div class=footer>© x</div>", "t", 1)]
    out = main_text.extract(spark.createDataFrame(rows + rows[3:], SCHEMA))
    got = sorted((r.page_id is None, r.page_id, r.url, r.text, r.n_chars) for r in out.collect() if True)
    text = "A first sentence, with a comma."
    assert [g[1:] for g in got] == [(1, None, "", 0), (2, "u", "", 0), (3, "u", text, 31), (3, "u", text, 31), (None, "u", "", 0)]
    assert main_text.extract(spark.createDataFrame([], SCHEMA)).collect() == []
