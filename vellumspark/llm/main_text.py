"""Main text of pages by a tree-structured graphical model on the document's elements.

Every block element and text leaf is a binary variable: content or not. Its own potential
is linear in features (element, naming words, amounts of text and links), a parent and a
child have a 2 x 2 potential. Sum-product messages run upward and downward over all pages
of a block at once, level by level, and give exact marginals; leaves more likely content
than not are the text. Weights maximise the likelihood of labelled pages: the table's own
pages that declare their regions, and pages laid out anew from their texts, whose layouts
name, nest and mix regions in other ways, with every region known.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dom import Tree, names, parse

#: Pages that the labelled set is made from, longest page taken for it, and layouts a page.
LABELLED, LONGEST, LAYOUTS = 200, 100_000, 5
#: Share of laid-out pages, and of the others' content blocks, that are cut to a few words.
CURT = 0.3
SIZE = 1 << 12
ROUNDS, RATE, DECAY = 160, 0.2, 3e-6
#: Characters of pages whose trees are in memory at once.
SLAB = 1 << 22

# Names that layouts give to regions.
CONTENT_NAMES = "content main article post entry body story text blog prose maincontent articlebody postcontent".split()
OTHER_NAMES = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topbar pagination pager toolbar tabs links toc".split(),
    "header": "header masthead top branding logo hero sitehead".split(),
    "footer": "footer foot bottom copyright colophon legal imprint sitefoot".split(),
    "aside": "sidebar aside widget widgets related recommended rail more trending tags".split(),
    "notice": "cookie cookies consent notice alert gdpr banner popup modal overlay warning message privacy".split(),
    "ad": "ad ads adv advert advertisement sponsor sponsored promo promotion adsense dfp teaser".split(),
    "form": "form newsletter subscribe signup login search contact register survey".split(),
    "comments": "comments comment reply replies respond discussion disqus thread responses commentlist reader".split(),
    "share": "share social sharing follow buttons".split(),
}
CONTENT = frozenset(CONTENT_NAMES)
OTHERS = frozenset(w for group in OTHER_NAMES.values() for w in group) - {"top", "text", "more", "links", "body", "bottom", "message", "tags", "thread", "banner", "hero", "foot", "tabs"}
OTHER_TAGS = frozenset("nav aside footer form dialog menu".split())
#: Texts for layouts beside those of the declared pages.
SENTENCES = ["The harbour was quiet when the last boat came in, and nobody had seen the lights go out.", "Two readings of the gauge differ by more than its makers allow.", "She wrote the letter twice.", "A long winter kept the road closed until the middle of May, when the first trucks crossed the pass."]
SHORT = ["Home", "About us", "Contact", "All rights reserved.", "Read more", "Page 2", "© 2019", "Sign in"]


@dataclass
class Forest:
    """Trees of many pages: nodes in page order, features as (row, column) pairs."""

    parent: np.ndarray
    leaf: np.ndarray
    levels: list[np.ndarray]
    rows: np.ndarray
    columns: np.ndarray


def _bucket(n: int) -> int:
    return min(int(n).bit_length(), 12)


_ids: dict[str, int] = {}


def _id(name: str) -> int:
    found = _ids.get(name)
    if found is None:
        if len(_ids) > 100_000:
            _ids.clear()
        found = _ids[name] = zlib.crc32(name.encode()) % SIZE
    return found


def features(tree: Tree) -> list[list[int]]:
    """Feature numbers of every node."""
    n = len(tree.tag)
    size, linked, leaves = [0] * n, list(tree.linked), [0] * n
    for i in range(n - 1, -1, -1):
        if not tree.tag[i]:
            size[i], leaves[i] = len(tree.text[i]), 1
        if i:
            p = tree.parent[i]
            size[p] += size[i]
            linked[p] += linked[i]
            leaves[p] += leaves[i]
    out = []
    for i in range(n):
        links = int(4 * linked[i] / size[i]) if size[i] else 5
        above = tree.tag[tree.parent[i]] if i else "-"
        if tree.tag[i]:
            mean = _bucket(size[i] // max(leaves[i], 1))
            found = ["e", f"e tag {tree.tag[i]}", f"e in {above} {tree.tag[i]}", f"e links {links}", f"e mean {mean}", f"e mean links {mean} {links}"]
            named = set(names(tree.attributes[i]))
            found += [f"e name {w}" for w in named] + [f"e {kind}" for kind, known in (("other", OTHERS), ("content", CONTENT)) if named & known]
            if "hidden" in tree.attributes[i] or "display:none" in tree.attributes[i].replace(" ", ""):
                found.append("e hidden")
        else:
            text = tree.text[i]
            words, ends = _bucket(text.count(" ") + 1), text[-1] in ".!?:…\"”»"
            found = ["l", f"l in {above}", f"l words {words}", f"l links {links}", f"l words links {min(words, 6)} {links}", f"l ends {ends}", f"l commas {_bucket(text.count(','))}"]
            if "©" in text:
                found.append("l ©")
        out.append([_id(f) for f in found])
    return out


def forest(trees: list[Tree]) -> Forest:
    parent, depth, leaf, rows, columns = [], [], [], [], []
    for tree in trees:
        base, deep = len(parent), []
        for p in tree.parent:
            deep.append(0 if p < 0 else deep[p] + 1)
            parent.append(p + base if p >= 0 else -1)
        depth += deep
        leaf += [not t for t in tree.tag]
        for i, f in enumerate(features(tree), base):
            rows += [i] * len(f)
            columns += f
    d = np.array(depth, np.int64)
    order = np.argsort(d, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(d[order])) + 1) if len(d) else []
    return Forest(np.array(parent, np.int64), np.array(leaf, np.int64), levels, np.array(rows, np.int64), np.array(columns, np.int64))


def marginals(f: Forest, own: np.ndarray, both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum-product on every tree: chance of content of each node, and of each (parent,
    child) pair of values, [node, parent, child]. ``own`` is the log potential of content;
    ``both`` [kind of child, parent, child] that of pairs."""
    n = len(own)
    up = np.zeros((n, 2))
    up[:, 1] = own
    sent = np.zeros((n, 2))
    for level in reversed(f.levels[1:]):
        sent[level] = np.logaddexp.reduce(both[f.leaf[level]] + up[level][:, None, :], axis=2)
        for value in (0, 1):
            up[:, value] += np.bincount(f.parent[level], sent[level, value], minlength=n) if len(level) * 8 > n else 0
        if len(level) * 8 <= n:
            np.add.at(up, f.parent[level], sent[level])
    full = up.copy()
    pairs = np.zeros((n, 2, 2))
    for level in f.levels[1:]:
        rest = full[f.parent[level]] - sent[level]
        joint = both[f.leaf[level]] + rest[:, :, None] + up[level][:, None, :]
        full[level] = np.logaddexp.reduce(joint, axis=1)
        top = joint.max(axis=(1, 2), keepdims=True)
        pairs[level] = np.exp(joint - top)
        pairs[level] /= pairs[level].sum(axis=(1, 2), keepdims=True)
    return 1 / (1 + np.exp(np.clip(full[:, 0] - full[:, 1], -500, 500))), pairs


def scores(f: Forest, weights: np.ndarray) -> np.ndarray:
    return np.bincount(f.rows, weights[f.columns], minlength=len(f.parent))


def fit(trees: list[Tree], labels: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Weights and pair potentials of greatest likelihood, by gradients that are observed
    less expected counts under the marginals."""
    f = forest(trees)
    y = np.array([v for page in labels for v in page], np.int64)
    child = f.parent >= 0
    seen = np.zeros((len(y), 2, 2))
    seen[np.flatnonzero(child), y[f.parent[child]], y[child]] = 1
    theta = np.zeros(SIZE + 8)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, ROUNDS + 1):
        weights, both = theta[:SIZE], theta[SIZE:].reshape(2, 2, 2)
        p, pairs = marginals(f, scores(f, weights), both)
        gap = np.bincount(f.columns, (y - p)[f.rows], minlength=SIZE)
        pair_gap = [(seen - pairs)[child & (f.leaf == kind)].sum(axis=0) for kind in (0, 1)]
        slope = np.concatenate([gap, np.array(pair_gap).ravel()]) / len(y) - DECAY * theta
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        theta = theta + RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return theta[:SIZE], theta[SIZE:].reshape(2, 2, 2)


def declared(tree: Tree) -> list[int] | None:
    """Labels of a page that declares its regions: within article (else main) and not within
    a region of another kind, the innermost deciding. None where there is neither."""
    main = next((t for t in ("article", "main") if t in tree.tag), None)
    if main is None:
        return None
    labels: list[int] = []
    for i, tag in enumerate(tree.tag):
        kinds = set(names(tree.attributes[i])) if tag else set()
        value = labels[tree.parent[i]] if i else 0
        if tag in OTHER_TAGS or (tag and kinds & OTHERS):
            value = 0
        elif tag == main:
            value = 1
        labels.append(value)
    return labels


def _marked(tree: Tree) -> list[int]:
    """Labels of a laid-out page, whose regions carry a mark; the marks are taken away."""
    labels: list[int] = []
    for i in range(len(tree.tag)):
        value = labels[tree.parent[i]] if i else 0
        for mark, label in ((' region="1"', 1), (' region="0"', 0)):
            if mark in tree.attributes[i]:
                tree.attributes[i] = tree.attributes[i].replace(mark, "")
                value = label
        labels.append(value)
    return labels


def lay_out(rng: np.random.Generator, said: list[str], small: list[str]) -> str:
    """A page of the texts ``said`` as content among other regions made of both lists."""
    import html

    def one(words: list[str]) -> str:
        return html.escape(words[int(rng.integers(len(words)))])

    def named(words: list[str], chance: float) -> str:
        if rng.random() > chance:
            return ""
        w = words[int(rng.integers(len(words)))]
        w = [w, f"site-{w}", f"{w}-wrap", f"{w}{rng.integers(9)}", f"page{w.capitalize()}", f"{w} block"][int(rng.integers(6))]
        return f' {["class", "id"][int(rng.integers(2))]}="{w}"'

    def other(kind: str) -> str:
        tags = {"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "aside": ["aside", "div", "section"], "form": ["form", "div"], "comments": ["section", "div", "ol"], "notice": ["div", "section", "p"], "ad": ["div", "aside", "section"], "share": ["div", "ul"]}[kind]
        tag = tags[int(rng.integers(len(tags)))]
        plain = tag in ("div", "section", "p", "ol", "ul")
        listed = kind in ("nav", "share") or (plain and rng.random() < 0.1)
        inside = []
        for _ in range(int(rng.integers(1, 6))):
            if listed:
                inside.append(f'<li><a href="/x">{one(small)}</a></li>' if tag in ("ul", "ol") or rng.random() < 0.5 else f'<a href="/y">{one(small)}</a> ')
            elif kind == "comments":
                kinds = [f'<div class="comment-body"><p>{one(said)}</p></div>', f'<article class="comment"><h4>{one(small)}</h4><p>{one(said)}</p></article>', f"<p>{one(said)}</p>", f'<li class="comment">{one(said)}</li>']
                inside.append(kinds[int(rng.integers(4))])
            elif kind == "form":
                inside.append([f"<label>{one(small)}</label><input>", f"<p>{one(small)}</p>", f"<p>{one(said)}</p>"][int(rng.integers(3))])
            else:
                kinds = [f"<p>{one(said)}</p>", one(small), one(said), f"<h3>{one(small)}</h3>", f'<ul><li><a href="/z">{one(small)}</a></li></ul>', f"<p>{one(small)}</p>"]
                inside.append(kinds[int(rng.integers(6))])
        if tag == "p":
            inside = [one(said)]
        chance = 1.0 if plain and not listed else 0.5
        return f'<{tag}{named(OTHER_NAMES[kind], chance)} region="0">{"".join(inside)}</{tag}>'

    kinds = list(OTHER_NAMES)
    title = html.escape(said[0])
    inner = [f"<h1>{title}</h1>"]
    for s in said[1:]:
        t = html.escape(s)
        forms = [f"<p>{t}</p>"] * 8 + [f"<ul><li>{t}</li></ul>", f"<blockquote><p>{t}</p></blockquote>", f"<h2>{t[:60]}</h2>", f"<div>{t}</div>", f"<p><b>{t}<br>", f"<table><tr><td>{t}</td></tr></table>", f"<figure><figcaption>{t}</figcaption></figure>", f'<p><a href="/a">{t}</a></p>', f"{t}<br><br>", f"<pre>{t}</pre>"]
        inner.append(forms[int(rng.integers(len(forms)))])
        if rng.random() < 0.12:
            inner.append(other(["ad", "share", "aside", "notice", "form"][int(rng.integers(5))]))
    tag = ["article", "main", "div", "section", "div", "td"][int(rng.integers(6))]
    plain = tag in ("div", "section", "td")
    body = f'<{tag}{named(CONTENT_NAMES, 0.85 if plain else 0.4)} region="1">{"".join(inner)}</{tag}>'
    if tag == "td":
        body = f"<table><tr>{body}</tr></table>"
    before = [other(k) for k in rng.choice(kinds, int(rng.integers(1, 5)))]
    after = [other(k) for k in rng.choice(kinds, int(rng.integers(1, 6)))]
    page = "".join(before) + body + "".join(after)
    for _ in range(int(rng.integers(3))):
        page = f'<div{named(["wrapper", "container", "page", "site", "row", "layout", "inner"], 0.7)}>{page}</div>'
    return f"<html><head><title>{title}</title></head><body>{page}</body></html>"


def labelled(sample: list[str]) -> tuple[list[Tree], list[list[int]]]:
    """Declared pages of the sample and, from their texts, laid-out ones."""
    rng = np.random.default_rng(12)
    trees, labels = [], []
    content, small, pools = list(SENTENCES), list(SHORT), []
    for page in sample:
        tree = parse(page)
        found = declared(tree)
        if found:
            trees.append(tree)
            labels.append(found)
            said = [t for t, v in zip(tree.text, found, strict=True) if t and v]
            content += said[:20]
            small += [t for t, v in zip(tree.text, found, strict=True) if t and not v][:20]
            pools.append(said or SENTENCES[:1])
    small += [content[int(k)] for k in rng.integers(0, len(content), len(small) // 3)]  # other regions hold sentences too
    while len(pools) < LABELLED // 2:
        pools.append([content[int(k)] for k in rng.integers(0, len(content), 5)])
    for said in pools:
        for _ in range(LAYOUTS):
            short, brief = int(rng.integers(1, 1 + min(len(said), 6))), rng.random() < CURT
            parts = said[:short] + [content[int(k)] for k in rng.integers(0, len(content), 3)]
            parts = [" ".join(t.split()[: int(rng.integers(1, 12 if brief else 6))]) if brief or rng.random() < CURT else t for t in parts]  # short ones belong to the text too
            tree = parse(lay_out(rng, parts, small))
            trees.append(tree)
            labels.append(_marked(tree))
    return trees, labels


def texts(pages: list[str], weights: np.ndarray, both: np.ndarray) -> list[str]:
    """Main text of each page: leaves whose marginal is over a half, in page order."""
    trees = [parse(p) for p in pages]
    f = forest(trees)
    chance = marginals(f, scores(f, weights), both)[0]
    out, at = [], 0
    for tree in trees:
        out.append("\n\n".join(t for i, t in enumerate(tree.text) if t and chance[at + i] > 0.5))
        at += len(tree.tag)
    return out


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    Null html is empty, as is the text of a page without content; repeated rows stay
    repeated, null ids and urls stay null, other columns are not read, an empty table gives
    none. White space is what Unicode says. The model is fitted on LABELLED pages at most,
    those with the smallest hashes of id and html among pages of up to LONGEST characters; all
    pages are read whole, in blocks of about SLAB characters.
    """
    page = F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    fair = pages.select(page, F.xxhash64(F.col("page_id").cast("string"), page).alias("h")).where(F.length("html").between(1, LONGEST))
    hashes = [r.h for r in fair.select("h").orderBy("h").limit(LABELLED).collect()]  # pages only of the chosen, not of each partition's first
    sample = [r.html for r in fair.where(F.col("h") <= max(hashes, default=0)).orderBy("h").limit(LABELLED).collect()]
    weights, both = fit(*labelled(sample))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            whole, start = b.column(2).cast(pa.large_string()), 0
            sizes = [len(x) for x in b.column(2).cast(pa.large_binary()).to_pylist()]
            while start < len(b):
                end, amount = start, 0
                while end < len(b) and (end == start or amount + sizes[end] <= SLAB):
                    amount += sizes[end]
                    end += 1
                found = texts(whole.slice(start, end - start).to_pylist(), weights, both)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, end - start), b.column(1).slice(start, end - start), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])
                start = end

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), page).mapInArrow(batches, "page_id long, url string, text string, n_chars long")
