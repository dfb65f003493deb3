"""Spelling variants one edit apart, by merging errata tries.

Words are counted by Spark functions. Two words one edit apart share the half of their
letters that the edit is not in, so words meet on halves: for each length, the shorter
word's first half or the rest of it. A crowded half is halved again on the part that may
still differ, down to one free letter, so no group grows with the input beyond what one
free letter can make. In a group's trie the heavy path (the child with most words) stays
and the light subtrees are merged into it and into each other, once with the branching
letter replaced and once with it skipped; terminals that coincide are pairs. A word takes
part at its light edges only, logarithmically many. Every pair belongs to one group, so
tasks return counts and best forms, not pairs.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import whole
from .common import forget, kept, stored

SHORTEST, LEAST, TIMES, DAMAGE = 7, 2, 10, 31
#: Letters (code points) of a group's words above which the group is halved again.
CROWDED = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(docs: DataFrame) -> DataFrame:
    """(word, n): runs of letters of whole texts, some with a letter deleted by the hash of
    document and run, of at least SHORTEST code points and LEAST occurrences. A null doc_id
    counts as an empty one in the hash. All in Spark functions, with partial counts."""
    low = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(low, F.lit(f"[a-z\\u00C0-\\u00FF]{{{SHORTEST},}}"), F.lit(0))).alias("run"))
    hashed = found.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    spelled = hashed.select(F.when(F.col("h") % DAMAGE == 0, cut).otherwise(F.col("run")).alias("word"))
    return spelled.where(F.length("word") >= SHORTEST).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)


def _keyed(rows: DataFrame) -> DataFrame:
    """With the key of the letters that a group shares."""
    word = F.col("word")
    shared = F.xxhash64("base", "head", "tail", F.substring(word, F.lit(1), F.col("head")), F.right(word, F.col("tail")))
    return rows.withColumn("key", shared)


def _halves(rows: DataFrame) -> DataFrame:
    """Each row for both halves of the letters between its shared head and tail."""
    half = F.floor((F.col("base") - F.col("head") - F.col("tail")) / 2).cast("int")
    head = F.struct((F.col("head") + half).alias("head"), F.col("tail").alias("tail"))
    tail = F.struct(F.col("head").alias("head"), (F.col("base") - F.col("head") - half).alias("tail"))
    split = rows.select("word", "n", "base", F.explode(F.array(head, tail)).alias("s"))
    return _keyed(split.select("word", "n", "base", "s.head", "s.tail"))


def groups(counted: DataFrame, crowded: int) -> DataFrame:
    """(key, base, head, tail, word, n): words of ``base`` or one more code points that share
    their first ``head`` and last ``tail``."""
    length = F.length("word")
    bases = F.array_distinct(F.array(length, F.greatest(length - 1, F.lit(SHORTEST))))
    rows = counted.select("word", "n", F.explode(bases).alias("base"), F.lit(0).alias("head"), F.lit(0).alias("tail"))
    rows, settled = _halves(rows), []
    while True:
        sizes = rows.groupBy("key").agg(F.sum(F.length("word")).alias("letters"), F.max(F.col("base") - F.col("head") - F.col("tail")).alias("free"))
        full = kept(sizes.where((F.col("letters") > crowded) & (F.col("free") > 1)).select("key"), "crowded")
        if full.isEmpty():
            break
        settled.append(rows.join(full, "key", "left_anti"))
        rows = kept(_halves(rows.join(full, "key", "left_semi")), "halved")
    for part in settled:
        rows = rows.unionByName(part)
    return rows


def pairs(names: list[str], base: int, head: int, tail: int) -> set[tuple[int, int]]:
    """Pairs (i, j) of sorted distinct names one edit apart, the shorter of length base, that
    share head and tail and are not of the group with the other half."""
    at = {w: i for i, w in enumerate(names)}
    found: set[tuple[int, int]] = set()
    bound = base - tail if tail else 1 << 62

    def meet(i: int, other: str) -> None:
        j = at.get(other)
        if j is None:
            return
        a, b = names[i], other
        if a[:head] != b[:head] or (tail and a[-tail:] != b[-tail:]) or (tail and a[:bound] == b[:bound]):
            return
        found.add((i, j) if i < j else (j, i))

    open_nodes = [(0, len(names), 0)]
    while open_nodes:
        lo, hi, depth = open_nodes.pop()
        if hi - lo < 2:
            continue
        first, last = names[lo], names[hi - 1]
        d, least = depth, min(len(first), len(last))
        while d < least and first[d] == last[d]:
            d += 1
        if d > bound:
            continue
        stem, children = first[:d], []
        start = lo
        if len(first) == d:
            start += 1
        while start < hi:
            letter = names[start][d]
            end = bisect_left(names, stem + chr(ord(letter) + 1), start, hi)
            children.append((end - start, letter, start, end))
            start = end
        if len(first) == d == base:  # a word ends here: its children skip their last letter
            for _, letter, _, _ in children:
                meet(lo, stem + letter)
        heavy = max(children)
        merged: dict[str, list[int]] = {}
        for child in children:
            open_nodes.append((child[2], child[3], d))
            if child is heavy:
                continue
            for i in range(child[2], child[3]):
                name = names[i]
                rest = name[d + 1 :]
                if len(name) == base:
                    meet(i, stem + heavy[1] + rest)  # replaced, into the heavy subtree
                    meet(i, stem + heavy[1] + name[d:])  # the heavy letter skipped
                    same = merged.setdefault(rest, [])  # replaced, light into light
                    for j in same:
                        meet(i, names[j])
                    same.append(i)
                else:
                    meet(i, stem + rest)  # skipped
    return found


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, near, best): of each group the words with near ones."""
    for t, group in whole(batches, ["key", "base", "head", "tail"]):
        names, counts = t["word"].to_pylist(), t["n"].to_pylist()
        base, head, tail = (t[c].to_numpy() for c in ("base", "head", "tail"))
        out: list[tuple[str, int, int, str]] = []
        starts = [0, *(group[1:] != group[:-1]).nonzero()[0] + 1, len(group)]
        for s, e in zip(starts, starts[1:]):
            if e - s < 2:
                continue
            near: dict[int, list] = {}
            for i, j in pairs(names[s:e], int(base[s]), int(head[s]), int(tail[s])):
                for a, b in ((s + i, s + j), (s + j, s + i)):
                    mine, best = near.setdefault(a, [0, None]), (-counts[b], names[b])
                    mine[0] += 1
                    mine[1] = best if mine[1] is None or best < mine[1] else mine[1]
            out.extend((names[a], k, -best[0], best[1]) for a, (k, best) in near.items())
        columns = list(zip(*out)) or [[], [], [], []]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["word", "near", "best_n", "best"])


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms are followed to the last by doubling. Counts
    grow tenfold a step, so a chain is short and has no cycle."""
    now, path = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after, new = stored(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        done = after.where("moved").isEmpty()
        forget(forms.sparkSession, path)
        now, path = after.drop("moved"), new
        if done:
            return now


def variants(docs: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``docs`` (doc_id, text).

    Null texts and texts without letters have no words; repeated rows count again; an empty
    table gives no rows; other columns are not read. Near words, forms and ties are those of
    the query's contract; each pair of near words is found once, whatever the groups.
    """
    counted = kept(words(docs), "words")
    rows = groups(counted, crowded).repartition("key").sortWithinPartitions("key", "base", "head", "tail", "word")
    found = rows.select("key", "base", "head", "tail", "word", "n").mapInArrow(_near, "word string, near long, best_n long, best string")
    none = counted.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("struct<less:bigint,best:string>").alias("best"))
    partial = found.select("word", F.lit(None).cast("long").alias("n"), "near", F.struct((-F.col("best_n")).alias("less"), "best").alias("best"))
    graded = none.unionByName(partial).groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))
    chosen = -F.col("best.less") >= TIMES * F.col("n")
    graded = kept(graded.select("word", "n", "n_near", F.when(chosen, F.col("best.best")).alias("form"), F.when(chosen, -F.col("best.less")).alias("form_n")), "graded")
    roots = _roots(graded.where("form IS NOT NULL"))
    return graded.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
