"""Pages of PDF containers in page order."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.operators.tables import settled, visible

TOKEN = re.compile(rb"%[^\r\n]*|<<|>>|\[|\]|\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|/[^\s/<>\[\]()%]*|[^\s/<>\[\]()%]+", re.DOTALL)
OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b|\btrailer\b")
#: Bytes that an object stream may inflate to.
INFLATED = 256 << 20


class Ref(int):
    """The number of another object."""


def value(body: bytes) -> Any:
    """The first PDF value of ``body``: dict, list, name, number or reference. Strings are
    None."""
    open_: list[list] = [[]]
    for t in TOKEN.findall(body):
        now = open_[-1]
        if t in (b"<<", b"["):
            open_.append([])
        elif t in (b">>", b"]") and len(open_) > 1:
            got = open_.pop()
            open_[-1].append({k: v for k, v in zip(got[::2], got[1::2]) if isinstance(k, str)} if t == b">>" else got)
        elif t == b"R" and len(now) > 1 and isinstance(now[-2], int):
            now[-2:] = [Ref(now[-2])]
        elif t[:1] == b"/":
            now.append(t[1:].decode("latin-1"))
        elif t.isdigit():
            now.append(int(t))
        elif t[:1] != b"%":
            now.append(None)
        if len(open_) == 1 and open_[0] and isinstance(open_[0][0], dict):
            break
    return open_[0][0] if open_[0] else None


def _inflated(head: dict, data: bytes) -> bytes:
    if head.get("Filter") not in ("FlateDecode", ["FlateDecode"]):
        return data
    inflater = zlib.decompressobj()
    out = inflater.decompress(data, INFLATED)
    if inflater.unconsumed_tail:
        raise ValueError("object stream too large")
    if not inflater.eof:
        raise ValueError("object stream cut short")
    return out


def objects(content: bytes) -> Iterator[tuple[int | None, Any]]:
    """(number, value) in file order, those of object streams included; a trailer's number
    is None."""
    at = 0
    while m := OBJECT.search(content, at):
        at = m.end()
        ends = [e for e in (content.find(b"endobj", at), content.find(b"stream", at), content.find(b"startxref", at)) if e >= 0]
        stop = min(ends, default=len(content))
        got, at = value(content[at:stop]), stop
        number = int(m[1]) if m[1] else None
        yield number, got
        if not isinstance(got, dict) or not content.startswith(b"stream", stop):
            continue
        start = stop + 6 + (2 if content.startswith(b"\r\n", stop + 6) else 1)
        size = got.get("Length")
        told = start + size if isinstance(size, int) and not isinstance(size, Ref) else None
        if told is None or not content[told : told + 16].lstrip().startswith(b"endstream"):
            told = content.find(b"endstream", start)
        at = told if told >= 0 else len(content)
        if got.get("Type") == "XRef":
            yield None, got
        if got.get("Type") == "ObjStm":
            data = _inflated(got, content[start:at])
            heads = [int(x) for x in data[: got["First"]].split()[: 2 * got["N"]]]
            places = [got["First"] + p for p in heads[1::2]]
            for k, a, b in zip(heads[::2], places, [*places[1:], len(data)]):
                yield k, value(data[a:b])


def nodes(content: bytes | None) -> list[tuple]:
    """(node, kind, kids, error) of the page tree's nodes. Of objects with one number the
    last counts. Null, other formats, encrypted and broken files give one row with an error."""
    if content is None or not content.startswith(b"%PDF-"):
        return [(None, None, None, "no container")]
    last: dict[int, Any] = {}
    root, locked = None, False
    try:
        for number, got in objects(content):
            if number is not None:
                last[number] = got
            elif isinstance(got, dict):
                root, locked = got.get("Root", root), locked or "Encrypt" in got
    except (KeyError, TypeError, ValueError, zlib.error) as e:
        return [(None, None, None, f"broken: {e}")]
    if locked:
        return [(None, None, None, "encrypted")]
    dicts = {k: v for k, v in last.items() if isinstance(v, dict)}
    catalog = dicts.get(root) or next((v for v in dicts.values() if v.get("Type") == "Catalog"), {})
    tree = catalog.get("Pages")
    rows = [(int(tree), "root", None, None)] if isinstance(tree, Ref) else []
    for k, v in dicts.items():
        kids = v.get("Kids")
        kids = last.get(kids) if isinstance(kids, Ref) else kids
        if v.get("Type") == "Page":
            rows.append((k, "page", None, None))
        elif isinstance(kids, list):
            rows.append((k, "inner", [int(x) for x in kids if isinstance(x, Ref)], None))
    return rows


def page_nodes(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, node, kind, kids, error): a Python table function beside each container."""
    visible(files.sparkSession)

    @F.udtf(returnType="node bigint, kind string, kids array<bigint>, error string")
    class Nodes:
        def eval(self, content: bytes):
            yield from nodes(content)

    return files.select(key, content).lateralJoin(Nodes(F.col(content).outer())).drop(content)


def ordered_pages(tree: DataFrame, key: str, depth: int = 64) -> DataFrame:
    """(key, page, node, error) of what ``page_nodes`` yields: pages from 1 in the order of
    their tree; a container without any, or with a node below ``depth``, is one row with an
    error. Inner nodes go on once, at their first place on the uppermost level, so cycles
    end and no tree makes more rows than its lists of kids have entries. ``key`` must be
    unique to a container. Every level is a join, and levels are those of the deepest tree."""
    tree = settled(tree)
    inner = tree.where("kind = 'inner'").select(key, "node", "kids")
    leaves = tree.where("kind = 'page'").select(key, "node")
    level = tree.where("kind = 'root'").select(key, "node", F.array().cast("array<int>").alias("path"))
    first = Window.partitionBy(key, "node").orderBy("path")
    found, seen = [], None
    for _ in range(depth):
        found.append(level.join(leaves, [key, "node"]))
        going = level.join(inner, [key, "node"])
        going = going if seen is None else going.join(seen, [key, "node"], "left_anti")
        going = settled(going.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r"))
        level = going.select(key, F.posexplode("kids").alias("_i", "node"), "path").select(key, "node", F.concat("path", F.array("_i")).alias("path"))
        if going.isEmpty():
            break
        gone = going.select(key, "node")
        seen = gone if seen is None else seen.unionAll(gone)
    deep = level.join(tree.where("kind IN ('inner', 'page')").select(key, "node"), [key, "node"], "left_semi").select(key).distinct().withColumn("_deep", F.lit(True))
    pages = settled(reduce(DataFrame.unionAll, found)).join(deep, key, "left_anti")
    numbered = pages.select(key, F.row_number().over(Window.partitionBy(key).orderBy("path")).alias("page"), "node", F.lit(None).cast("string").alias("error"))
    per = tree.groupBy(key).agg(F.max("error").alias("error")).join(deep, key, "left").join(pages.select(key).distinct(), key, "left_anti")
    said = F.coalesce("error", F.when(F.col("_deep"), F.lit("too deep")), F.lit("no pages"))
    none = per.select(key, F.lit(None).cast("int").alias("page"), F.lit(None).cast("bigint").alias("node"), said.alias("error"))
    return numbered.unionAll(none)
