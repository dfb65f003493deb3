"""A sink of figures: a file each, and a manifest of those that were committed.

Every task writes its files and a manifest part of its own; the commit writes one list of
the committed parts, so what failed or repeated tasks left is never listed. A task that
fails deletes what it wrote, and an aborted job deletes what its finished tasks wrote.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FIGURES = "page long, figure long, label string, ext string, content binary"
MANIFEST = "page long, figure long, label string, path string, bytes long"
PARTS, LIST = "manifest", "manifest/committed.json"


def name(page: Column, figure: Column, ext: Column) -> Column:
    return F.concat(F.lit("page"), page, F.lit("_figure_"), figure, F.lit("."), ext)


def referred(markdown: Column, figures: Column, prefix: str = "") -> Column:
    """``markdown`` with each figure's token as a reference to its file. figures: ordered
    array<struct<token, figure, path>>; each is replaced in what the ones before it left."""
    return F.aggregate(figures, markdown, lambda text, f: F.replace(text, f["token"], F.concat(F.lit("![figure "), f["figure"], F.lit(f"]({prefix}"), f["path"], F.lit(")"))))


def _store(path: str):
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if not path.startswith("file:") else path.replace("file:/", "file:///", 1) if not path.startswith("file:///") else path)


@dataclass
class Written(WriterCommitMessage):
    part: str | None
    files: int


class FigureWriter(DataSourceWriter):
    def __init__(self, path: str, prefix: str, overwrite: bool):
        self.path, self.prefix, self.overwrite = path, prefix, overwrite

    def write(self, rows: Iterator) -> Written:
        store, root = _store(self.path)
        store.create_dir(f"{root}/{PARTS}", recursive=True)
        part, done = f"part-{uuid.uuid4().hex}.jsonl", []
        try:
            with store.open_output_stream(f"{root}/{PARTS}/{part}") as manifest:
                for r in rows:
                    own = f"page{r.page}_figure_{r.figure}.{r.ext}"
                    done.append(own)
                    content = bytes(r.content)
                    with store.open_output_stream(f"{root}/{own}") as f:
                        f.write(content)
                    manifest.write((json.dumps({"page": r.page, "figure": r.figure, "label": r.label, "path": self.prefix + own, "bytes": len(content)}) + "\n").encode())
        except BaseException:
            for own in (*done, f"{PARTS}/{part}"):
                _delete(store, f"{root}/{own}")
            raise
        if not done:
            _delete(store, f"{root}/{PARTS}/{part}")
        return Written(part if done else None, len(done))

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        parts = sorted(m.part for m in messages if m and m.part)
        if not parts:  # an empty part keeps the manifest readable
            parts = ["part-empty.jsonl"]
            store.create_dir(f"{root}/{PARTS}", recursive=True)
            with store.open_output_stream(f"{root}/{PARTS}/{parts[0]}"):
                pass
        if not self.overwrite:
            try:
                with store.open_input_stream(f"{root}/{LIST}") as f:
                    parts = sorted({*json.loads(f.read()), *parts})
            except FileNotFoundError:
                pass
        with store.open_output_stream(f"{root}/{LIST}") as f:
            f.write(json.dumps(parts).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        for m in messages:
            if m and m.part:
                with store.open_input_stream(f"{root}/{PARTS}/{m.part}") as f:
                    listed = [json.loads(line)["path"] for line in f.read().decode().splitlines()]
                for own in listed:
                    _delete(store, f"{root}/{own[len(self.prefix) :]}")
                _delete(store, f"{root}/{PARTS}/{m.part}")


def _delete(store, path: str) -> None:
    try:
        store.delete_file(path)
    except FileNotFoundError:
        pass


class Figures(DataSource):
    """``df.write.format("figures").option("path", ...)`` for rows of FIGURES."""

    @classmethod
    def name(cls) -> str:
        return "figures"

    def schema(self) -> str:
        return FIGURES

    def writer(self, schema, overwrite: bool) -> FigureWriter:
        return FigureWriter(self.options["path"].rstrip("/"), self.options.get("prefix", ""), overwrite)


def write(figures: DataFrame, path: str, prefix: str = "") -> DataFrame:
    """Write FIGURES rows below ``path``; the manifest (MANIFEST) of what was committed."""
    spark = figures.sparkSession
    spark.dataSource.register(Figures)
    rows = figures.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in FIGURES.split(", ")])
    rows.write.format("figures").option("path", path).option("prefix", prefix).mode("append").save()
    return manifest(spark, path)


def manifest(spark, path: str) -> DataFrame:
    """The committed parts' rows; parts that are not on the list are not read."""
    listed = spark.read.text(f"{path}/{LIST}").select(F.explode(F.from_json("value", "array<string>")).alias("part"))
    rows = spark.read.schema(MANIFEST).json(f"{path}/{PARTS}/part-*.jsonl").withColumn("part", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return rows.join(listed, "part", "left_semi").drop("part")
