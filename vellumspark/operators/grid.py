"""Grids of tokens and image geometry: arithmetic within rows, group-bys by window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def window_attention(cells: DataFrame, size: int) -> DataFrame:
    """(image, y, x, v) with ``attended``: a softmax mean over the cell's ``size`` by
    ``size`` window, in which places outside the grid take part as zeros."""
    wy, wx = F.floor(F.col("y") / size), F.floor(F.col("x") / size)
    e = F.exp("v")
    sums = cells.groupBy("image", wy.alias("wy"), wx.alias("wx")).agg(F.sum(e * F.col("v")).alias("top"), F.sum(e).alias("low"), F.count("*").alias("n"))
    rows = cells.withColumns({"wy": wy, "wx": wx}).join(sums, ["image", "wy", "wx"])
    return rows.withColumn("attended", F.col("top") / (F.col("low") + size * size - F.col("n")))


def with_newlines(cells: DataFrame, newline: float) -> DataFrame:
    """(image, pos, v): every grid row is followed by the newline value."""
    ends = cells.groupBy("image", "y").agg((F.max("x") + 1).alias("x")).withColumn("v", F.lit(newline))
    order = Window.partitionBy("image").orderBy("y", "x")
    return cells.unionByName(ends).select("image", (F.row_number().over(order) - 1).alias("pos"), "v")


def tiles_to_page(cells: DataFrame, per_page: int, across: int, height: int, width: int) -> DataFrame:
    """Tiles, row by row on a page, as one grid: (page, row, col, v)."""
    tile = (F.col("image") % per_page).cast("int")
    row = F.floor(tile / across).cast("int") * height + F.col("y")
    return cells.select(F.floor(F.col("image") / per_page).alias("page"), row.alias("row"), (tile % across * width + F.col("x")).alias("col"), "v")


def queries_of(size: Column) -> Column:
    return F.ceil(F.floor(size / 16) / 4)


def placeholders(q: Column, local: Column | None = None, across: Column | None = None, down: Column | None = None) -> Column:
    """Tokens that stand for an image: rows with a newline each and one separator, and
    those of its tiles, if there are any."""
    whole = (q + 1) * q + 1
    return whole if local is None else whole + (local * across + 1) * (local * down)


def fitted_edge(short: Column, long: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.rint(short / long * size)).cast("long")


def tile_boxes(across: Column, down: Column, tile: int) -> Column:
    """Row by row: array<struct<x, y>> of the tiles' upper left corners."""
    return F.transform(F.sequence(F.lit(0), across * down - 1), lambda i: F.struct((i % across * tile).cast("int").alias("x"), (F.floor(i / across) * tile).cast("int").alias("y")))


def edge_violation(edge: Column, most: int) -> Column:
    return F.when(edge < 16, "below 16").when(edge > most, f"above {most}").when(edge % 16 != 0, "no multiple of 16").otherwise("")


def light(ink: Column, key: Column) -> Column:
    """A printing colour and key as light."""
    return 255 - F.least(F.lit(255), ink + key)


def view(pixels: Column) -> Column:
    return F.transform(pixels, lambda p: (p / 255 - 0.5) / 0.5)


def accept_loss(p_flip: Column, cost: float) -> Column:
    """Expected loss of accepting a draft that is wrong with ``p_flip``."""
    return p_flip * cost


def xorshift(spark: SparkSession, seed: int, steps: int) -> DataFrame:
    """(step, s): a 32-bit stream, one value from the last; a fold over ``steps``."""
    low = F.lit(0xFFFFFFFF).cast("long")

    def following(s: Column) -> Column:
        a = s.bitwiseXOR(F.shiftleft(s, 13).bitwiseAND(low))
        b = a.bitwiseXOR(F.shiftright(a, 17))
        return b.bitwiseXOR(F.shiftleft(b, 5).bitwiseAND(low))

    start = F.array(F.lit(seed).cast("long"))
    rest = F.sequence(F.lit(2), F.lit(steps))
    return spark.range(1).select(F.posexplode(F.aggregate(rest, start, lambda acc, _: F.concat(acc, F.array(following(F.element_at(acc, -1)))))).alias("step", "s")).select((F.col("step") + 1).alias("step"), "s")


def first_existing(candidates: DataFrame, by: str) -> DataFrame:
    """(by, path) of the first candidate that is there."""
    return candidates.where("there").groupBy(by).agg(F.min_by("path", "ordinal").alias("path"))
