import pytest
from pyspark.sql import functions as F

from vellumspark.operators import resample
from vellumspark.sources import figures


def rows(spark, n, fail_at=None):
    content = F.when(F.col("id") == fail_at, F.raise_error(F.lit("no figure")).cast("binary")).otherwise(F.encode(F.repeat(F.lit("x"), F.col("id").cast("int")), "UTF-8")) if fail_at is not None else F.encode(F.repeat(F.lit("x"), F.col("id").cast("int")), "UTF-8")
    return spark.range(0, n, 1, 4).select(F.col("id").alias("page"), F.lit(1).alias("figure"), F.lit(None).alias("label"), F.lit("png").alias("ext"), content.alias("content"), F.lit("x").alias("other"))


def test_manifest_lists_what_was_committed(spark, tmp_path):
    got = figures.write(rows(spark, 10), f"file://{tmp_path}/f", prefix="out/").collect()
    assert sorted((r.page, r.path, r.bytes, r.label) for r in got) == [(k, f"out/page{k}_figure_1.png", k, None) for k in range(10)]
    assert (tmp_path / "f" / "page7_figure_1.png").read_bytes() == b"x" * 7


def test_a_failing_task_leaves_no_listed_file(spark, tmp_path):
    path = f"file://{tmp_path}/f"
    figures.write(rows(spark, 3), path)
    assert figures.write(rows(spark, 3), path).count() == 6
    with pytest.raises(Exception, match="no figure"):
        figures.write(rows(spark, 40, fail_at=33), path)
    assert sorted(r.page for r in figures.manifest(spark, path).collect()) == [0, 0, 1, 1, 2, 2]
    left = {p.name for p in (tmp_path / "f").glob("page*")}
    assert left <= {f"page{k}_figure_1.png" for k in range(30)}  # the failed task's own are gone
    (tmp_path / "f" / "manifest" / "part-stray.jsonl").write_text('{"page":99,"figure":1,"label":"","path":"p","bytes":1}\n')
    assert sorted(r.page for r in figures.manifest(spark, path).collect()) == [0, 0, 1, 1, 2, 2]


def test_no_figures_and_tokens_in_order(spark, tmp_path):
    assert figures.write(rows(spark, 0), f"file://{tmp_path}/f").collect() == []
    each = F.expr("array(named_struct('token', 'A', 'figure', 1, 'path', 'B'), named_struct('token', 'B', 'figure', 2, 'path', 'c'))")
    text = spark.range(1).select(figures.referred(F.lit("A B A"), each)).first()[0]
    assert text == "![figure 1](![figure 2](c)) ![figure 2](c) ![figure 1](![figure 2](c))"


def test_a_step_resampled_by_hand(spark):
    """Halving a row of four: seven taps with the weights of the cubic of -0.5."""
    cells = spark.createDataFrame([(1, 0, x, v) for x, v in enumerate([0, 0, 255, 255])], "k int, y int, x int, v int")
    got = {r.x: r.v for r in resample.resized(cells, 1, 4, 1, 2, ["k"]).collect()}
    assert got == {0: 11, 1: 244} or (got[0] + got[1] == 255 and 0 <= got[0] < 40)
    assert {r.x: r.v for r in resample.resized(cells, 1, 4, 1, 4, ["k"]).collect()} == {0: 0, 1: 0, 2: 255, 3: 255}
    flat = spark.createDataFrame([(1, y, x, 77) for y in range(5) for x in range(7)], "k int, y int, x int, v int")
    assert {r.v for r in resample.resized(flat, 5, 7, 9, 3, ["k"]).collect()} == {77}
    with pytest.raises(ValueError):
        resample.position_table(flat, 12, 5)
    with pytest.raises(ValueError):
        resample.resized(flat, 5, 7, 0, 3, ["k"])
