import json
import struct

import numpy as np
import pytest

from vellumspark.sources import tensors

GIB = 1 << 30


@pytest.fixture
def pushed(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield spark
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def large(path):
    """Three GiB of zeros, but for the last value, and two whole numbers."""
    n = 3 * GIB // 4
    head = json.dumps({"big": {"dtype": "F32", "shape": [n], "data_offsets": [0, 4 * n]}, "small": {"dtype": "I64", "shape": [2], "data_offsets": [4 * n, 4 * n + 16]}}).encode()
    with open(path, "wb") as f:
        f.write(struct.pack("<Q", len(head)) + head)
        f.seek(4 * n - 4, 1)
        f.write(struct.pack("<fqq", 2.5, 2**53 + 1, -(2**63)))
    return n


def test_large_file_is_many_tasks_and_only_ranges_are_read(pushed, tmp_path):
    n = large(tmp_path / "large.safetensors")
    df = tensors.read(pushed, str(tmp_path))
    assert df.rdd.getNumPartitions() == 25
    small = df.where("name = 'small'")
    assert small.rdd.getNumPartitions() == 1 and [r.wholes for r in small.collect()] == [[2**53 + 1, -(2**63)]]
    end = df.where(f"name IN ('big') AND start > {n - 3 * (1 << 16)}")
    assert end.rdd.getNumPartitions() == 1
    rows = end.collect()
    assert [r.start for r in rows] == [n - 2 * (1 << 16), n - (1 << 16)] and rows[-1].floats[-1] == 2.5 and sum(rows[0].floats) == 0
    reader = tensors.PushedReader({"path": str(tmp_path)})
    list(reader.pushFilters([tensors.EqualTo(("name",), "big"), tensors.EqualTo(("start",), 1 << 16)]))
    assert [(r.start, r.stop) for p in reader.partitions() for r in p.held] == [(1 << 16, 2 << 16)]


def test_arrays_of_all_kinds_and_shapes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    given = {"a": np.arange(12, dtype="<f4").reshape(3, 4), "b": np.array(7, "<i8"), "c": np.zeros((0, 3), "<f2"), "d": np.array([255], "u1")}
    for k, v in given.items():
        np.save(tmp_path / "in" / f"{k}.npy", v)
    (tmp_path / "in" / "._a.npy").write_bytes(b"no array")
    got = {(r.name, r.start): (r.shape, r.floats or r.wholes) for r in tensors.read(spark, f"file://{tmp_path}", slice=8, glob="*.npy").collect()}
    assert tensors.read(spark, f"file://{tmp_path}", ["d", "x"], glob="[a-z].npy").count() == 1
    assert got == {("a", 0): ([3, 4], list(range(8))), ("a", 8): ([3, 4], [8, 9, 10, 11]), ("b", 0): ([], [7]), ("d", 0): ([1], [255])}


def test_what_is_not_read(spark, tmp_path):
    assert tensors.read(spark, str(tmp_path)).count() == 0
    np.save(tmp_path / "f.npy", np.asfortranarray(np.ones((2, 2), "<f4")))
    with pytest.raises(Exception, match="Fortran"):
        tensors.read(spark, str(tmp_path)).count()
    np.save(tmp_path / "f.npy", np.ones(9, "<f4"))
    (tmp_path / "f.npy").write_bytes((tmp_path / "f.npy").read_bytes()[:-1])
    with pytest.raises(Exception, match="bytes of"):
        tensors.read(spark, str(tmp_path)).count()
