import pytest
from pyspark.sql import functions as F

from vellumspark.plans.batches import ends, tokens
from vellumspark.streaming import batching


def alone(seed, ring, most):
    made = []
    while True:
        made.append((seed + 3 * len(made) + sum(made[-ring:])) % 97)
        if ends(made[-1]) or len(made) >= most:
            return made


def streams(n):
    return [(i, 1 + 5 * i) for i in range(n)]


def collected(rows):
    got = {}
    for r in sorted(rows, key=lambda r: r.step):
        got.setdefault(r.input_index, []).append(r.token)
    return got


@pytest.mark.parametrize("cap, lanes", [(1, 1), (3, 2), (100, 3)])
def test_tokens_do_not_depend_on_the_batching(spark, cap, lanes):
    rows = batching.dealt(spark.createDataFrame(streams(40), "input_index long, seed long"), lanes).unionByName(batching.flush(spark, lanes))
    out, seen = batching.watched(batching.batched(rows, tokens, ends, 15, cap, 3), cap)
    got = out.collect()
    assert collected(got) == {i: alone(s, 3, 15) for i, s in streams(40)}
    assert seen.get["most_active"] <= cap and seen.get["retired"] == 40 and seen.get["tokens"] == len(got)
    firsts = {(r.lane, r.input_index): r.forward for r in got if r.step == 0}
    for lane in range(lanes):
        order = [f for (at, _), f in sorted(firsts.items()) if at == lane]
        assert order == sorted(order)  # admitted in input order


def test_a_stream_equals_its_batch_and_state_stays_small(spark, tmp_path):
    lanes, cap, ring = 2, 3, 4
    parts = [streams(30)[k::3] for k in range(3)]
    for part in parts:
        batching.dealt(spark.createDataFrame(part, "input_index long, seed long"), lanes).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    rows = spark.readStream.schema("lane int, input_index long, seed long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out, _ = batching.watched(batching.batched(rows, tokens, ends, 12, cap, ring, forwards=5), cap)

    def run():
        q = out.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return [p for p in q.recentProgress if p.numInputRows]

    seen = run()
    assert [p.observedMetrics["batching"].most_active for p in seen] == [cap] * 3
    kept = max(p.stateOperators[0].numRowsTotal for p in seen)
    assert kept <= 2 * (1 + cap) + 30  # clock and active streams a lane, and those that wait
    before = spark.read.parquet(str(tmp_path / "out")).count()
    batching.flush(spark, lanes).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    run()  # a new query takes up the state where the last one left it
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert before < len(got) and collected(got) == {i: alone(s, ring, 12) for i, s in streams(30)}


def test_a_broken_invariant_fails_the_run(spark):
    rows = batching.dealt(spark.createDataFrame(streams(9), "input_index long, seed long"), 1).unionByName(batching.flush(spark, 1))
    out, _ = batching.watched(batching.batched(rows, tokens, ends, 5, cap=4, ring=2), cap=3)
    with pytest.raises(Exception, match="active 4 over 3"):
        out.collect()
    with pytest.raises(ValueError):
        batching.batched(rows, tokens, ends, 5, cap=0)


def test_the_guard_of_a_stream_latches(spark):
    rows = batching.dealt(spark.createDataFrame(streams(20), "input_index long, seed long"), 1).unionByName(batching.flush(spark, 1))
    out = batching.batched(rows, tokens, lambda t: False, 30, cap=5, ring=3, bet=(3.0, 0.5, 8.0)).collect()
    assert any(r.tripped for r in out) and not all(r.tripped for r in out)
    for i in range(20):
        flags = [r.tripped for r in sorted((r for r in out if r.input_index == i), key=lambda r: r.step)]
        assert flags == sorted(flags)


def test_skipped_pages_are_events(spark):
    rows = spark.createDataFrame([(1, None, None), (2, "timeout", 'it said "no"')], "p long, k string, m string")
    got = [r.json for r in batching.page_events(rows, F.col("p"), F.col("k"), F.col("m")).orderBy("page").collect()]
    assert got == ['{"schema_version":1,"event":"page","status":"ok","page":1}', '{"schema_version":1,"event":"page","status":"skipped","page":2,"error_kind":"timeout","message":"it said \\"no\\""}']


class Kept:
    """A state in memory."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return iter(self.value or [])

    def iterator(self):
        return iter([])

    def put(self, value):
        self.value = list(value)

    def appendList(self, value):
        self.value += value

    def clear(self):
        self.value = None

    def update(self, value):
        self.value = value

    def updateValue(self, key, value):
        pass


@pytest.mark.parametrize("drained", [True, False])
def test_a_lane_reads_and_makes_rows_part_by_part(monkeypatch, drained):
    import pandas as pd

    monkeypatch.setattr(batching, "HELD", 50)
    lane = batching.Lane(tokens, ends, 15, 4, 3, 20, (1.4, 0.9, 20.0), True)
    lane.pending, lane.active, lane.clock = Kept(), Kept(), Kept()
    read = []

    def rows():
        for at in range(0, 3000, 100):
            read.append(at)
            part = pd.DataFrame(streams(3000)[at : at + 100], columns=["input_index", "seed"])
            yield pd.concat([pd.DataFrame({"input_index": [None], "seed": [0]}), part]) if drained and not at else part

    made = lane.handleInputRows((0,), rows(), None)
    parts = [next(made)]
    assert len(read) <= 2
    parts += list(made)
    assert max(map(len, parts)) < 60 and len(read) == 30
    got = pd.concat(parts)
    if drained:
        assert lane.pending.value is None
        assert {i: g.token.tolist() for i, g in got.sort_values("step").groupby("input_index")} == {i: alone(s, 3, 15) for i, s in streams(3000)}
    else:
        assert got.forward.max() == 20
        assert lane.pending.value == streams(3000)[lane.clock.value[1] :]
