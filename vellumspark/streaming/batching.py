"""Continuous batching with at most ``cap`` active streams a lane.

A lane is a key of the stateful operator: streams are dealt to lanes, wait in a list state in
input order, and are admitted as others retire, so one step always runs over all active
streams together. What is kept of an active stream is of fixed size however long it runs:
counters, the state of its latching guard, and a ring of its latest tokens. Tokens of a stream
depend on its own ring alone, so they are the same for any cap, lanes and micro-batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RING = 128
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "lane int, input_index bigint, step bigint, token bigint, done boolean, forward bigint, active int, tripped boolean"
#: Rows of output that a lane holds before it hands them on, and of arrivals it keeps at once.
HELD = 20_000
_PENDING = "input_index bigint, seed bigint"
_ACTIVE = "at bigint, seed bigint, made bigint, e double, tripped boolean, ring array<bigint>"

#: (seeds, steps so far, rings) of the active streams -> their next tokens: the model's place.
Step = Callable[[list[int], list[int], list[list[int]]], list[int]]


class Lane(StatefulProcessor):
    """Rows (lane, input_index, seed); a row without an input_index drains the lane. Other
    micro-batches run ``forwards`` steps at most and leave the rest for the next. Rows that
    are ``ordered`` (draining ones first) are taken as they come, so neither what waits nor
    what is made is ever held whole; others are a micro-batch, which is sorted."""

    def __init__(self, step: Step, end: Callable[[int], bool], most: int, cap: int, ring: int, forwards: int, bet: tuple[float, float, float], ordered: bool):
        self.ordered = ordered
        self.step, self.end, self.most, self.cap, self.ring, self.forwards, self.bet = step, end, most, cap, ring, forwards, bet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pending = handle.getListState("pending", _PENDING)
        self.active = handle.getMapState("active", "input_index bigint", _ACTIVE)
        self.clock = handle.getValueState("clock", "forward bigint, admitted bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rows = iter(rows if self.ordered else [pd.concat(list(rows)).sort_values("input_index", kind="stable", na_position="first")])
        first = next(rows)
        drain = bool(first.input_index.isna().any())  # those rows come first
        arrived = arrivals(chain([first], rows))
        queue = chain((tuple(map(int, r)) for r in self.pending.get()), arrived) if self.pending.exists() else arrived
        running = dict(sorted(((int(k[0]), [*v[:5], list(v[5])]) for k, v in self.active.iterator()), key=lambda r: r[1][0]))  # in order of admission, as later ones follow
        before = set(running)
        forward, admitted = map(int, self.clock.get()) if self.clock.exists() else (0, 0)
        out, left = [], self.forwards
        lane, size, (up, down, limit) = key[0], self.ring, self.bet
        while True:
            if len(running) < self.cap:  # backfill, in input order
                for index, seed in islice(queue, self.cap - len(running)):
                    running[index] = [admitted, seed, 0, 1.0, False, []]
                    admitted += 1
            if not running or (left == 0 and not drain):
                break
            left, forward = left - 1, forward + 1
            active = list(running.items())
            tokens = self.step([s[1] for _, s in active], [s[2] for _, s in active], [s[5] for _, s in active])
            for (index, s), token in zip(active, map(int, tokens), strict=True):
                made = s[2]
                s[2] = made + 1
                s[5] = [*s[5], token][-size:]
                if not s[4]:  # latches
                    s[3] = min(max(s[3] * (up if token % 2 else down), 1e-300), 1e300)
                    s[4] = s[3] >= limit
                done = self.end(token) or made + 1 >= self.most
                out.append((lane, index, made, token, done, forward, len(active), s[4]))
                if done:
                    del running[index]
            if len(out) >= HELD:
                yield frame(out)
                out = []
        for index in before - set(running):
            self.active.removeKey((index,))
        for index, s in running.items():
            self.active.updateValue((index,), tuple(s))
        if drain:
            self.pending.clear()
        else:
            self._wait(queue)
        self.clock.update((forward, admitted))
        if out:
            yield frame(out)

    def _wait(self, queue: Iterator[tuple[int, int]]) -> None:
        """What is left of the queue, ``HELD`` streams at a time where none waited before."""
        left = list(queue) if self.pending.exists() else list(islice(queue, HELD))
        self.pending.put(left) if left else self.pending.clear()
        while more := list(islice(queue, HELD)):
            self.pending.appendList(more)

    def close(self) -> None:
        pass


def arrivals(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[int, int]]:
    """(input_index, seed) of the rows that are streams, a part at a time; they must be in order."""
    last = np.iinfo(np.int64).min
    for part in parts:
        part = part[part.input_index.notna()]
        index = part.input_index.to_numpy("int64")
        if len(index):
            if index[0] < last or (np.diff(index) < 0).any():
                raise ValueError("streams arrive out of order")
            last = index[-1]
        yield from zip(index.tolist(), part.seed.astype("int64").tolist(), strict=True)


def frame(out: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in OUT.split(", ")]
    return pd.DataFrame({name: np.array(column) for name, column in zip(names, zip(*out, strict=True), strict=True)})


def dealt(streams: DataFrame, lanes: int) -> DataFrame:
    """(lane, input_index, seed): streams in turn over lanes."""
    return streams.select(F.pmod("input_index", F.lit(lanes)).cast("int").alias("lane"), F.col("input_index").cast("long").alias("input_index"), F.col("seed").cast("long").alias("seed"))


def flush(spark, lanes: int) -> DataFrame:
    """A row a lane that drains it."""
    return spark.range(lanes).select(F.col("id").cast("int").alias("lane"), F.lit(None).cast("long").alias("input_index"), F.lit(0).cast("long").alias("seed"))


def batched(rows: DataFrame, step: Step, end: Callable[[int], bool], most: int, cap: int = RING, ring: int = RING, forwards: int = 64, bet: tuple[float, float, float] = (1.4, 0.9, 20.0)) -> DataFrame:
    """(lane, input_index, seed) -> OUT, batch or stream: a token a row, in a forward of its
    lane that had ``active`` streams. Needs the RocksDB state store."""
    if cap < 1 or ring < 1:
        raise ValueError("cap and ring must be at least 1")
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows.sparkSession.streams.active  # noqa: B018  a batch run needs the manager that places state
    ordered = not rows.isStreaming
    if ordered:
        rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "lane").sortWithinPartitions("lane", F.col("input_index").asc_nulls_first())
    return rows.groupBy("lane").transformWithStateInPandas(Lane(step, end, most, cap, ring, forwards, bet, ordered), OUT, "Append", "None")


def broken(cap: int) -> Column:
    """What a row breaks, or null: more active streams than the cap, or a forward of none."""
    return F.when(F.col("active") > cap, F.concat(F.lit("active "), F.col("active"), F.lit(f" over {cap}"))).when(F.col("active") < 1, F.lit("a forward without streams"))


def watched(out: DataFrame, cap: int, name: str = "batching") -> tuple[DataFrame, Observation | None]:
    """``out`` with its invariants: a row that breaks one fails the run, and metrics (tokens,
    forwards, most active) are observed for whoever listens; streams report them as the
    observed metrics of their progress under ``name``."""
    why = broken(cap)
    sound = out.withColumn("active", F.when(why.isNotNull(), F.raise_error(F.concat(F.lit("invariant: "), why)).cast("int")).otherwise(F.col("active")))
    metrics = [F.count(F.lit(1)).alias("tokens"), F.max("forward").alias("forwards"), F.max("active").alias("most_active"), F.count_if("done").alias("retired")]
    if out.isStreaming:
        return sound.observe(name, *metrics), None
    seen = Observation(name)
    return sound.observe(seen, *metrics), seen


def page_events(pages: DataFrame, page: Column, error_kind: Column, message: Column) -> DataFrame:
    """(page, json): an event a page, 1-based; a page with an error is skipped and says why,
    so a reader sees that it is missing."""
    skipped = F.struct(F.lit(1).alias("schema_version"), F.lit("page").alias("event"), F.lit("skipped").alias("status"), page.alias("page"), error_kind.alias("error_kind"), message.alias("message"))
    done = F.struct(F.lit(1).alias("schema_version"), F.lit("page").alias("event"), F.lit("ok").alias("status"), page.alias("page"))
    return pages.select(page.alias("page"), F.when(error_kind.isNotNull(), F.to_json(skipped)).otherwise(F.to_json(done)).alias("json"))
