"""Sequential tests over ordered streams: folds of one key's steps.

A step multiplies the running value and clamps it, and later steps depend on it, so sums
of logs would not do. Rows are dealt by key and sorted within partitions, which spills;
the fold passes over them with a state of a few numbers, so a key's steps are never one
value in memory. streaming.pages has the same with kept state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .tables import visible

#: The running value never leaves these bounds (fixed values).
LOWEST, HIGHEST = 1e-300, 8.98846567431158e307


def folded(rows: DataFrame, key: str, order: list[str], cols: list[str], start: tuple, step: Callable[..., tuple], out: list[tuple[str, pa.DataType, int]]) -> DataFrame:
    """(key, fields of the last state): ``step(state, *cols)`` over each key's rows in
    order, ties by ``cols``. ``out`` names the fields, their types and places."""
    visible(rows.sparkSession)
    sorted_rows = rows.repartition(key).sortWithinPartitions(key, *order, *cols).select(key, *cols)
    names = {pa.int64(): "long", pa.float64(): "double"}
    schema = ", ".join([f"`{key}` {rows.schema[key].dataType.simpleString()}", *(f"{n} {names[t]}" for n, t, _ in out)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, kind = None, None, None

        def batch(done: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array([k for k, _ in done], kind), *(pa.array([s[at] for _, s in done], t) for _, t, at in out)]
            return pa.record_batch(columns, names=[key, *(n for n, _, _ in out)])

        for b in batches:
            kind, done = b.schema.field(0).type, []
            for k, *x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if state is None or k != now:
                    if state is not None:
                        done.append((now, state))
                    now, state = k, start
                state = step(state, *x)
            if done:
                yield batch(done)
        if state is not None:
            yield batch([(now, state)])

    return sorted_rows.mapInArrow(run, schema)


def clamped(e: float) -> float:
    return max(LOWEST, min(HIGHEST, e))


def betting(rows: DataFrame, key: str, order: list[str], up: float, down: float, alpha: float) -> DataFrame:
    """(key, e, n, crossed): the product of ``up`` for alarms and ``down`` otherwise, and
    the first step at which it reached 1 / alpha."""

    def step(s: tuple, alarm: bool | None) -> tuple:
        e, n = clamped(s[0] * (up if alarm else down)), s[1] + 1
        return e, n, n if s[2] is None and e >= 1 / alpha else s[2]

    return folded(rows, key, order, ["alarm"], (1.0, 0, None), step, [("e", pa.float64(), 0), ("n", pa.int64(), 1), ("crossed", pa.int64(), 2)])


def guard(rows: DataFrame, key: str, order: list[str], margin_at: float, cadence: int, up: float, down: float, alpha: float) -> DataFrame:
    """(key, steps, audits, accepted, tripped_at) of a latching guard: a step is verified
    if the guard has tripped, its margin (``value``) is low or not finite, or the last
    audit was ``cadence`` steps ago; only verified steps feed the test."""

    def step(s: tuple, alarm: bool | None, margin: float | None) -> tuple:
        e, since, n, audits, accepted, at = s
        n += 1
        low = margin is None or margin - margin != 0 or margin < margin_at
        if at is not None or low or since + 1 >= cadence:
            since = 0
            if at is None:
                audits += 1
                e = clamped(e * (up if alarm else down))
                at = n if e >= 1 / alpha else None
        else:
            since += 1
            accepted += alarm is False
        return e, since, n, audits, accepted, at

    fields = [("steps", 2), ("audits", 3), ("accepted", 4), ("tripped_at", 5)]
    return folded(rows, key, order, ["alarm", "value"], (1.0, 0, 0, 0, 0, None), step, [(n, pa.int64(), i) for n, i in fields])
