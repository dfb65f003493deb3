"""Keyed page streams with kept state.

Steps of a stream arrive in any micro-batches; results of one key never depend on how
keys and steps are batched. Steps within a batch are taken in order; the state is a few
numbers a key, or a ring of bounded length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

GUARD = "user_id bigint, steps bigint, audits bigint, accepted bigint, e double, tripped_at bigint"
_GUARD_STATE = "e double, since bigint, steps bigint, audits bigint, accepted bigint, tripped_at bigint"
TOKENS = "user_id bigint, step bigint, token bigint, done boolean"


def guarded(steps: DataFrame, margin_at: float, cadence: int, up: float, down: float, alpha: float) -> DataFrame:
    """operators.sequential.guard over a stream of (user_id, ts, event_id, alarm, value):
    a row a key and micro-batch with what holds so far (update mode)."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        e, since, n, audits, accepted, at = state.get if state.exists else (1.0, 0, 0, 0, 0, -1)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"], kind="stable")
        for alarm, margin in zip(rows["alarm"], rows["value"], strict=True):
            n += 1
            finite = margin == margin and abs(margin) != float("inf")
            verify = at >= 0 or not finite or margin < margin_at or since + 1 >= cadence
            if verify:
                since = 0
                if at < 0:
                    audits += 1
                    e = min(max(e * (up if alarm else down), 1e-300), 8.98846567431158e307)
                    at = n if e >= 1 / alpha else at
            else:
                since += 1
                accepted += not alarm
        state.update((float(e), int(since), int(n), int(audits), int(accepted), int(at)))
        yield pd.DataFrame({"user_id": [key[0]], "steps": [n], "audits": [audits], "accepted": [accepted], "e": [e], "tripped_at": [None if at < 0 else at]}).astype({"tripped_at": "Int64"})

    return steps.groupBy("user_id").applyInPandasWithState(update, GUARD, _GUARD_STATE, "update", GroupStateTimeout.NoTimeout)


def generated(steps: DataFrame, step: "callable", end: int, most: int) -> DataFrame:
    """Continuous batching: ``step(history, rows)`` gives a stream's next tokens from its
    own history alone; a stream is over at ``end`` or after ``most`` tokens, and what
    arrives later is dropped. The user-supplied function is the model's place."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        history, over = ([int(x) for x in state.get[0].split(",") if x], state.get[1]) if state.exists else ([], False)
        first = len(history)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"], kind="stable")
        for token in () if over else step(list(history), rows):
            history.append(int(token))
            over = token == end or len(history) >= most
            if over:
                break
        state.update((",".join(map(str, history)), bool(over)))
        new = history[first:]
        yield pd.DataFrame({"user_id": key[0], "step": range(first, len(history)), "token": new, "done": [over and i == len(new) - 1 for i in range(len(new))]})

    return steps.groupBy("user_id").applyInPandasWithState(update, TOKENS, "history string, over boolean", "append", GroupStateTimeout.NoTimeout)


def windowed(events: DataFrame, size: str = "5 minutes", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """An extension of the Spark side: event-time windows with a watermark."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", size, slide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
