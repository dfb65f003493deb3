"""Greedy merging of adjacent symbols by rank, in n log n steps."""

from __future__ import annotations

import heapq
from collections.abc import Callable


def merge_linked[S: (str, bytes)](symbols: list[S], rank: Callable[[S, S], int | None]) -> list[S]:
    """The adjacent pair of least rank merges, the leftmost of equals, until no pair has a
    rank. Symbols are linked both ways and pairs wait in a heap; a pair whose symbols have
    changed since is passed over."""
    n = len(symbols)
    if n < 2:
        return symbols
    parts: list[S | None] = list(symbols)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    waiting = [(r, i, len(a) + len(b)) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := rank(a, b)) is not None]
    heapq.heapify(waiting)

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (r := rank(parts[i], parts[j])) is not None:
            heapq.heappush(waiting, (r, i, len(parts[i]) + len(parts[j])))

    while waiting:
        r, i, size = heapq.heappop(waiting)
        if parts[i] is None or after[i] >= n:
            continue
        j = after[i]
        if len(parts[i]) + len(parts[j]) != size or rank(parts[i], parts[j]) != r:
            continue
        parts[i] += parts[j]
        parts[j] = None
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [p for p in parts if p is not None]
