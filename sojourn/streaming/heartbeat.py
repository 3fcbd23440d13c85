"""The change-or-heartbeat writer over a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


class _Thin:
    """The fold of W3: what is written depends on the last row written."""

    def __init__(self, days: float):
        self.gap = int(days * 86_400_000_000)

    def keep(self, last: tuple[int, int] | None, price: int, at: int) -> bool:
        return last is None or price != last[0] or at - last[1] > self.gap


def heartbeat_stream(stream: DataFrame, key: str, at: str, price: str, days: float = 7.0) -> DataFrame:
    """W3/M3 over a stream: the same rule with the last row written as state, rows of a batch in order of time."""
    fold = _Thin(days)
    kinds = {c: stream.schema[c].dataType.simpleString() for c in (key, at, price)}

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = tuple(state.get) if state.exists else None
        rows = pd.concat(list(batches)).sort_values(at, kind="stable")
        kept = []
        for t, p in zip(rows[at], rows[price], strict=True):
            us = int(t.value // 1000)
            if fold.keep(last, int(p), us):
                last = (int(p), us)
                kept.append((group[0], t, p))
        if last is not None:
            state.update(last)
        yield pd.DataFrame(kept, columns=[key, at, price])

    schema = f"{key} {kinds[key]}, {at} {kinds[at]}, {price} {kinds[price]}"
    return stream.select(key, at, price).groupBy(key).applyInPandasWithState(run, schema, "price long, at long", "append", GroupStateTimeout.NoTimeout)
