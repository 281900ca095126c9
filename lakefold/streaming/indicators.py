"""Indicators kept up to date on a stream: the state of a series is two numbers, never its history."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def online_ema(stream: DataFrame, key: str, time: str, value: str, span: int) -> DataFrame:
    """key, time, ema after every row: the exponentially weighted mean with normalised weights. Rows of a
    micro-batch are taken in order of time; rows that come in a later batch count as later. Null values
    leave the mean as it is."""
    alpha = 2 / (span + 1)
    types = dict(stream.dtypes)

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, weight = state.get if state.exists else (0.0, 0.0)
        rows = pd.concat(list(frames)).sort_values(time, kind="stable")
        out = []
        for at, x in zip(rows[time], rows[value]):
            if pd.notna(x):
                total, weight = total * (1 - alpha) + x, weight * (1 - alpha) + 1
            out.append((name[0], at, total / weight if weight else None))
        state.update((total, weight))
        yield pd.DataFrame(out, columns=[key, time, "ema"])

    return stream.select(key, time, value).groupBy(key).applyInPandasWithState(
        step, f"`{key}` {types[key]}, `{time}` {types[time]}, ema double", "total double, weight double", "append", GroupStateTimeout.NoTimeout
    )
