"""Operators with state of their own for each key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def silent_gaps(stream: DataFrame, key: str, hours: float) -> DataFrame:
    """(key, gap_start, gap_end) of pauses over `hours` in a stream (key, ts).

    The state is the last time seen, in microseconds. A batch's times of a key
    are sorted; a time before the last one seen comes too late and is passed over.
    """
    least = int(hours * 3600 * 1_000_000)
    rows = stream.select(F.col(key), F.unix_micros("ts").alias("at")).dropna()

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        at = pd.concat([b["at"] for b in batches]).sort_values().to_numpy()
        if last is not None:
            at = at[at > last]
        if len(at) == 0:
            return
        before = at[:-1] if last is None else [last, *at[:-1]]
        after = at[1:] if last is None else at
        gaps = [(keys[0], a, b) for a, b in zip(before, after) if b - a > least]
        state.update((int(at[-1]),))
        yield pd.DataFrame(gaps, columns=[key, "a", "b"])

    kind = dict(stream.dtypes)[key]
    gaps = rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, a long, b long", "last long", "append", GroupStateTimeout.NoTimeout)
    return gaps.select(key, F.timestamp_micros("a").alias("gap_start"), F.timestamp_micros("b").alias("gap_end"))
