"""Folds over ordered rows whose outcome depends on the order, with bounded state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def ordered_fold(df: DataFrame, key: str, order: list[str], schema: str, start: Callable[[], object], step: Callable[[object, tuple], list[tuple]], finish: Callable[[object, object], list[tuple]]) -> DataFrame:
    """Runs a fold over each key's rows in order and returns what it emits.

    Rows are partitioned by the key and sorted there, then stream through a
    task batch by batch: only the state of one key is in memory, whatever its
    size. step(state, row) and finish(key, state) give rows of `schema`.
    """
    columns = df.columns
    at = columns.index(key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [part.strip().split()[0] for part in schema.split(",")]
        current, state, begun = None, None, False
        for batch in batches:
            out: list[tuple] = []
            for row in batch.itertuples(index=False, name=None):
                if not begun or row[at] != current:
                    if begun:
                        out.extend(finish(current, state))
                    current, state, begun = row[at], start(), True
                out.extend(step(state, row))
            yield pd.DataFrame(out, columns=names)
        if begun:
            yield pd.DataFrame(finish(current, state), columns=names)

    return df.repartition(key).sortWithinPartitions(key, *order).select(*columns).mapInPandas(run, schema)
