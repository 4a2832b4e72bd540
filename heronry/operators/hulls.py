"""Convex hulls of grouped points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corners(points: np.ndarray) -> np.ndarray:
    """Corners of the hull, counterclockwise from the lowest x; points on an edge are none."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def side(ordered: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in ordered:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(side(points) + side(points[::-1]))


def convex_hull(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, place, x, y) of the corners of each key's hull.

    The hull of a union is the hull of the parts' hulls: each batch of rows
    keeps its own corners, so a key's points never come together, only corners.
    """
    kind = df.schema[key].dataType.simpleString()

    def of_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, part in batch.groupby(key):
                found = corners(part[[x, y]].to_numpy())
                yield pd.DataFrame({key: k, x: found[:, 0], y: found[:, 1]})

    def whole(part: pd.DataFrame) -> pd.DataFrame:
        found = corners(part[[x, y]].to_numpy())
        return pd.DataFrame({key: part[key].iloc[0], "place": np.arange(len(found)), x: found[:, 0], y: found[:, 1]})

    own = df.select(key, F.col(x).cast("double"), F.col(y).cast("double")).dropna()
    return own.mapInPandas(of_batches, f"`{key}` {kind}, `{x}` double, `{y}` double").groupBy(key).applyInPandas(whole, f"`{key}` {kind}, place long, `{x}` double, `{y}` double")
