"""Ridge logistic regressions of several features, one for each key, by Newton's steps over summed matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.operators.graphs import cut
from heronry.operators.joins import few

MOST_STEPS, SETTLED = 40, 1e-8


def matrix_of(frame: pd.DataFrame, features: list[str]) -> np.ndarray:
    return np.column_stack([np.ones(len(frame)), frame[features].to_numpy(float)])


def sums(rows: DataFrame, key: str, features: list[str], outcome: str, coefficients: DataFrame) -> DataFrame:
    """(key, coefficients, sums): gradient, then the rows of the Hessian, added up over each key's rows.

    Each batch adds up its own rows first, so what is shuffled is one row of
    sums for a key and batch.
    """
    kind, size = rows.schema[key].dataType.simpleString(), len(features) + 1

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, part in batch.groupby(key):
                x, y, b = matrix_of(part, features), part[outcome].to_numpy(float), np.asarray(part["coefficients"].iloc[0], float)
                p = 1 / (1 + np.exp(-(x @ b)))
                g, h = x.T @ (y - p), (x * (p * (1 - p))[:, None]).T @ x
                out += [(k, j, v) for j, v in enumerate(np.concatenate([g, h.reshape(-1)]).tolist())]
            yield pd.DataFrame(out, columns=[key, "j", "v"])

    joined = rows.join(F.broadcast(coefficients) if few(coefficients) else coefficients, key)
    added = joined.mapInPandas(partial, f"`{key}` {kind}, j int, v double").groupBy(key, "j").agg(F.sum("v").alias("v"))
    listed = added.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("s"))  # size + size^2 entries
    return listed.select(key, F.transform("s", lambda e: e["v"]).alias("sums")).join(coefficients, key).filter(F.size("sums") == size + size * size)


def ridge_logistic(rows: DataFrame, key: str, features: list[str], outcome: str, penalty: float) -> DataFrame:
    """(key, coefficients, steps), the intercept first and unpenalised; keys with one outcome only have none. Rows with a null go."""
    kind, size = rows.schema[key].dataType.simpleString(), len(features) + 1
    clean = cut(rows.select(key, *(F.col(f).cast("double") for f in features), F.col(outcome).cast("double")).dropna())
    both = clean.groupBy(key).agg(F.min(outcome).alias("a"), F.max(outcome).alias("b")).filter("a < b")
    live = cut(both.select(key, F.array(*[F.lit(0.0)] * size).alias("coefficients"), F.lit(0).alias("steps")))
    ridge = np.array([0.0, *[penalty] * len(features)])

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, s, b, n in zip(batch[key], batch["sums"], batch["coefficients"], batch["steps"]):
                b, s = np.asarray(b, float), np.asarray(s, float)
                move = np.linalg.lstsq(s[size:].reshape(size, size) + np.diag(ridge), s[:size] - ridge * b, rcond=None)[0]
                out.append((k, (b + move).tolist(), n + 1, bool(np.abs(move).max() < SETTLED)))
            yield pd.DataFrame(out, columns=[key, "coefficients", "steps", "settled"])

    done = None
    for n in range(MOST_STEPS):
        moved = cut(sums(clean, key, features, outcome, live).mapInPandas(step, f"`{key}` {kind}, coefficients array<double>, steps int, settled boolean"))
        ended = moved.filter("settled" if n < MOST_STEPS - 1 else "true").drop("settled")
        done = ended if done is None else done.unionByName(ended)
        live = moved.filter("not settled").drop("settled")
        if live.isEmpty():
            break
    return done
