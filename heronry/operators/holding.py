"""Holding patterns: a small network over headings resampled to even places in sliding windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PLACES = 30
#: A window's length, how far it slides, and how much of it has to be seen (seconds).
LENGTH, STEP, LEAST = 360, 120, 300
#: Windows that turn less are none (degrees).
LEAST_TURN = 180.0


def unwrapped(headings: np.ndarray) -> np.ndarray:
    """Headings without the jump from 360 to 0."""
    turns = (np.diff(headings) + 180.0) % 360.0 - 180.0
    return np.concatenate([headings[:1], headings[0] + np.cumsum(turns)]) if len(headings) else headings


def resampled(times: np.ndarray, headings: np.ndarray) -> np.ndarray:
    """Turn since the first place, at PLACES even times from the first to the last."""
    at = np.linspace(times[0], times[-1], PLACES)
    flat = np.interp(at, times, unwrapped(headings))
    return flat - flat[0]


def example(draw: np.random.Generator, holding: bool) -> tuple[np.ndarray, np.ndarray]:
    """(times, headings) of a window of flight that holds (turns and straight legs on a racetrack, or a circle), or does something else."""
    t = np.sort(np.append(draw.uniform(0, LENGTH, draw.integers(18, 90)), [0, LENGTH - draw.uniform(0, 40)]))
    side, rate = draw.choice([-1.0, 1.0]), draw.uniform(1.6, 3.4)
    if holding:
        leg, turn = (draw.uniform(0, 85), 180 / rate) if draw.uniform() < 0.85 else (0.0, 180 / rate)
        phase, cycle = draw.uniform(0, 2 * (leg + turn)), leg + turn
        s = t + phase
        heading = side * 180 * (s // cycle + np.clip((s % cycle) / turn, 0, 1))
    else:
        kind = draw.integers(0, 5)
        heading = np.zeros_like(t)
        begin = draw.uniform(0, 200)
        if kind == 0:  # straight, or a slow drift
            heading = draw.uniform(-0.35, 0.35) * t
        elif kind == 1:  # one turn of up to a half circle and a little
            heading = side * np.clip((t - begin) * rate, 0, draw.uniform(30, 225))
        elif kind == 2:  # turns one way and back
            heading = side * draw.uniform(20, 150) * np.sin(2 * np.pi * t / draw.uniform(120, 400))
        elif kind == 3:  # an approach: two or three turns of a quarter, some way and the other
            for k in range(draw.integers(2, 4)):
                heading = heading + draw.choice([-1.0, 1.0]) * np.clip((t - begin - 70 * k) * rate, 0, 90)
        else:  # lost signals: jumps
            heading = np.cumsum(draw.normal(0, 4, len(t)))
    return t, (heading + draw.uniform(0, 360) + draw.normal(0, 2.0, len(t))) % 360


def examples(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(turns by place, whether it holds) of n windows, half of them holding."""
    draw = np.random.default_rng(seed)
    held = np.arange(n) % 2 == 0
    return np.stack([resampled(*example(draw, bool(h))) for h in held]), held.astype(float)


class Network:
    """Two hidden layers over the turns and their steps; trained by Adam on examples from a seed."""

    def __init__(self, n_examples: int = 6000, seed: int = 11, rounds: int = 60):
        x, y = examples(n_examples, seed)
        draw = np.random.default_rng(seed)
        x = self.features(x)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        sizes = [x.shape[1], 24, 8, 1]
        self.w = [draw.normal(0, np.sqrt(2 / a), (a, b)) for a, b in zip(sizes, sizes[1:])]
        self.b = [np.zeros(b) for b in sizes[1:]]
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (*self.w, *self.b)]
        x, step = (x - self.mean) / self.scale, 0
        for _ in range(rounds):
            order = draw.permutation(len(x))
            for k in range(0, len(x), 200):
                part, step = order[k : k + 200], step + 1
                layers = self.layers(x[part])
                grad = ((1 / (1 + np.exp(-layers[-1][:, 0])) - y[part]) / len(part))[:, None]
                grads: list[np.ndarray] = []
                for i in range(len(self.w) - 1, -1, -1):
                    grads[:0] = [layers[i].T @ grad + 1e-4 * self.w[i]]
                    grads.append(grad.sum(axis=0))
                    if i:
                        grad = (grad @ self.w[i].T) * (layers[i] > 0)
                biases = grads[len(self.w) :][::-1]
                for p, g, m in zip((*self.w, *self.b), (*grads[: len(self.w)], *biases), moments):
                    m[0] = 0.9 * m[0] + 0.1 * g
                    m[1] = 0.999 * m[1] + 0.001 * g * g
                    p -= 0.004 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)

    @staticmethod
    def features(turns: np.ndarray) -> np.ndarray:
        """Left and right alike: the turns are mirrored so that they end on one side; beside them stand their steps."""
        side = np.where(turns[:, -1:] < 0, -1.0, 1.0)
        turns = turns * side
        return np.concatenate([turns, np.diff(turns, axis=1)], axis=1)

    def layers(self, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        for i, (w, b) in enumerate(zip(self.w, self.b)):
            x = x @ w + b
            out.append(np.maximum(x, 0) if i < len(self.w) - 1 else x)
            x = out[-1]
        return out

    def holds(self, turns: np.ndarray) -> np.ndarray:
        return self.layers((self.features(turns) - self.mean) / self.scale)[-1][:, 0] > 0 if len(turns) else np.zeros(0, bool)


def holding_windows(points: DataFrame, key: str, network: Network, unit: float = 1.0) -> DataFrame:
    """(key, w, first, last) of the windows that hold, of points (key, at, heading) in seconds; `unit` stretches the windows' lengths.

    A point goes to the windows that it lies in, and a window is a group of
    its own: what comes together is bounded by a window's length. Repeated
    times of a window are one point.
    """
    kind, step = points.schema[key].dataType.simpleString(), STEP * unit
    last = F.floor(F.col("at") / step)
    dealt = points.dropna().withColumn("w", F.explode(F.sequence(last - LENGTH // STEP + 1, last)))
    one = dealt.groupBy(key, "w", "at").agg(F.min("heading").cast("double").alias("heading"))
    windows = one.groupBy(key, "w").agg(F.array_sort(F.collect_list(F.struct(F.col("at").cast("double").alias("at"), "heading"))).alias("p"))
    long_ = (F.element_at("p", -1)["at"] - F.element_at("p", 1)["at"]) >= LEAST * unit
    listed = windows.filter(long_).select(key, "w", F.transform("p", lambda x: x["at"]).alias("times"), F.transform("p", lambda x: x["heading"]).alias("headings"))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            turned = [np.ptp(unwrapped(np.asarray(h, float))) >= LEAST_TURN for h in batch["headings"]]
            part = batch[np.array(turned, bool)] if len(batch) else batch
            turns = np.stack([resampled(np.asarray(t, float), np.asarray(h, float)) for t, h in zip(part["times"], part["headings"])]) if len(part) else np.zeros((0, PLACES))
            part = part[network.holds(turns)]
            yield pd.DataFrame({key: part[key], "w": part["w"], "first": [t[0] for t in part["times"]], "last": [t[-1] for t in part["times"]]})

    return listed.mapInPandas(judge, f"`{key}` {kind}, w long, first double, last double")


def holdings(windows: DataFrame, key: str) -> DataFrame:
    """(key, start, end, n_windows): windows that follow one another are one pattern."""
    w = Window.partitionBy(key).orderBy("w")  # the windows that hold, not the points
    island = F.col("w") - F.row_number().over(w)
    return windows.withColumn("island", island).groupBy(key, "island").agg(F.min("first").alias("start"), F.max("last").alias("end"), F.count("*").alias("n_windows")).drop("island")
