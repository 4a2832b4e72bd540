"""Clusters against plain k-means in Python integers."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from heronry.llm import clusters

FOLDER = "/root/testdata/sf0.001"


def brute(rows, k=40, rounds=5, size=64):
    kept = [(i, [max(-(1 << 27), min(1 << 27, math.floor(256 * x))) for x in v], v) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (hashlib.sha256(f"2:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[2]))
    c = [v for _, v, _ in kept[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, x)), n) for n, x in enumerate(c))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v, _ in kept]
        for n in range(len(c)):
            mine = [v for (_, v, _), o in zip(kept, own) if o == n]
            if mine:
                c[n] = [sum(col) // len(mine) for col in zip(*mine)]
    found = [(i, *nearest(v)) for i, v, _ in kept]
    inertia = {n: sum(d for _, d, m in found if m == n) for n in range(len(c))}
    big = (1 << 63) - 1
    return sorted(((i, n, d, min(big, inertia[n]), min(big, sum(inertia.values())), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for i, d, n in found), key=repr)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_table(spark):
    vectors = spark.read.parquet(f"{FOLDER}/embeddings.parquet").limit(150)
    assert rows_of(clusters.report(vectors)) == brute([tuple(r)[:2] for r in vectors.collect()])


@pytest.mark.parametrize("options", [{"block": 7}, {"block": 1000, "k": 5}, {"rounds": 0}, {"rounds": 9, "k": 3}])
def test_ties_and_odd_rows(spark, options):
    draw = random.Random(3)
    rows = [(n % 90, [draw.choice([0.0, 0.01, 0.5, -0.5]) for _ in range(4)]) for n in range(200)]
    rows += [(None, [0.5] * 4), (None, [0.5] * 4), (500, None), (501, []), (502, [0.1] * 3), (503, [0.1, None, 0.1, 0.1]), (504, [float("nan")] * 4), (505, [float("inf"), 0.0, 0.0, 0.0]), (506, [1e30, -1e30, 0.0, 1e5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS cluster", "'x' AS sums", "2 AS vector")
    assert rows_of(clusters.report(df, size=4, **options)) == brute(rows, size=4, **{a: b for a, b in options.items() if a != "block"})


def test_bounds_skip_and_stay_exact():
    """Few distances are computed once the centroids settle, and none that decides is missed."""
    draw = np.random.default_rng(5)
    middle = draw.integers(-250, 250, (12, 16))
    x = (middle[draw.integers(0, 12, 3000)] + draw.integers(-30, 30, (3000, 16))).astype(float)
    c = x[:12].astype(np.int64)
    own, d2, lower = clusters.assign_first(x, c.astype(float))
    upper, share = clusters.root_above(d2), []
    for _ in range(6):
        new = np.array([np.floor(x[own == k].mean(axis=0)) if (own == k).any() else c[k] for k in range(12)]).astype(np.int64)
        of, c = clusters.Centroids(new, c), new
        own, upper, lower, n = clusters.assign_next(x, c.astype(float), of, own, clusters.stored_above(upper).astype(float), clusters.stored_below(lower).astype(float))
        assert (own == clusters.assign_first(x, c.astype(float))[0]).all()
        share.append(n / (3000 * 12))
    assert share[-1] < 0.25


def test_rounding_is_outwards():
    x = np.random.default_rng(1).uniform(0, 70000, 10000)
    assert (clusters.stored_above(x) >= x).all() and (clusters.stored_below(x) <= x).all()


def test_empty(spark):
    assert clusters.report(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
