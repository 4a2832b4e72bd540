"""Holding patterns on held-out tracks, and pairs near in time and space, against plain Python."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heronry.operators import holding
from heronry.operators.nearby import near_buckets, near_pairs


@pytest.fixture(scope="module")
def network():
    return holding.Network()


def test_accuracy_on_other_tracks(network):
    x, y = holding.examples(2000, seed=99)
    assert (network.holds(x) == (y > 0)).mean() > 0.95


def test_shapes_that_are_not_in_the_generator(network):
    """A triangle and a square flown round and round hold; a long dog-leg and a zigzag don't."""
    t = np.arange(0, 360, 6.0)
    rounds = {"triangle": 120.0 * (t // 55), "square": 90.0 * (t // 40), "wide circle": t * 1.5}
    others = {"dog-leg": np.where(t < 150, 10.0, 65.0), "zigzag": np.where(t // 40 % 2 == 0, 40.0, -60.0), "reversal": np.clip((t - 100) * 3, 0, 180)}
    told = {n: bool(network.holds(holding.resampled(t, h % 360)[None])[0]) for n, h in (rounds | others).items()}
    assert told == dict.fromkeys(rounds, True) | dict.fromkeys(others, False)


def test_unwrapping_and_resampling():
    assert holding.unwrapped(np.array([350.0, 10.0, 30.0, 350.0])).tolist() == [350.0, 370.0, 390.0, 350.0]
    t, h = np.array([0.0, 100.0, 290.0]), np.array([350.0, 90.0, 80.0])
    want = [0 + 100 * x / 100 if x <= 100 else 100 - 10 * (x - 100) / 190 for x in np.linspace(0, 290, holding.PLACES)]
    assert np.allclose(holding.resampled(t, h), want)


def test_windows_by_hand(spark, network):
    draw = random.Random(1)
    rows = [(k, float(s), (s * 3.0 if k == "hold" and 600 <= s < 1500 else 45.0) % 360) for k in ("hold", "straight") for s in sorted(draw.sample(range(2400), 400))]
    df = spark.createDataFrame(rows + [("hold", None, 1.0), ("short", 5.0, 1.0)] + rows[:3], "k string, at double, heading double")
    want = set()
    for key in ("hold", "straight"):
        for w in range(-2, 20):
            part = [(a, h) for k, a, h in rows if k == key and w * 120 <= a < w * 120 + 360]
            if len(part) > 1 and part[-1][0] - part[0][0] >= 300:
                a, h = np.array(part).T
                if np.ptp(holding.unwrapped(h)) >= 180 and network.holds(holding.resampled(a, h)[None])[0]:
                    want.add((key, w, a[0], a[-1]))
    windows = holding.holding_windows(df, "k", network)
    assert {tuple(r) for r in windows.collect()} == want and want
    found = holding.holdings(windows, "k").collect()
    assert len(found) == 1 and 480 <= found[0].start <= 720 and 1380 <= found[0].end <= 1680


def test_near_pairs(spark):
    draw = random.Random(2)
    rows = [(draw.randrange(2), k, draw.choice([draw.uniform(-85, 85), 10.0]), draw.choice([draw.uniform(-180, 180), 179.9, -179.9]), draw.randrange(0, 20 * 86400)) for k in range(400)]
    got = {(r.a, r.b) for r in near_pairs(spark.createDataFrame(rows, "n long, id long, lat double, lon double, at long"), 700, 86400, ["n"]).collect()}

    def km(a, b):
        h = math.sin(math.radians(b[2] - a[2]) / 2) ** 2 + math.cos(math.radians(a[2])) * math.cos(math.radians(b[2])) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(min(1, h)))

    assert got == {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and abs(a[4] - b[4]) <= 86400 and km(a, b) <= 700} and got


def test_near_pairs_deals_a_record_to_few_buckets(spark):
    draw = random.Random(3)
    rows = [(k, draw.uniform(-70, 70), draw.uniform(-180, 180), draw.randrange(0, 90 * 86400), "ab"[k % 2]) for k in range(2000)]
    df = spark.createDataFrame(rows, "id long, lat double, lon double, at long, kind string")
    dealt, own = near_buckets(400.0, 2 * 86400, 10.0)
    sizes = df.select(F.size(dealt).alias("n"), F.array_contains(dealt, own).alias("own")).agg(F.avg("n"), F.bool_and("own")).first()
    assert sizes[0] < 7 and sizes[1]
    pairs = near_pairs(df, 400.0, 2 * 86400, also=["kind"]).collect()
    assert pairs and all((r.kind_a, r.kind_b) == ("ab"[r.a % 2], "ab"[r.b % 2]) and r.a < r.b for r in pairs)
