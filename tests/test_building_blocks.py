"""Projections, chains, ranks, interval pairs, hulls, sentences and the shared folder: brute force and edge cases."""

from __future__ import annotations

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heronry.functions.project import mark_internal, project, public_columns
from heronry.functions.readings import dates_in, features_in, number_range
from heronry.operators import joins
from heronry.operators.graphs import resolve_chains
from heronry.operators.hulls import convex_hull
from heronry.operators.windows import values_at_ranks
from heronry.session import shared_folder

DAY = datetime.date(2020, 1, 1)


def test_projection(spark):
    df = spark.sql("SELECT 1 AS a, named_struct('b', 2, 'hidden', 3) AS s, array(named_struct('c', 4, 'hidden', 5), NULL) AS l, CAST(NULL AS array<struct<c:int>>) AS n")
    assert project(df, ["a", "s.b", "l[].c", "n[].c"]).first().asDict(recursive=True) == {"a": 1, "s": {"b": 2}, "l": [{"c": 4}, {"c": None}], "n": None}
    for path in ("x", "s.x", "l[].x", "a.b", "a[].b"):
        with pytest.raises(ValueError):
            project(df, [path])
    assert public_columns(mark_internal(df, "s", "n")) == ["a", "l"]


def test_chains(spark):
    links = [(k, k - 1) for k in range(1, 40)] + [(100, 101), (101, 102), (102, 100)] + [(200, 100)]
    got = {r.k: r.root for r in resolve_chains(spark.createDataFrame(links, "k long, up long"), most=9).collect()}
    assert got == {k: 0 for k in range(1, 40)}
    assert resolve_chains(spark.createDataFrame([], "k long, up long")).count() == 0


@pytest.mark.parametrize("bins", [1, 7, 1024])
def test_values_at_ranks(spark, bins):
    rng = random.Random(4)
    rows = [("a", rng.choice([1.0, 2.5, 2.5, 9.0, -3.0])) for _ in range(57)] + [("b", rng.gauss(0, 100)) for _ in range(40)] + [("c", 5.0), ("c", None), ("d", None)]
    got = {r.k: (r.first, r.mid, r.last) for r in values_at_ranks(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"first": F.lit(1), "mid": F.ceil(F.col("n") / 2), "last": F.col("n")}, bins).collect()}
    want = {}
    for k in "abc":
        v = sorted(x for g, x in rows if g == k and x is not None)
        want[k] = (v[0], v[-(-len(v) // 2) - 1], v[-1])
    assert got == want


@pytest.mark.parametrize("margin", [0, 3])
def test_overlapping_pairs(spark, margin):
    rng = random.Random(8)
    spans = [(k, rng.randrange(3), a, a + rng.choice([0, 1, 10, 200])) for k in range(60) for a in [rng.randrange(400)]]
    day = lambda n: DAY + datetime.timedelta(days=n)
    left = spark.createDataFrame([(k, w, day(a), day(b)) for k, w, a, b in spans], "id long, who long, s date, e date")
    right = left.select("who", F.col("id").alias("other"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    got = sorted((r.id, r.other) for r in joins.overlapping_pairs(left, right, "who", "s", "e", "s2", "e2", margin, days=16).collect())
    assert got == sorted((k, j) for k, w, a, b in spans for j, v, c, d in spans if w == v and a <= d + margin and c <= b + margin)


def test_salted_buckets(spark, monkeypatch):
    day = lambda n: DAY + datetime.timedelta(days=n)
    probes = spark.createDataFrame([(day(n),) for n in range(0, 90, 7)], "p date")
    spans = spark.createDataFrame([(k, day(k), day(k + k % 30)) for k in range(100)], "id long, s date, e date")
    run = lambda: sorted((r.p, r.id) for r in joins.containing_intervals(probes, "p", spans, "s", "e").collect())
    broadcast = run()
    monkeypatch.setattr(joins, "few", lambda df: False)
    assert run() == broadcast == sorted((day(n), k) for n in range(0, 90, 7) for k in range(100) if k <= n <= k + k % 30)


def test_hulls(spark):
    rng = np.random.default_rng(2)
    points = {0: rng.integers(0, 9, (80, 2)), 1: np.array([[0, 0], [1, 1], [2, 2]]), 2: np.array([[5, 5], [5, 5]]), 3: rng.integers(0, 3, (4, 2))}
    rows = [(k, float(x), float(y)) for k, p in points.items() for x, y in p.tolist()] + [(4, None, 1.0)]
    found = convex_hull(spark.createDataFrame(rows, "k long, x double, y double").repartition(5), "k", "x", "y").collect()
    for k, p in points.items():
        own = {tuple(map(float, x)) for x in p.tolist()}
        turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
        inside = lambda a, b, c: turn(a, b, c) == 0 and min(a, b) < c < max(a, b)
        edges = [(a, b) for a in own for b in own if a != b and all(turn(a, b, c) > 0 or inside(a, b, c) for c in own - {a, b})]
        want = {a for e in edges for a in e} or own
        if len({x for x in own}) > 2 and all(turn(*sorted(own)[:2], c) == 0 for c in own):
            want = {min(own), max(own)}
        assert {(r.x, r.y) for r in found if r.k == k} == want, k
    assert not [r for r in found if r.k == 4]


def test_sentences(spark):
    one = lambda **columns: spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()
    told = F.lit("2020-03-01").cast("date")
    r = one(a=number_range(F.lit("entre tres y siete drones")), b=number_range(F.lit("none at all")), c=number_range(F.lit(None).cast("string")), d=dates_in(F.lit("am 24. Dezember"), told), e=dates_in(F.lit("hace 3 días"), told), f=dates_in(F.lit("on 31 April"), told), g=features_in(F.lit("no big loud jet, loud"), ["jet", "loud"], ["no"]))
    assert tuple(r.a) == (3, 7) and tuple(r.b) == tuple(r.c) == (None, None)
    assert r.d == datetime.date(2019, 12, 24) and r.e == datetime.date(2020, 2, 27) and r.f is None
    assert [tuple(x) for x in r.g] == [("loud", True), ("jet", True), ("loud", False)]


def test_no_machine_local_folder_on_a_cluster():
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError):
        shared_folder(Session())
