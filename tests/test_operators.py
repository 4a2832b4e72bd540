"""Operators against brute force, and their edge cases."""

from __future__ import annotations

import datetime
import math
import random
from collections import defaultdict
from pathlib import Path

from compare import differences

from heronry.operators.graphs import connected_components, paths
from heronry.operators import joins
from heronry.operators.phrases import containing, similar_sets
from heronry.operators.windows import ewma
from heronry.plans.catalogue import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


def events_by_user(spark):
    found = defaultdict(list)
    for r in spark.read.parquet(f"{FOLDER}/events.parquet").collect():
        found[r.user_id].append((int(r.ts.timestamp()), r.event_id, r.event_type, r.value))
    return {u: sorted(rows) for u, rows in found.items()}


def test_online_cluster(spark):
    want = []
    for user, rows in events_by_user(spark).items():
        clusters = []  # [kind, times, values]
        for s, _, kind, value in rows:
            fit = [c for c in clusters if c[0] == kind and s - c[1][-1] <= 12 * 3600 and abs(sum(c[2]) / len(c[2]) - value) <= 25]
            if not fit:
                clusters.append([kind, [s], [value]])
                continue
            fit.sort(key=lambda c: (abs(sum(c[2]) / len(c[2]) - value), c[1][0]))
            fit[0][1].append(s)
            fit[0][2].append(value)
        want += [(user, k, t[0], t[-1], len(v), round(sum(v) / len(v), 3)) for k, t, v in clusters]
    got = [(r.user_id, r.event_type, r.start_s, r.last_s, r.n, round(r.mean, 3)) for r in QUERIES["online_cluster"](spark, FOLDER).collect()]
    assert sorted(r[:5] for r in got) == sorted(r[:5] for r in want)


def test_reoccurrence_split(spark):
    want = []
    for user, rows in events_by_user(spark).items():
        groups = []
        for s, _, kind, _ in rows:
            if groups and s - groups[-1][-1] <= 48 * 3600 and not (kind == "purchase" and s - groups[-1][0] >= 18 * 3600):
                groups[-1].append(s)
            else:
                groups.append([s])
        want += [(user, g[0], g[-1], len(g)) for g in groups]
    assert sorted((r.user_id, r.start_s, r.last_s, r.n) for r in QUERIES["reoccurrence_split"](spark, FOLDER).collect()) == sorted(want)


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2000)] + [(3000, 3000 + k) for k in range(1, 50)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        top[b] = a
    got = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in top}
    assert len(got) == len(top)
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_paths_go_around_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (1, 3), (3, 4)], "u int, v int")
    ends = lambda k: spark.createDataFrame([(k,)], "node int")
    assert sorted((tuple(r.path), r.hops) for r in paths(edges, ends(1), ends(4), 8).collect()) == [((1, 2, 3, 4), 3), ((1, 3, 4), 2)]
    assert [tuple(r.path) for r in paths(edges, ends(1), ends(4), 2).collect()] == [(1, 3, 4)]


def test_phrases_in_texts(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b"), (3, ""), (4, None), (5, "xa b c d e f"), (6, "b a b c d e f")], "doc int, folded string")
    phrases = spark.createDataFrame([(1, "a b c d e f"), (2, "b"), (3, ""), (4, None), (5, "a b")], "phrase int, folded string")
    got = sorted((r.phrase, r.doc) for r in containing(docs, phrases).collect())
    assert got == [(1, 1), (1, 6), (2, 1), (2, 2), (2, 5), (2, 6), (5, 1), (5, 2), (5, 6)]


def test_texts_are_read_once_for_few_phrases(spark, tmp_path):
    """Hashes of runs and of single words agree with those of the phrases; texts aren't read again for the candidates."""
    spark.createDataFrame([(k, f"w{k} a b c d e f {k}") for k in range(50)], "doc int, folded string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    phrases = spark.createDataFrame([(1, "a b c d e f"), (2, "w7"), (3, "c d e f 9"), (4, "f 3"), (5, "a b c d e g")], "phrase int, folded string")
    met = containing(docs, phrases)
    assert met._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1
    assert sorted((r.phrase, r.doc) for r in met.collect()) == [(1, k) for k in range(50)] + [(2, 7), (3, 9), (4, 3)]


def test_similar_sets_against_all_pairs(spark):
    rng = random.Random(3)
    seen, rows = set(), []
    for k in range(200):
        base = set(rng.sample("abcdefghijklmnop", 8)) if k % 3 else {*"abcdefgh", rng.choice("ijkl")}
        words = tuple(sorted(base))
        if words not in seen:
            seen.add(words)
            rows.append((k, "x", list(words)))
    for percent in (50, 80, 100):
        want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and 100 * len({*a[2]} & {*b[2]}) >= percent * len({*a[2]} | {*b[2]})}
        got = similar_sets(spark.createDataFrame(rows, "id int, block string, words array<string>"), percent).collect()
        assert {(r.a, r.b) for r in got} == want and len(got) == len(want)


def test_sets_that_only_meet_do_not_move(spark):
    """Pairs that share a rare word and are not similar are dropped where they meet."""
    rng = random.Random(4)
    rows = [(k, "x", [f"own{k}-{i}" for i in range(4)] + [f"hub{k % 4}"] + rng.sample([f"often{i}" for i in range(20)], 7)) for k in range(400)]
    rows += [(400 + k, "x", rows[k][2][:9] + [f"new{k}-{i}" for i in range(3)]) for k in range(20)]
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and 2 * len({*a[2]} & {*b[2]}) >= len({*a[2]} | {*b[2]})}
    before = _records_shuffled(spark)
    got = similar_sets(spark.createDataFrame(rows, "id int, block string, words array<string>"), 50).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want) >= 20
    assert _records_shuffled(spark) - before < 20_000


def _records_shuffled(spark):
    bus, gateway = spark.sparkContext._jsc.sc().listenerBus(), spark.sparkContext._gateway
    bus.waitUntilEmpty()
    every = gateway.jvm.java.util.ArrayList()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(every, False, False, gateway.new_array(gateway.jvm.double, 0), every)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_similar_sets_with_spaces_in_words_and_long_sets(spark):
    """Words with spaces, percent signs and none at all stay apart, and sets of more words than signs have bits are counted right."""
    rng = random.Random(5)
    words = ["", " ", "%", "%20", "%25", "a b", "a%20b", "a", "b", "a ", " b", "é"]
    rows = [(k, "xy"[k % 2], rng.sample(words, 7 + k % 4)) for k in range(40)]
    base = [f"w{i}" for i in range(900)]
    rows += [(100 + k, "x", [w for w in base if rng.random() < 0.5 + k / 40]) for k in range(16)]
    rows = list({(block, *sorted(held)): (k, block, held) for k, block, held in rows}.values())
    for percent in (50, 85):
        want = {(a[0], b[0], len({*a[2]} & {*b[2]}), len({*a[2]} | {*b[2]})) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and 100 * len({*a[2]} & {*b[2]}) >= percent * len({*a[2]} | {*b[2]})}
        got = similar_sets(spark.createDataFrame(rows, "id int, block string, words array<string>"), percent).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_ewma_over_several_blocks_and_nulls(spark):
    rng = random.Random(9)
    values = [None, *(rng.choice([None, rng.uniform(-5, 5)]) if k % 7 == 0 else rng.uniform(-5, 5) for k in range(250))]
    rows = [("a", k, v) for k, v in enumerate(values)] + [("b", 0, 2.0)]
    got = {(r.g, r.k): r.e for r in ewma(spark.createDataFrame(rows, "g string, k int, v double"), ["g"], "k", "v", 1.0, "e").collect()}
    seen = []
    for k, v in enumerate(values):
        seen += [v] if v is not None else []
        weights = [0.5 ** (len(seen) - 1 - j) for j in range(len(seen))]
        want = sum(w * x for w, x in zip(weights, seen)) / sum(weights) if seen else None
        assert (got["a", k] is None) if want is None else abs(got["a", k] - want) < 1e-9
    assert got["b", 0] == 2.0


def test_uncertain_date_overlap_counts_every_event(spark, tmp_path):
    rng = random.Random(5)
    start = datetime.datetime(2024, 1, 1)
    rows = [(k, rng.choice([None, 1, 2, 3]), None if k % 17 == 3 else start + datetime.timedelta(hours=rng.randrange(900))) for k in range(150)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    span = {k: (u, t.date() - datetime.timedelta(days=k % 2), t.date()) for k, u, t in rows if u is not None and t is not None}
    want = {k: sum(o != k and v[0] == span[k][0] and span[k][1] <= v[2] and v[1] <= span[k][2] for o, v in span.items()) if k in span else 0 for k, _, _ in rows}
    assert {r.id: r.n for r in QUERIES["uncertain_date_overlap_counts"](spark, str(tmp_path)).collect()} == want


def test_nearest_and_radius_joins_by_places(spark):
    """Rows that share places, at the date line and near a pole too, against all pairs; a crowded place is dealt over salts."""
    draw = random.Random(11)
    place = lambda: draw.choice([(draw.uniform(-80, 80), draw.uniform(-180, 180)), (10.0, 179.9), (10.0, -179.9), (89.5, 0.0), (89.5, 170.0)])
    left, right = ([(k, *place()) for k in range(n)] for n in (120, 90))
    one = spark.createDataFrame([*left, (900, None, 1.0)], "i long, lat double, lon double")
    two = spark.createDataFrame([*right, (901, 1.0, None)], "j long, lat double, lon double")

    def km(a, b):
        h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(min(1, h)))

    want = {(a[0], b[0]) for a in left for b in right if km(a, b) <= 900}
    for most in (7, 4_000_000):
        got = [(r.i, r.j) for r in joins.radius_join(one, two, 900, most=most).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want
    nearest = {a[0]: min((round(km(a, b), 6), b[0]) for b in right if km(a, b) <= 900)[1] for a in left if any(km(a, b) <= 900 for b in right)}
    assert {r.i: r.j for r in joins.nearest_within(one, two, "j", 900).collect()} == nearest


def test_components_with_copies_and_unknown_languages(spark, tmp_path):
    """Copies are one node, and documents of unknown language hang together by their headlines as in the twin."""
    for table in Path(FOLDER).glob("*.parquet"):
        if table.stem != "documents":
            (tmp_path / table.name).symlink_to(table)
    rows = [(1, "One two\nA", None), (2, "One two\nB", None), (3, "One two\nB", "en"), (4, "Other\nC", "en"), (5, "Other\nC", "en"), (6, "", "en"), (7, "One two\nD", None)]
    spark.createDataFrame([(k, text, lang, "web", len(text)) for k, text, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert differences(spark, str(tmp_path), QUERIES["connected_components"], ORACLE_SQL["connected_components"]) == ""


def test_wider_pairs_are_compared_once(spark):
    plan = QUERIES["pairs_minus_compared"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan


def test_dictionary_places_do_not_carry_the_text(spark):
    plan = QUERIES["dictionary_grams"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(w" not in plan and differences(spark, FOLDER, QUERIES["dictionary_grams"], ORACLE_SQL["dictionary_grams"]) == ""


def test_radius_join_keeps_its_tasks(spark):
    """The pairs are made in the tasks that they are dealt to, and both zeros are one place."""
    one = spark.createDataFrame([(k, 0.0 if k % 2 else -0.0, k % 50 / 10.0) for k in range(300)], "i long, lat double, lon double")
    two = spark.createDataFrame([(k, -0.0 if k % 2 else 0.0, k % 50 / 10.0) for k in range(300)], "j long, lat double, lon double")
    met = joins.radius_join(one, two, 5, most=40)
    assert met.rdd.getNumPartitions() >= joins.TASKS and met.count() == 50 * 6 * 6


def test_a_mean_on_a_bound_of_classes(spark, tmp_path):
    """A mean of 80 is not above 80, however the doubles are added."""
    a, b = next(x for x in ((80 + k / 100, 80 - k / 100) for k in range(1, 99)) if _added([x[0]] * 60 + [x[1]] * 60) > 80)
    rows = [(k, 1, "xy"[k % 2], datetime.datetime(2024, 1, 1), a if k < 60 else b) for k in range(120)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp_ntz, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert [r["class"] for r in QUERIES["anomaly_classes"](spark, str(tmp_path)).collect()] == ["ordinary"]


def test_means_on_a_bound_are_added_in_order_of_time(spark, tmp_path):
    """Three values whose exact mean is 80 come out above it or not by the order of their times, as in the twin."""
    sets = [(a / 100, b / 100, (24000 - a - b) / 100) for a in range(7001, 9000, 211) for b in range(3007, 8000, 101)]
    sets = [v for v in sets if _added(v) > 80 and _added(v[::-1]) <= 80][:4] + [v for v in sets if _added(v) <= 80 and _added(v[::-1]) > 80][:4]
    assert len(sets) == 8
    at = [datetime.datetime(2024, 1, 1, 9), datetime.datetime(2024, 1, 1, 10), datetime.datetime(2024, 1, 1, 11)]
    rows = [(3 * k + i, k, "yxy"[i], at[i], v) for k, three in enumerate(sets) for i, v in enumerate(three)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp_ntz, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    for table in Path(FOLDER).glob("*.parquet"):
        if table.stem != "events":
            (tmp_path / table.name).symlink_to(table)
    assert differences(spark, str(tmp_path), QUERIES["anomaly_classes"], ORACLE_SQL["anomaly_classes"]) == ""
    assert {r["class"]: r["n"] for r in QUERIES["anomaly_classes"](spark, str(tmp_path)).collect()} == {"strong": 4, "ordinary": 4}


def _added(values):
    total = 0.0
    for v in values:
        total += v
    return total / len(values)
