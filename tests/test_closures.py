"""The live detector: restarts, timers alone, suppression and the ends of an alert, against its rules run by hand."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from heronry.plans.live import LATE, RULES
from heronry.session import fresh_path
from heronry.streaming.closures import DAY, HOUR, STORE, ClosureAlerts, Usual, closure_alerts, signal, usual_of
from heronry.streaming.replay import replay

START = int(datetime.datetime(2024, 3, 1, tzinfo=datetime.UTC).timestamp() * 1000)


@pytest.fixture
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, STORE)
    yield
    spark.conf.set(key, before)


def regular(site, days, silent=(), every=HOUR // 2):
    """A movement every half hour but between two times."""
    return [(site, t, False) for t in range(START + 60_000, START + days * DAY, every) if not (silent and silent[0] <= t < silent[1])]


def by_hand(rows, silent=()):
    moves = [(s, t) for s, t, r in rows if not r]
    d0, days = min(t for _, t in moves) // DAY, max(t for _, t in moves) // DAY - min(t for _, t in moves) // DAY + 1
    upto, out = max(t for _, t, _ in rows) - LATE, []
    for site in sorted({s for s, _, _ in rows}):
        own, reports = sorted(t for s, t in moves if s == site), sorted(t for s, t, r in rows if s == site and r)
        usual = Usual([sum(t // HOUR % 24 == h for t in own) for h in range(24)], days, d0)
        held, published, said = [None] * 6, [], []
        for tick in range((min([*own, *reports]) // RULES.step + 1) * RULES.step, upto + 1, RULES.step):
            held = ClosureAlerts(RULES).judge(tick, held, own, reports, usual, set(silent), published, said)
        out += [(site, *x) for x in said]
    return sorted(out)


def write(spark, rows, folder, name):
    spark.createDataFrame(rows, "site long, at long, report boolean").coalesce(1).write.parquet(f"{folder}/{name}")


def alerts(spark, folder, usual, state, first=None):
    stream = spark.readStream.schema("site long, at long, report boolean").option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    stream = stream.withColumn("ts", F.timestamp_millis("at")).withWatermark("ts", f"{LATE} milliseconds")
    return sorted(tuple(r) for r in replay(closure_alerts(stream, F.col("site"), F.col("report"), usual, RULES), "append", state).drop("batch").collect())


def test_restart_in_mid_stream_and_timers_alone(spark, store):
    """Site 1 falls silent for good: only a timer can tell. Site 2 resumes. The source stops and goes on in between."""
    gap = (START + 5 * DAY, START + 5 * DAY + 10 * HOUR)
    rows = regular(1, 9, (START + 5 * DAY, START + 9 * DAY)) + regular(2, 9, gap) + [r for s in range(3, 8) for r in regular(s, 9)] + [(2, gap[0] + HOUR, True)]
    usual = usual_of(spark.createDataFrame([(s, t) for s, t, r in rows if not r], "site long, at long"), RULES)
    silent = list(usual.first()["silent"])
    folder, state = fresh_path(spark, "moves"), fresh_path(spark, "state")
    parts = [sorted(r for r in rows if a <= r[1] < b) for a, b in ((0, START + 4 * DAY), (START + 4 * DAY, gap[0] + 3 * HOUR), (gap[0] + 3 * HOUR, START + 7 * DAY), (START + 7 * DAY, START + 99 * DAY))]
    for k in (0, 1):
        write(spark, parts[k], folder, f"part{k}")
    assert alerts(spark, folder, usual, state) == []
    for k in (2, 3):
        write(spark, parts[k], folder, f"part{k}")
    got = alerts(spark, folder, usual, state)
    assert got == by_hand(rows, silent)
    assert {(s, kind) for s, kind, *_ in got} == {(1, "possible"), (1, "expired"), (2, "possible"), (2, "confirmed"), (2, "resumed"), (2, "withdrawn")}


def test_a_silent_source_opens_nothing(spark):
    rows = [r for s in range(4) for r in regular(s, 9, (START + 5 * DAY, START + 5 * DAY + 10 * HOUR))]
    silent = usual_of(spark.createDataFrame([(s, t) for s, t, _ in rows], "site long, at long"), RULES).first()["silent"]
    assert len(silent) >= 8 and by_hand(rows, silent) == [] and by_hand(rows) != []


def test_signal_conditions():
    usual = Usual([2] * 24, 1, START // DAY)
    moves = [t for _, t, _ in regular(1, 3)]
    end = START + 2 * DAY
    quiet = [t for t in moves if t < end]
    assert signal(quiet, end + 4 * HOUR, usual, RULES)[1] == 0 and signal(quiet, end + HOUR, usual, RULES) is None
    assert signal(moves, end + 4 * HOUR, usual, RULES) is None
    assert signal(quiet[::3], end + 4 * HOUR, usual, RULES) is None  # seen too little before
    assert signal([], end, usual, RULES) is None
    one = [*quiet, end + 30 * HOUR // 10]
    assert signal(one, end + 12 * HOUR, usual, RULES)[:2] == (quiet[-1], 1)  # one straggler inside of the silence


def test_a_busy_site_is_not_walked_through():
    """A tick asks for few expectations, however many movements the day has; a silence after a busy day is still told."""
    asked = []

    class Counted(Usual):
        def expected(self, a, b):
            asked.append(a)
            return super().expected(a, b)

    usual, end = Counted([3600] * 24, 3, START // DAY), START + 2 * DAY
    moves = list(range(START, end, 1000 * 3))
    assert signal(moves, end, usual, RULES) is None and len(asked) < 10
    assert signal(moves, end + 4 * HOUR, usual, RULES)[:2] == (moves[-1], 0)
