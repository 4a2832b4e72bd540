"""Live closures: alerts for sites that fall silent against what is usual for them, by state and timers of each site.

Every `step` a timer of event time looks at a site once its movements have
settled. A silence begins at a recent movement; it is a signal if much more was
expected since than came, fast enough, and if the site was well seen before.
A signal that persists opens an alert, unless the source as a whole was silent
or a movement has come that isn't settled yet. An alert is confirmed by a
report, and ends when movements resume or when it grows too old; a resumed one
is withdrawn some time after.

What is usual comes in as the initial state of each site: its movements by hour
of the day, and the ticks at which the source was silent. The state holds the
movements of the memory, not of the stream. A tick is judged by the watermark,
so the alerts don't depend on how the stream is cut into batches.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

HOUR, DAY = 3_600_000, 86_400_000
OUTPUT = "site long, state string, start long, at long, expected double, seen long"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Rules:
    """Lengths in milliseconds; counts and shares as they are."""

    step: int = HOUR
    settle: int = HOUR // 2
    longest: int = DAY
    before: int = DAY
    least_expected: float = 3.0
    seen_share: float = 0.1
    least_per_hour: float = 0.1
    least_before: float = 5.0
    low_factor: float = 0.6
    high_factor: float = 1.2
    open_for: int = 2 * HOUR
    persistence: int = 2 * HOUR
    resume_count: int = 2
    resume_share: float = 0.5
    resume_window: int = 6 * HOUR
    report_before: int = 3 * HOUR
    publish: int = 12 * HOUR
    expire: int = 2 * DAY
    source_window: int = 3 * HOUR
    source_share: float = 0.5
    source_least: float = 5.0

    @property
    def memory(self) -> int:
        return max(self.longest + self.before, self.expire + self.resume_window + self.report_before) + self.settle + self.step


class Usual:
    """Movements by hour of the day over some days, as running sums."""

    def __init__(self, counts: list[int], days: int, first_day: int):
        self.counts, self.days, self.first_day = counts, days, first_day
        self.upto = [sum(counts[:h]) for h in range(24)]
        self.total = sum(counts)

    def sum(self, t: int) -> int:
        hour = t // HOUR % 24
        return ((t // DAY - self.first_day) * self.total + self.upto[hour]) * HOUR + self.counts[hour] * (t % HOUR)

    def expected(self, a: int, b: int) -> float:
        return (self.sum(b) - self.sum(a)) / (self.days * float(HOUR))


def signal(moves: list[int], horizon: int, usual: Usual, r: Rules) -> tuple[int, int, float] | None:
    """(start, movements seen since, expected since) of the silence that misses most, or None; `moves` are sorted."""
    n = bisect.bisect_right(moves, horizon)
    recent = n - bisect.bisect_left(moves, horizon - r.open_for)
    best, missing = None, 0.0
    # No factor is above the high one: what fails with it fails at every start, and more than `most` seen since fail at any.
    if recent > max(1.0, r.seen_share * usual.expected(horizon - r.open_for, horizon) * r.high_factor):
        return None
    most = r.seen_share * (usual.expected(horizon - r.longest, horizon) * r.high_factor)
    for k in range(min(n, int(most) + 1)):
        start = moves[n - 1 - k]
        if horizon - start > r.longest:
            break
        before = usual.expected(start - r.before, start)
        if before < r.least_before:
            continue
        factor = (n - 1 - k - bisect.bisect_left(moves, start - r.before)) / before
        if factor < r.low_factor:
            continue
        factor = min(factor, r.high_factor)
        expected = usual.expected(start, horizon) * factor
        is_open = recent <= max(1.0, r.seen_share * usual.expected(horizon - r.open_for, horizon) * factor)
        if is_open and expected >= r.least_expected and k <= r.seen_share * expected and expected * HOUR >= r.least_per_hour * (horizon - start) and (best is None or expected - k > missing):
            best, missing = (start, k, expected), expected - k
    return best


def replaced(state, rows: list[tuple]) -> None:
    """A list state's new rows; an empty list has to be cleared."""
    state.put(rows) if rows else state.clear()


class ClosureAlerts(StatefulProcessor):
    """Input rows (site, at, report); output rows OUTPUT."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle) -> None:
        self.handle = handle
        #: One row a frame: its movements and its reports.
        self.seen = handle.getListState("seen", "moves array<long>, reports array<long>")
        self.usual = handle.getValueState("usual", "counts array<long>, days long, first_day long, silent array<long>")
        #: Next tick, and the open signal and alert: since, start, detected, expected, seen, confirmed.
        self.now = handle.getValueState("now", "tick long, since long, start long, detected long, expected double, n long, confirmed boolean")
        #: Resumed alerts that are still published.
        self.published = handle.getListState("published", "start long, resumed long, expected double, n long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for r in initialState.itertuples():
            self.usual.update(([int(x) for x in r.counts], int(r.days), int(r.first_day), [int(x) for x in r.silent]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            at = frame["at"].astype("int64")
            if len(at):
                told = frame["report"].astype(bool)
                self.seen.appendValue((at[~told].tolist(), at[told].tolist()))
                first = int(at.min()) if first is None else min(first, int(at.min()))
        if first is not None and not self.now.exists():
            tick = (first // self.rules.step + 1) * self.rules.step
            self.now.update((tick, None, None, None, None, None, None))
            self.handle.registerTimer(tick)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        r, upto = self.rules, timerValues.getCurrentWatermarkInMs()
        tick, *held = self.now.get()
        counts, days, first_day, silent = self.usual.get() if self.usual.exists() else ([0] * 24, 1, 0, [])
        usual, silent = Usual(list(counts), days, first_day), set(silent)
        rows = list(self.seen.get())
        moves, reports = sorted(a for m, _ in rows for a in m), sorted(a for _, s in rows for a in s)
        published, out = list(self.published.get()), []
        while tick <= upto:
            held = self.judge(tick, held, moves, reports, usual, silent, published, out)
            tick += r.step
        self.now.update((tick, *held))
        self.handle.registerTimer(tick)
        moves, reports = (x[bisect.bisect_left(x, tick - r.memory) :] for x in (moves, reports))
        replaced(self.seen, [(moves, reports)] if moves or reports else [])
        replaced(self.published, published)
        if out:
            yield pd.DataFrame([(int(key[0]), *x) for x in out], columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def judge(self, now: int, held: list, moves: list[int], reports: list[int], usual: Usual, silent: set[int], published: list, out: list) -> list:
        """One tick; what is held goes in and out."""
        r, horizon = self.rules, now - self.rules.settle
        for x in [x for x in published if now - x[1] > r.publish]:
            published.remove(x)
            out.append(("withdrawn", x[0], now, x[2], x[3]))
        since, start, detected, expected, n, confirmed = held
        if start is not None:
            if not confirmed and bisect.bisect_right(reports, horizon) > bisect.bisect_left(reports, start - r.report_before):
                confirmed = True
                out.append(("confirmed", start, now, expected, n))
            a, b = bisect.bisect_right(moves, max(start, horizon - r.resume_window)), bisect.bisect_right(moves, horizon)
            if b - a >= r.resume_count and b - a >= r.resume_share * usual.expected(horizon - r.resume_window, horizon):
                out.append(("resumed", start, moves[a], expected, n))
                published.append((start, moves[a], expected, n))
                return [None] * 6
            if now - detected > r.expire:
                out.append(("expired", start, now, expected, n))
                return [None] * 6
            return [since, start, detected, expected, n, confirmed]
        found = None if now in silent else signal(moves, horizon, usual, r)
        if found is None:
            return [None] * 6
        if bisect.bisect_right(moves, now) > bisect.bisect_right(moves, horizon):
            return [since, None, None, None, None, None]  # a movement that isn't settled holds the signal where it is
        since = now if since is None else since
        if now - since < r.persistence:
            return [since, None, None, None, None, None]
        out.append(("possible", found[0], now, round(found[2], 6), found[1]))
        return [None, found[0], now, round(found[2], 6), found[1], False]

    def close(self) -> None:
        pass


def usual_of(moves: DataFrame, rules: Rules) -> DataFrame:
    """(site, counts, days, first_day, silent) out of past movements (site, at): the initial state.

    The ticks at which the source as a whole was silent are few and the same for all sites.
    """
    hour = (F.col("at") / HOUR).cast("long") % 24
    span = moves.agg(F.min(F.floor(F.col("at") / DAY)).alias("first_day"), F.max(F.floor(F.col("at") / DAY)).alias("last_day"))
    by_hour = moves.groupBy("site", hour.alias("hour")).agg(F.count("*").alias("n"))
    counts = by_hour.groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("hour", "n"))).alias("m"))  # 24 entries at most
    counts = counts.select("site", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long")), lambda h: F.coalesce(F.element_at("m", h), F.lit(0).cast("long"))).alias("counts"))
    days = span.select((F.col("last_day") - F.col("first_day") + 1).alias("days"), "first_day")
    silent = silent_ticks(moves, rules).agg(F.array_sort(F.collect_list("tick")).alias("silent"))
    return counts.crossJoin(F.broadcast(days)).crossJoin(F.broadcast(silent))  # one row each


def silent_ticks(moves: DataFrame, r: Rules) -> DataFrame:
    """Ticks before which all sites together have moved much less than usual; windows of steps, so they are as many as the steps."""
    if r.step % r.settle or r.source_window % r.settle:
        raise ValueError("the step and the source's window are multiples of the settling time")
    part = F.floor(F.col("at") / r.settle)
    parts = moves.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    # A movement at `at` counts at ticks whose horizon is in [at, at + window).
    wide, every = r.source_window // r.settle, r.step // r.settle
    horizons = parts.select(F.explode(F.sequence(F.col("part") + 1, F.col("part") + wide)).alias("h"), "n").groupBy("h").agg(F.sum("n").alias("n"))
    edge = parts.agg(F.min("part").alias("a"), F.max("part").alias("b"), F.sum("n").alias("all"))
    steps = edge.select(F.explode(F.sequence(F.col("a") + 1, F.col("b") + 1)).alias("h"), "all", ((F.col("b") * r.settle / DAY).cast("long") - (F.col("a") * r.settle / DAY).cast("long") + 1).alias("days"))
    usual = F.col("all") * r.source_window / (F.col("days") * DAY)
    seen = steps.join(horizons, "h", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    low = seen.filter((F.pmod(F.col("h") + 1, F.lit(every)) == 0) & (usual >= r.source_least) & (F.col("n") < r.source_share * usual))
    return low.select(((F.col("h") + 1) * r.settle).cast("long").alias("tick"))


def closure_alerts(stream: DataFrame, site: Column, is_report: Column, usual: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Alerts of a stream with a watermark on `ts`; `usual` comes from usual_of. Needs the RocksDB state store (STORE)."""
    rows = stream.select(site.cast("long").alias("site"), "ts", F.unix_millis("ts").alias("at"), is_report.alias("report")).filter("site is not null and at is not null")
    return rows.groupBy("site").transformWithStateInPandas(ClosureAlerts(rules), OUTPUT, "Append", "EventTime", initialState=usual.groupBy("site"))
