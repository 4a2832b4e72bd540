"""Filter state as a query string, and the predicate it stands for."""

from __future__ import annotations

from urllib.parse import parse_qs

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_filter(text: str, types: list[str], kind: str = "event_type", ts: str = "ts") -> Column:
    """Predicate of `type=a,b&from=day&to=day`; unknown parameters and values are ignored, an empty list restricts nothing."""
    given = parse_qs(text)
    chosen = [x for x in ",".join(given.get("type", [])).split(",") if x in types]
    day = lambda name: F.lit(given[name][0]).cast("timestamp_ntz")
    out = F.col(kind).isin(*chosen) if chosen else F.lit(True)
    if "from" in given:
        out = out & (F.col(ts) >= day("from"))
    if "to" in given:
        out = out & (F.col(ts) < day("to"))
    return out


def write_filter(types: list[str], start: str | None = None, end: str | None = None) -> str:
    """The canonical query string."""
    parts = [f"type={','.join(sorted(types))}"] if types else []
    parts += [f"from={start}"] if start else []
    parts += [f"to={end}"] if end else []
    return "&".join(parts)
