"""Every query of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from heronry.plans import checks, decisions, evidence, forecasts, intake, live, movement, patterns, publication, quantities, readings, records, relational, series, shapes, spatial, streams, texts
from heronry.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "checks", "decisions", "evidence", "forecasts", "intake", "live", "movement", "patterns", "publication", "quantities", "readings", "records", "relational", "series", "shapes", "spatial", "streams", "texts"]
