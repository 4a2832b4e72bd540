"""Candidate pairs that are near in space and in time."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronry.functions.geo import EARTH_KM, haversine_km
from heronry.operators.joins import circle_cells


def near_buckets(km: float, seconds: int, degrees: float) -> tuple[Column, Column]:
    """The buckets of (lat, lon, at) that a record is dealt to, an array, and its own one."""
    n, length = max(1, int(360 / degrees)), 4 * seconds
    xs, ys, own_x, own_y = circle_cells(km, degrees)
    bucket = lambda span, cx, cy: (span * n + cx) * (2 * n + 1) + cy + n
    spans = F.sequence(F.floor(F.col("at") / length), F.floor((F.col("at") + seconds) / length))
    dealt = F.flatten(F.transform(spans, lambda s: F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: bucket(s, x, y))))))
    return dealt, bucket(F.floor(F.col("at") / length), own_x, own_y)


def near_pairs(records: DataFrame, km: float, seconds: int, keys: list[str] | None = None, degrees: float = 10.0, also: list[str] | None = None) -> DataFrame:
    """(keys, a, b, km, apart): pairs a < b of records (keys, id, lat, lon, at) within `km` and `seconds` of each other.

    One bucketing in space and time at once: a record goes to its own cell and
    span, and as the earlier one of a pair to the cells that its circle touches
    and to the spans up to `seconds` after it, so a pair meets once, in the
    bucket of its later record. Cells are wider than the circle and spans four
    times as long as the time, so that a record is dealt to few. A place with
    many records is as many buckets as it has spans. Columns named in `also`
    come along as <name>_a and <name>_b.
    """
    keys, also = keys or [], also or []
    high = math.degrees(km / EARTH_KM) + 1e-6
    dealt, own = near_buckets(km, seconds, degrees)
    fields = ["id", "lat", "lon", "at", *also]
    side = lambda mark, where: records.filter("id is not null and lat is not null and lon is not null and at is not null").select(*keys, *(F.col(c).alias(f"{c}_{mark}") for c in fields), where.alias("__b"))
    one, two = side("a", F.explode(dealt)), side("b", own)
    apart = F.col("at_b") - F.col("at_a")
    later = (apart >= 0) & (apart <= seconds) & ((apart > 0) | (F.col("id_a") < F.col("id_b"))) & (F.col("id_a") != F.col("id_b"))
    met = one.join(two, [*keys, "__b"]).filter(later & (F.abs(F.col("lat_a") - F.col("lat_b")) <= high))
    # The distance is told from the smaller id, whichever came first.
    turned = F.col("id_a") > F.col("id_b")
    ordered = met.select(*keys, apart.alias("apart"), turned.alias("__t"), *(F.col(f"{c}_{m}") for c in fields for m in "ab"))
    a = lambda c: F.when(F.col("__t"), F.col(f"{c}_b")).otherwise(F.col(f"{c}_a"))
    b = lambda c: F.when(F.col("__t"), F.col(f"{c}_a")).otherwise(F.col(f"{c}_b"))
    near = ordered.withColumn("km", haversine_km(a("lat"), a("lon"), b("lat"), b("lon"))).filter(F.col("km") <= km)
    return near.select(*keys, a("id").alias("a"), b("id").alias("b"), "km", "apart", *(f(c).alias(f"{c}_{m}") for c in also for f, m in ((a, "a"), (b, "b"))))
