"""Polygons, borders and zones as tables: joins by grid cells, with the exact test only where a border runs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronry.operators.joins import few

KM_A_DEGREE = 111.195


def edges_of(rings: Column) -> Column:
    """(x1, y1, x2, y2) of the sides of rings, an array of arrays of (x, y) structs; each ring closes itself."""
    side = lambda ring: F.transform(ring, lambda b, k: F.struct(F.get(ring, F.pmod(k - 1, F.size(ring)))["x"].alias("x1"), F.get(ring, F.pmod(k - 1, F.size(ring)))["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
    return F.flatten(F.transform(rings, side))


def crosses_eastwards(e: Column, x: Column, y: Column) -> Column:
    """A ray to the east from (x, y) crosses the side."""
    return ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"])


def inside(edges: Column, x: Column, y: Column) -> Column:
    """Even-odd over the sides of all rings at once: inside of the outer ring and of no hole."""
    return F.size(F.filter(edges, lambda e: F.coalesce(crosses_eastwards(e, x, y), F.lit(False)))) % 2 == 1


def cover(polygons: DataFrame, rings: str, degrees: float) -> DataFrame:
    """`polygons` with a row for each cell (cx, cy) that they touch, their `edges` and whether the cell is `whole`.

    A cell that no side comes near lies inside or outside as a whole: its
    centre tells, and those outside go. In the others each point is tested.
    """
    with_edges = polygons.withColumn("edges", edges_of(F.col(rings)))
    low = lambda f, c: F.array_min(F.transform("edges", lambda e: f(e[f"{c}1"], e[f"{c}2"])))
    high = lambda f, c: F.array_max(F.transform("edges", lambda e: f(e[f"{c}1"], e[f"{c}2"])))
    cell = lambda v: F.floor(v / degrees)
    boxed = with_edges.filter(F.size("edges") > 0).withColumns({"cx": F.explode(F.sequence(cell(low(F.least, "x")), cell(high(F.greatest, "x"))))})
    boxed = boxed.withColumns({"cy": F.explode(F.sequence(cell(low(F.least, "y")), cell(high(F.greatest, "y"))))})
    x0, y0 = F.col("cx") * degrees, F.col("cy") * degrees
    near = F.exists("edges", lambda e: (F.least(e["x1"], e["x2"]) <= x0 + degrees) & (F.greatest(e["x1"], e["x2"]) >= x0) & (F.least(e["y1"], e["y2"]) <= y0 + degrees) & (F.greatest(e["y1"], e["y2"]) >= y0))
    centre = inside(F.col("edges"), x0 + degrees / 2, y0 + degrees / 2)
    return boxed.withColumn("whole", ~near).filter(~F.col("whole") | centre)


def points_in_polygons(points: DataFrame, polygons: DataFrame, *, x: str = "lon", y: str = "lat", rings: str = "rings", degrees: float = 5.0) -> DataFrame:
    """Each point with each polygon that holds it. Both sides are tables; of polygons, few cells are broadcast."""
    covered = cover(polygons, rings, degrees)
    covered = covered.withColumn("edges", F.when(~F.col("whole"), F.col("edges"))).drop(rings)
    covered = F.broadcast(covered) if few(covered) else covered
    placed = points.withColumns({"cx": F.floor(F.col(x) / degrees), "cy": F.floor(F.col(y) / degrees)})
    met = placed.join(covered, ["cx", "cy"])
    return met.filter(F.col("whole") | inside(F.col("edges"), F.col(x), F.col(y))).drop("cx", "cy", "whole", "edges")


def side_km(x: Column, y: Column, e: Column) -> Column:
    """Distance from a point to a side, on the plane that keeps distances around the point."""
    k = F.cos(F.radians(y))
    ax, ay, bx, by = (e["x1"] - x) * k, e["y1"] - y, (e["x2"] - x) * k, e["y2"] - y
    dx, dy = bx - ax, by - ay
    long_ = dx * dx + dy * dy
    t = F.when(long_ == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / long_)))
    return F.sqrt(F.pow(ax + t * dx, 2) + F.pow(ay + t * dy, 2)) * KM_A_DEGREE


def near_sides(points: DataFrame, shapes: DataFrame, edges: Column, km: float, *, by: list[str], x: str = "lon", y: str = "lat", degrees: float = 5.0) -> DataFrame:
    """(by, km): the distance from each point to the nearest side of each shape within `km`; `by` names both keys.

    A side goes to the cells around it, within reach at its farthest latitude,
    and a point only to its own, so each pair of a point and a side meets once.
    """
    side = shapes.withColumn("edge", F.explode(edges))
    reach = km / KM_A_DEGREE
    e = F.col("edge")
    top = F.least(F.lit(89.0), F.greatest(F.abs(e["y1"]), F.abs(e["y2"])) + reach)
    wide = reach / F.cos(F.radians(top))
    cell = lambda v: F.floor(v / degrees)
    side = side.withColumn("cx", F.explode(F.sequence(cell(F.least(e["x1"], e["x2"]) - wide), cell(F.greatest(e["x1"], e["x2"]) + wide))))
    side = side.withColumn("cy", F.explode(F.sequence(cell(F.least(e["y1"], e["y2"]) - reach), cell(F.greatest(e["y1"], e["y2"]) + reach))))
    side = F.broadcast(side) if few(side) else side
    placed = points.withColumns({"cx": cell(F.col(x)), "cy": cell(F.col(y))})
    met = placed.join(side, ["cx", "cy"]).withColumn("km", side_km(F.col(x), F.col(y), e))
    return met.filter(F.col("km") <= km).groupBy(*by).agg(F.min("km").alias("km"))


def wind_zone(speed_ms: Column, minutes: Column, east_ms: Column, north_ms: Column, corners: int = 36) -> Column:
    """The ring (corners, centre) from which a craft can have come: where it can start, air and wind taken together, in kilometres from the incident."""
    hours = minutes / 60.0
    radius, cx, cy = speed_ms * 3.6 * hours, -east_ms * 3.6 * hours, -north_ms * 3.6 * hours
    turn = 2 * math.pi / corners
    ring = F.transform(F.sequence(F.lit(0), F.lit(corners - 1)), lambda i: F.struct((cx + radius * F.sin(i * turn)).alias("x"), (cy + radius * F.cos(i * turn)).alias("y")))
    return F.struct(ring.alias("ring"), cx.alias("cx"), cy.alias("cy"), radius.alias("radius"))


def cross(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def sides_turned(zone: Column) -> Column:
    """The sides of a zone's ring, which runs clockwise."""
    return edges_of(F.array(zone["ring"]))


def zone_km2(zone: Column) -> Column:
    """Area of the hull of the ring and the incident at (0, 0): the ring, and a triangle to each side that the incident sees from outside."""
    twice = lambda e, x, y: cross(e["x1"], e["y1"], e["x2"], e["y2"], x, y)
    ring = F.aggregate(sides_turned(zone), F.lit(0.0), lambda n, e: n - twice(e, zone["cx"], zone["cy"]) / 2)
    return F.aggregate(sides_turned(zone), ring, lambda n, e: n + F.greatest(F.lit(0.0), twice(e, F.lit(0.0), F.lit(0.0))) / 2)


def in_zone(sides: Column, cx: Column, cy: Column, x: Column, y: Column) -> Column:
    """Whether (x, y) lies in the hull of a ring around (cx, cy) and the incident: in a triangle of a side with the ring's centre or with the incident."""

    def triangle(e: Column, ox: Column, oy: Column) -> Column:
        a, b, c = cross(e["x1"], e["y1"], e["x2"], e["y2"], x, y), cross(e["x2"], e["y2"], ox, oy, x, y), cross(ox, oy, e["x1"], e["y1"], x, y)
        return ((a >= 0) & (b >= 0) & (c >= 0)) | ((a <= 0) & (b <= 0) & (c <= 0))

    return F.exists(sides, lambda e: triangle(e, cx, cy) | triangle(e, F.lit(0.0), F.lit(0.0)))


def zone_grid(zones: DataFrame, zone: str, side: int = 20) -> DataFrame:
    """`zones` with a row for each point (sample_x, sample_y), in kilometres from the incident, of an even grid over the zone's box that lies in it."""
    z = F.col(zone)
    xs, ys = F.concat(F.transform(z["ring"], lambda p: p["x"]), F.array(F.lit(0.0))), F.concat(F.transform(z["ring"], lambda p: p["y"]), F.array(F.lit(0.0)))
    place = lambda a, b, k: F.col(a) + (F.col(b) - F.col(a)) * (k + 0.5) / side
    # The box and the sides are made once a zone, below the grid.
    boxed = zones.withColumns({"__xa": F.array_min(xs), "__xb": F.array_max(xs), "__ya": F.array_min(ys), "__yb": F.array_max(ys), "__sides": sides_turned(z)})
    grid = boxed.withColumns({"__i": F.explode(F.sequence(F.lit(0), F.lit(side - 1)))}).withColumns({"__j": F.explode(F.sequence(F.lit(0), F.lit(side - 1)))})
    grid = grid.withColumns({"sample_x": place("__xa", "__xb", F.col("__i")), "sample_y": place("__ya", "__yb", F.col("__j"))}).filter(in_zone(F.col("__sides"), z["cx"], z["cy"], F.col("sample_x"), F.col("sample_y")))
    return grid.drop("__i", "__j", "__xa", "__xb", "__ya", "__yb", "__sides")


def on_earth(lat: Column, lon: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """(lat, lon) of a point (x, y) in kilometres on the plane around a place."""
    return lat + y / KM_A_DEGREE, lon + x / (KM_A_DEGREE * F.cos(F.radians(lat)))


def zone_samples(zones: DataFrame, zone: str, lat: str, lon: str, side: int = 20) -> DataFrame:
    """`zones` with a row for each point of its grid: sample_lat, sample_lon on the plane around (lat, lon)."""
    to_lat, to_lon = on_earth(F.col(lat), F.col(lon), F.col("sample_x"), F.col("sample_y"))
    return zone_grid(zones, zone, side).withColumns({"sample_lat": to_lat, "sample_lon": to_lon}).drop("sample_x", "sample_y")
