"""Readers of the input formats. Each gives typed rows; rows that can't be read are dropped, and counted by `unreadable`.

All are plain Spark sources with a schema: nothing is inferred by a pass over the data, and nothing is read on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the hotspot files in their order, by layout (fixed values).
HOTSPOT_COLUMNS = {
    "viirs": "latitude longitude bright_ti4 scan track acq_date acq_time satellite instrument confidence version bright_ti5 frp daynight type",
    "viirs_nrt": "latitude longitude bright_ti4 scan track acq_date acq_time satellite instrument confidence version bright_ti5 frp daynight",
    "modis": "latitude longitude brightness scan track acq_date acq_time satellite instrument confidence version bright_t31 frp daynight type",
}


def number(c: str | Column) -> Column:
    return F.expr(f"try_cast({c} as double)") if isinstance(c, str) else c.try_cast("double")


def hotspots(spark: SparkSession, path: str, layout: str = "viirs") -> DataFrame:
    """(lat, lon, at, satellite, instrument, level, frp, daynight) of a hotspot CSV.

    acq_time is HHMM without leading zeros. level is l, n or h; a percentage
    counts as l below 30 and h from 80 on. Rows without place, time or level go.
    """
    schema = ", ".join(f"{c} string" for c in HOTSPOT_COLUMNS[layout].split())
    raw = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    clock = F.lpad(F.trim("acq_time"), 4, "0")
    at = F.try_to_timestamp(F.concat_ws(" ", "acq_date", clock), F.lit("yyyy-MM-dd HHmm"))
    percent = number("confidence")
    level = F.when(percent < 30, "l").when(percent < 80, "n").when(percent.isNotNull(), "h").otherwise(F.lower(F.substring("confidence", 1, 1)))
    rows = raw.select(number("latitude").alias("lat"), number("longitude").alias("lon"), at.alias("at"), "satellite", "instrument", level.alias("level"), number("frp").alias("frp"), "daynight")
    return rows.filter(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & F.col("at").isNotNull() & F.col("level").isin("l", "n", "h"))


def unreadable(spark: SparkSession, path: str, read: DataFrame) -> DataFrame:
    """(n_lines, n_read, n_dropped) of a CSV with a header in each file."""
    lines = spark.read.text(path).filter("trim(value) <> ''").groupBy(F.input_file_name().alias("f")).agg((F.count("*") - 1).alias("n"))
    told = lines.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_lines"))
    return told.crossJoin(read.agg(F.count("*").alias("n_read"))).select("*", (F.col("n_lines") - F.col("n_read")).alias("n_dropped"))  # one row each


def weather_reports(spark: SparkSession, path: str) -> DataFrame:
    """(station, at, report, wind_kt, gust_kt, visibility_m, warm_c) of an airport weather CSV; only groups before a trend are decoded."""
    raw = spark.read.schema("station string, valid string, metar string").option("header", True).csv(path)
    rows = raw.select("station", F.try_to_timestamp("valid", F.lit("yyyy-MM-dd HH:mm")).alias("at"), F.col("metar").alias("report")).filter("at is not null and report is not null")
    now = F.regexp_extract("report", "^(.*?)( (?:BECMG|TEMPO|RMK|NOSIG)\\b.*)?$", 1)

    def group(pattern: str, n: int) -> Column:
        return F.nullif(F.regexp_extract(now, pattern, n), F.lit("")).try_cast("long")

    warm = F.regexp_replace(F.nullif(F.regexp_extract(now, r"(?:^| )(M?\d\d)/(?:M?\d\d)?(?: |$)", 1), F.lit("")), "^M", "-").try_cast("long")
    return rows.select("station", "at", "report", group(r" (?:\d{3}|VRB)(\d{2,3})(?:G\d{2,3})?KT", 1).alias("wind_kt"), group(r" (?:\d{3}|VRB)\d{2,3}G(\d{2,3})KT", 1).alias("gust_kt"), group(r"KT (?:\d{3}V\d{3} )?(\d{4})(?: |$)", 1).alias("visibility_m"), warm.alias("warm_c"))


def traces(spark: SparkSession, path: str) -> DataFrame:
    """(icao, at, lat, lon, altitude_ft, on_ground, speed_kt, track, source): one row for each point of daily aircraft files.

    A point is an array without names; its numbers, objects and words are
    read as strings and decoded by place. The altitude can be the word ground.
    """
    raw = spark.read.schema("icao string, r string, t string, timestamp double, trace array<array<string>>").option("multiLine", True).json(path)
    points = raw.select("icao", "timestamp", F.explode("trace").alias("p"))
    at = F.timestamp_micros(((F.col("timestamp") + number(F.get("p", F.lit(0)))) * 1_000_000).cast("long"))
    high = F.get("p", F.lit(3))
    rows = points.select("icao", at.alias("at"), number(F.get("p", F.lit(1))).alias("lat"), number(F.get("p", F.lit(2))).alias("lon"), number(high).alias("altitude_ft"), (high == "ground").alias("on_ground"), number(F.get("p", F.lit(4))).alias("speed_kt"), number(F.get("p", F.lit(5))).alias("track"), F.get("p", F.lit(9)).alias("source"))
    return rows.filter("at is not null and lat is not null and lon is not null")


def threat_tracks(spark: SparkSession, path: str) -> DataFrame:
    """(id, type, n_points, points): one row a threat over all snapshots, its different points in order of time."""
    raw = spark.read.schema("threats array<struct<id:string,type:string,lat:double,lon:double,updatedAt:string>>").option("multiLine", True).json(path)
    seen = raw.select(F.inline("threats")).filter("id is not null and lat is not null and lon is not null")
    points = seen.select("id", "type", F.struct(F.try_to_timestamp("updatedAt").alias("at"), "lat", "lon").alias("p")).distinct()
    return points.groupBy("id").agg(F.max_by("type", "p").alias("type"), F.count("*").alias("n_points"), F.array_sort(F.collect_list("p")).alias("points"))


def feed_notes(spark: SparkSession, path: str) -> DataFrame:
    """(title, link, at, summary) of RSS files; tags are taken out of the summary."""
    raw = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, pubDate string, description string").load(path)
    day = F.regexp_replace("pubDate", "^[A-Za-z]+, *", "")
    at = F.try_to_timestamp(day, F.lit("d MMM yyyy HH:mm:ss Z"))
    return raw.select(F.trim("title").alias("title"), F.trim("link").alias("link"), at.alias("at"), F.trim(F.regexp_replace("description", "<[^>]*>", " ")).alias("summary"))


def polygons(spark: SparkSession, path: str) -> DataFrame:
    """(name, part, ring): the outer ring of each part of each Polygon or MultiPolygon of a GeoJSON file."""
    one, many = "array<array<array<double>>>", "array<array<array<array<double>>>>"
    raw = spark.read.schema("features array<struct<properties:struct<name:string>,geometry:struct<type:string,coordinates:string>>>").option("multiLine", True).json(path)
    shape = raw.select(F.inline("features")).select("properties.name", "geometry.type", "geometry.coordinates")
    parts = F.when(F.col("type") == "Polygon", F.array(F.from_json("coordinates", one))).when(F.col("type") == "MultiPolygon", F.from_json("coordinates", many))
    return shape.select("name", F.posexplode(parts).alias("part", "rings")).select("name", "part", F.get("rings", F.lit(0)).alias("ring"))


def tab_rows(spark: SparkSession, path: str, wanted: dict[str, int], width: int) -> DataFrame:
    """Columns by place out of tab-separated files without a header; rows of another width go."""
    parts = spark.read.text(path).select(F.split("value", "\t").alias("v")).filter(F.size("v") == width)
    return parts.select(*(F.get("v", F.lit(k)).alias(name) for name, k in wanted.items()))


def night_of(ts: Column) -> Column:
    """The date of the night from noon to noon that holds an instant."""
    return F.to_date(ts - F.expr("interval 12 hours"))


def channel_posts(spark: SparkSession, path: str) -> DataFrame:
    """(channel, post, at, text, links) of saved pages of a public channel, once a post; quoted replies aren't text. Posts without a number go."""
    pages = spark.read.option("wholetext", True).text(path)
    part = F.explode(F.split("value", '<div class="tgme_widget_message ')).alias("part")
    blocks = pages.select(part).filter(F.contains("part", F.lit('data-post="')))
    body = F.regexp_extract("part", r'(?s)js-message_text"[^>]*>(.*?)</div>', 1)
    plain = F.regexp_replace(F.regexp_replace(body, "<br */?>", "\n"), "<[^>]*>", "")
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(name), F.lit(mark))
    where = r'data-post="([^"/]+)/(\d+)"'
    posts = blocks.select(
        F.regexp_extract("part", where, 1).alias("channel"),
        F.regexp_extract("part", where, 2).try_cast("long").alias("post"),
        F.try_to_timestamp(F.regexp_extract("part", '<time[^>]*datetime="([^"]+)"', 1)).alias("at"),
        F.trim(plain).alias("text"),
        F.regexp_extract_all(body, F.lit('href="(https?://[^"]+)"'), F.lit(1)).alias("links"),
    )
    return posts.filter("post is not null").dropDuplicates(["channel", "post"])


def value_at_hour(hours: Column, values: Column, at: Column) -> Column:
    """The value of the hour that holds `at`, out of parallel arrays of hours and values; null if the hour isn't there."""
    place = F.array_position(hours, F.date_trunc("hour", at))
    return F.when(place > 0, F.get(values, (place - 1).cast("int")))
