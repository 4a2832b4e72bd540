"""Readers on small files, writers by what can be read back."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from heronry.sources import readers, writers


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path / name)


def test_hotspots_of_both_layouts(spark, tmp_path):
    head = "latitude,longitude,bright_ti4,scan,track,acq_date,acq_time,satellite,instrument,confidence,version,bright_ti5,frp,daynight,type\n"
    path = put(tmp_path, "v.csv", head + "50.5,30.25,300,1,1,2025-01-02,7,N,VIIRS,n,2,280,1.5,N,0\nno,es,una\n95,30,300,1,1,2025-01-02,7,N,VIIRS,n,2,280,1.5,N,0\n")
    got = readers.hotspots(spark, path)
    row = got.collect()
    assert [(r.lat, r.lon, r.at, r.level, r.frp) for r in row] == [(50.5, 30.25, dt.datetime(2025, 1, 2, 0, 7), "n", 1.5)]
    assert tuple(readers.unreadable(spark, path, got).first()) == (3, 1, 2)
    modis = head.replace("bright_ti4", "brightness").replace("bright_ti5", "bright_t31")
    path = put(tmp_path, "m.csv", modis + "".join(f"1,2,300,1,1,2025-01-02,2359,T,MODIS,{c},6,280,,D,0\n" for c in (29, 30, 79, 80)))
    assert [r.level for r in readers.hotspots(spark, path, "modis").orderBy("level").collect()] == ["h", "l", "n", "n"]


def test_weather_reports(spark, tmp_path):
    path = put(tmp_path, "w.csv", "station,valid,metar\nAAAA,2025-01-02 03:20,AAAA 020320Z 27012G25KT 0800 FG M02/M03 Q1018 TEMPO 09040KT 0100\nAAAA,later,x\nBBBB,2025-01-02 03:20,BBBB NIL\n")
    got = {r.station: (r.wind_kt, r.gust_kt, r.visibility_m, r.warm_c) for r in readers.weather_reports(spark, path).collect()}
    assert got == {"AAAA": (12, 25, 800, -2), "BBBB": (None, None, None, None)}


def test_traces(spark, tmp_path):
    doc = {"icao": "abc", "timestamp": 1000.0, "trace": [[0.5, 1, 2, "ground", 3.5, None, 0, 0, {"type": "x"}, "adsb"], [1, 1, None, 200], [2, 1, 2, 300, None, 90]]}
    got = readers.traces(spark, put(tmp_path, "t.json", json.dumps(doc))).orderBy("at").collect()
    assert [(r.at.timestamp() if r.at.tzinfo else (r.at - dt.datetime(1970, 1, 1)).total_seconds(), r.altitude_ft, r.on_ground, r.speed_kt, r.track, r.source) for r in got] == [(1000.5, None, True, 3.5, None, "adsb"), (1002.0, 300.0, False, None, 90.0, None)]


def test_threat_tracks(spark, tmp_path):
    def snapshot(name, *rows):
        put(tmp_path / "s", name, json.dumps({"threats": [dict(zip(("id", "type", "lat", "lon", "updatedAt"), r)) for r in rows]}))

    (tmp_path / "s").mkdir()
    snapshot("2.json", ("a", "uav", 2.0, 2.0, "2025-01-01T00:02:00Z"), ("b", "uav", None, None, "2025-01-01T00:02:00Z"))
    snapshot("1.json", ("a", "uav", 1.0, 1.0, "2025-01-01T00:01:00Z"), ("a", "uav", 2.0, 2.0, "2025-01-01T00:02:00Z"))
    got = readers.threat_tracks(spark, str(tmp_path / "s")).collect()
    assert [(r.id, r.n_points, [p.lat for p in r.points]) for r in got] == [("a", 2, [1.0, 2.0])]


def test_feed_notes(spark, tmp_path):
    text = '<?xml version="1.0"?><rss><channel><title>x</title><item><title> One </title><link>http://a/1</link><pubDate>Tue, 10 Nov 2026 13:05:25 +0000</pubDate><description>&lt;p&gt;Text&lt;/p&gt;</description></item><item><title>Two</title></item></channel></rss>'
    got = {r.title: (r.link, r.at, r.summary) for r in readers.feed_notes(spark, put(tmp_path, "f.xml", text)).collect()}
    assert got == {"One": ("http://a/1", dt.datetime(2026, 11, 10, 13, 5, 25), "Text"), "Two": (None, None, None)}


def test_polygons_and_tab_rows(spark, tmp_path):
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    shapes = [("p", "Polygon", [ring]), ("m", "MultiPolygon", [[ring], [ring, ring]]), ("x", "Point", [0, 0])]
    doc = {"features": [{"properties": {"name": n}, "geometry": {"type": t, "coordinates": c}} for n, t, c in shapes]}
    got = sorted((r.name, r.part, len(r.ring)) for r in readers.polygons(spark, put(tmp_path, "g.json", json.dumps(doc))).collect())
    assert got == [("m", 0, 4), ("m", 1, 4), ("p", 0, 4)]
    path = put(tmp_path, "n.tsv", "a\tb\tc\nshort\n\t\tz\n")
    assert sorted(map(tuple, readers.tab_rows(spark, path, {"last": 2, "first": 0}, 3).collect())) == [("c", "a"), ("z", "")]


def test_night_of(spark):
    df = spark.sql("select timestamp_ntz'2025-01-02 11:59:59' as a, timestamp_ntz'2025-01-02 12:00:00' as b")
    assert tuple(df.select(readers.night_of(F.col("a")), readers.night_of(F.col("b"))).first()) == (dt.date(2025, 1, 1), dt.date(2025, 1, 2))


def test_upsert_insert_and_changes(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 2), (3, "c", 3)], "k int, s string, n int")
    new = spark.createDataFrame([(1, "a", None), (2, None, 2), (4, "d", 4)], "k int, s string, n int")
    assert sorted(map(tuple, writers.upsert_changed(old, new, "k").collect())) == [(1, "a", None, False), (2, None, 2, True), (3, "c", 3, False), (4, "d", 4, True)]
    assert [r.k for r in writers.insert_new(old, new.union(new), ["k"]).collect()] == [4]
    assert sorted(map(tuple, writers.field_changes(old, new, "k").collect()), key=repr) == sorted(
        [(2, "s", "changed", "b", None), (3, "s", "removed", "c", None), (3, "n", "removed", "3", None), (4, "s", "added", None, "d"), (4, "n", "added", None, "4")], key=repr
    )


def test_features_csv_and_versions(spark, tmp_path):
    df = spark.createDataFrame([(1, 50.1234567, 30.0, 'x "q", y'), (2, None, 30.0, ""), (3, 1.0, 2.0, None)], "id int, lat double, lon double, s string")
    writers.write_features(df, str(tmp_path / "f"))
    got = sorted((json.loads(r.value)["properties"]["id"], json.loads(r.value)["geometry"]["coordinates"]) for r in spark.read.text(str(tmp_path / "f")).collect())
    assert got == [(1, [30.0, 50.12346]), (3, [2.0, 1.0])]
    writers.write_csv(df, str(tmp_path / "c"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "c")).collect() if not r.value.startswith("id,")]
    assert sorted(lines) == ['1,50.1234567,30.0,"x ""q"", y"', '2,,30.0,""', "3,1.0,2.0,"]
    manifest = writers.write_version({"one": df, "none": df.limit(0)}, str(tmp_path / "v"), "1").collect()
    assert {r.name: r.n_rows for r in manifest} == {"one": 3, "none": 0}
    one = next(r.digest for r in manifest if r.name == "one")
    assert writers.fingerprint(df.repartition(3)).first().digest == one != writers.fingerprint(df.union(df.limit(1))).first().digest


def test_channel_posts(spark, tmp_path):
    def post(number, text, reply=""):
        return f'<div class="tgme_widget_message js-widget_message" data-post="some/{number}"><time datetime="2025-01-02T03:04:05+00:00" class="time">{reply}<div class="tgme_widget_message_text js-message_text" dir="auto">{text}</div></div>'

    reply = '<div class="tgme_widget_message_text js-message_reply_text" dir="auto">old</div>'
    page = "<html>" + post(7, 'a<br/>b &amp;lt; <a href="http://x/1">c</a>', reply) + post(8, "") + "</html>"
    put(tmp_path, "a.html", page)
    put(tmp_path, "b.html", page)
    got = sorted((r.channel, r.post, r.at, r.text, r.links) for r in readers.channel_posts(spark, str(tmp_path)).collect())
    at = dt.datetime(2025, 1, 2, 3, 4, 5)
    assert got == [("some", 7, at, "a\nb &lt; c", ["http://x/1"]), ("some", 8, at, "", [])]


def test_value_at_hour_and_cells(spark, tmp_path):
    df = spark.sql("select array(timestamp'2025-01-02 03:00:00', timestamp'2025-01-02 04:00:00') as h, array(1.5, null) as v, timestamp'2025-01-02 03:59:00' as a, timestamp'2025-01-02 05:00:00' as b")
    assert [float(df.select(readers.value_at_hour(F.col("h"), F.col("v"), F.col("a"))).first()[0]), df.select(readers.value_at_hour(F.col("h"), F.col("v"), F.col("b"))).first()[0]] == [1.5, None]
    rows = spark.createDataFrame([(dt.datetime(2025, 1, 2), 1.2, -0.1), (dt.datetime(2025, 1, 2), 1.4, -0.4), (dt.datetime(2025, 1, 3), 1.2, None)], "at timestamp, lat double, lon double")
    writers.write_cells(rows, str(tmp_path / "cells"), 0.5)
    assert [(str(r.period), r.cell_lat, r.cell_lon, r.n) for r in spark.read.parquet(str(tmp_path / "cells")).collect()] == [("2025-01-02", 1.0, -0.5, 2)]
