import json

import pyarrow as pa

from aeroflow.operators.tracks import cross_check, normalised, position_ok, sensitive_reason
from aeroflow.sources import html_pages, snapshots as S
from aeroflow.sources.html_pages import published, readable_text


def test_snapshots(spark, tmp_path):
    good = {"source": "Daily", "fetchedUtc": "2024-01-05T08:00Z", "ok": False, "error": "timeout", "items": [{"title": "t1", "url": "http://x.org/1"}, {"title": "t2", "url": "http://x.org/2", "dateInferred": True}]}
    (tmp_path / "a.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "b.json").write_text(json.dumps(good | {"source": "Unknown"}))
    (tmp_path / "c.json").write_text("{ not json")
    shots = S.read_snapshots(spark, str(tmp_path)).cache()
    sources = spark.createDataFrame([("daily", "Daily")], "key string, name string")
    assert sorted((r.key, r.place, r.title, r.ok) for r in S.items(shots, sources).collect()) == [("daily", 0, "t1", False), ("daily", 1, "t2", False)]
    assert [r.file.rsplit("/")[-1] for r in S.warnings(shots).collect()] == ["c.json"]


def test_writes_only_changes(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([(1, "a", "now")], "id int, v string, stamp string")
    assert S.write_if_changed(first, path, ["id"], ["stamp"])
    assert not S.write_if_changed(spark.createDataFrame([(1, "a", "later")], first.schema), path, ["id"], ["stamp"])
    assert S.write_if_changed(spark.createDataFrame([(1, "b", "later")], first.schema), path, ["id"], ["stamp"])
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [(1, "b", "later")]


def test_hour_partitions_and_sitemap(spark, tmp_path):
    rows = spark.sql("select 1 as id, timestamp'2024-01-05 08:30:00' as ts union all select 2, timestamp'2024-01-05 09:10:00'")
    S.append_by_hour(rows, str(tmp_path / "h"), "ts")
    assert spark.read.parquet(str(tmp_path / "h")).where("hour = '2024-01-05-09'").count() == 1
    S.sitemap(spark.createDataFrame([("u1", "2024-01-01"), ("u1", "2024-01-02")], "loc string, lastmod string"), str(tmp_path / "m"))
    found = spark.read.format("xml").option("rowTag", "url").load(str(tmp_path / "m")).collect()
    assert [(r.loc, str(r.lastmod)) for r in found] == [("u1", "2024-01-02")]


def test_observations(spark):
    schema = "hex string, r string, t string, flight string, alt_baro string, gs double, lat double, lon double, seen double, seen_pos double, dbFlags int, squawk string, emergency string"
    raw = spark.createDataFrame([("~ABC1 ", " b-1 ", "b738", " cal12 ", "ground", 5.0, 25.0, 121.0, 1.0, 2.0, 0, "1200", "none"), ("ABC2", None, "", "x", "35000", 450.0, None, 121.0, 1.0, 2.0, 8, "7700", None)], schema)
    got = normalised(raw).withColumn("reason", sensitive_reason(raw.dbFlags, raw.squawk, raw.emergency)).withColumn("ok", position_ok(raw.lat, raw.lon, raw.seen, raw.seen_pos)).orderBy("hex").collect()
    assert [(r.hex, r.non_icao, r.registration, r.type, r.callsign, r.on_ground, r.alt_ft, r.reason, r.ok) for r in got] == [("abc1", True, "B-1", "B738", "CAL12", True, None, None, True), ("abc2", False, None, None, "X", False, 35000.0, "ladd", False)]
    first = normalised(raw)
    second = first.withColumn("registration", first.registration)
    assert {r.hex: r.check for r in cross_check(first, second).collect()} == {"abc1": "confirmed", "abc2": "primary_only"}
    assert {r.check for r in cross_check(first, second.limit(0)).collect()} == {"unavailable"}


def test_second_source(spark):
    from pyspark.sql import functions as F

    schema = "hex string, r string, t string, flight string, alt_baro string, gs double, lat double, lon double, seen double, seen_pos double, dbFlags int, squawk string, emergency string, type string"
    row = ("a1b2c3", "N501DN", "A359", "DAL123", "ground", 5.0, 22.577, 120.35, 2.0, 1.0, 0, None, None, "adsb_icao")
    first = normalised(spark.createDataFrame([row], schema))
    change = lambda **new: normalised(spark.createDataFrame([tuple(new.get(c.split(" ")[0], x) for c, x in zip(schema.split(", "), row))], schema))
    told = lambda second: cross_check(first, second).first().check
    assert told(change(flight="DAL123  ", lat=22.58, lon=120.36, hex="A1B2C3")) == "confirmed"
    assert told(change(r="N999XX")) == told(change(t="B744")) == told(change(flight="X1")) == told(change(alt_baro="12000")) == told(change(lat=22.9)) == "conflicting"
    assert told(change(alt_baro="9000")) == told(change(r=None, t="")) == "confirmed"
    assert told(change(seen_pos=120.0)) == told(change(type="adsb_icao_nt")) == told(change(lat=None)) == "primary_only"
    assert cross_check(first, change(hex="other")).where(F.col("check") == "unavailable").count() == 1
    ok = change(seen=None).select(position_ok(F.col("lat"), F.col("lon"), F.col("seen"), F.col("seen_pos"), F.col("source_type")).alias("ok"))
    assert ok.first().ok


def test_pages():
    body = "<p>" + "A paragraph with more than thirty characters. " * 6 + "</p>"
    page = f'<html><head><meta property="article:published_time" content="2024-01-05T08:00Z"></head><body><nav><li>menu entry that is long enough to count</li></nav><article><h1>Short</h1>{body}{body}</article></body></html>'
    assert readable_text(page).count("\n") == 0 and "menu" not in readable_text(page)
    assert readable_text("<p>short</p>") is None and readable_text(None) is None
    assert published(page) == "2024-01-05T08:00Z"
    assert published('<script type="application/ld+json">{"datePublished": "2024-01-02"}</script>') == "2024-01-02"
    assert published("<time datetime='2024-01-03'>x</time>") == "2024-01-03" and published(None) is None


def test_pages_of_a_batch_are_unpacked_in_pieces():
    pages = ["<article>" + "".join(f"<p>Paragraph {j} of page {i} says enough to be read as a block of text.</p>" for j in range(i % 9)) + "</article>" for i in range(300)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(301)), pa.array(pages, pa.string())], names=["id", "html"])
    out = list(html_pages.read_pages(iter([batch])))
    assert max(x.num_rows for x in out) <= html_pages.PIECE
    rows = [r for x in out for r in x.to_pylist()]
    assert [(r["id"], r["text"]) for r in rows] == [(i, html_pages.readable_text(x)) for i, x in enumerate(pages)]
