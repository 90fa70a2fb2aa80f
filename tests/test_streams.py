from datetime import datetime, timedelta

from pyspark.sql import functions as F

from aeroflow.operators.briefings import closed
from aeroflow.operators.tracks import track_status
from aeroflow.streaming.arrivals import ArrivalSinks, assess, confirmed_arrivals, released, track_points
from aeroflow.streaming.windows import closed_window_counts

T0 = datetime(2024, 1, 5, 8, 0)


def point(minutes, alt, ground=False, km=10.0, speed=150.0):
    return (T0 + timedelta(minutes=minutes), alt, ground, km, speed)


def test_track_rules():
    assert assess([]) == "insufficient"
    assert assess([point(0, 35000.0)]) == "overflight"
    assert assess([point(i, a) for i, a in enumerate([8000.0, 3500.0, 1200.0, 5200.0])]) == "overflight"
    assert assess([point(0, 9000.0, km=40.0), point(1, 4500.0, km=18.0), point(2, 2200.0, km=5.0)]) == "probable"
    assert assess([point(0, 6000.0, km=25.0), point(5, None, True, 1.5, 15.0)]) == "confirmed"
    assert assess([point(0, None, True, 1.5, 15.0)]) == "insufficient"


OBSERVED = "hex string, r string, t string, flight string, alt_baro string, gs double, lat double, lon double, seen double, seen_pos double, dbFlags int, squawk string, emergency string, type string, ts timestamp"
AIRPORTS = [("TPE", 25.077, 121.233, 80.0, 5.0), ("KHH", 22.577, 120.35, 80.0, 5.0)]


def seen(hex_code, minutes, alt, km=0.0, at=0, speed=10.0, **other):
    """A raw observation ``km`` north of an airport."""
    row = {"hex": hex_code, "r": "b-1", "t": "a359", "flight": "cal12", "alt_baro": alt, "gs": speed, "lat": AIRPORTS[at][1] + km / 111.2, "lon": AIRPORTS[at][2], "seen": 1.0, "seen_pos": 2.0, "dbFlags": 0, "squawk": "1200", "emergency": "none", "type": "adsb_icao", "ts": T0 + timedelta(minutes=minutes)} | other
    return tuple(row.values())


def landing(hex_code, minutes, at=0, **other):
    return [seen(hex_code, minutes + i, alt, km, at, 150.0 - 45 * i, **other) for i, (alt, km) in enumerate([("6000", 40.0), ("2500", 15.0), ("1200", 6.0), ("ground", 1.0)])]


def scans():
    """Observations by scan, an hour of them or more apart at the end."""
    rows = landing("a1", 0) + landing("a2", 3, 1) + [seen("a1", 8, "ground", 0.5, speed=0.0)]
    rows += [seen("b1", i, "35000", 10.0 - i) for i in range(5)] + landing("c1", 1, dbFlags=1) + landing("~d1", 1) + landing("e1", 1, squawk="7700") + landing("f1", 1, seen_pos=90.0) + landing("g1", 1, type="adsb_icao_nt")
    rows += [seen("h1", 2, "ground", 0.5)] + landing("k1", 1, r=None, lat=50.0) + landing("a1", 300)
    rows += landing("a1", 24 * 60 + 30) + landing("m1", 3 * 24 * 60)
    return sorted(rows, key=lambda r: r[-1])


def started(spark, tmp_path, rows, name, sink=None, per_file=6):
    for i in range(0, len(rows), per_file):
        spark.createDataFrame(rows[i : i + per_file], OBSERVED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{i:05d}"))
    raw = spark.readStream.schema(OBSERVED).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    airports = spark.createDataFrame(AIRPORTS, "airport string, ap_lat double, ap_lon double, radius_km double, fence_km double")
    out = confirmed_arrivals(track_points(raw, airports)).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
    query = (out.foreachBatch(sink) if sink else out.format("memory").queryName(name)).start()
    query.awaitTermination(300)
    assert query.exception() is None
    return query


def test_stream_of_arrivals_equals_tracks_and_forgets(spark, tmp_path):
    rows = scans()
    query = started(spark, tmp_path, rows, "arrivals")
    got = sorted((r.hex, r.airport, r.day) for r in spark.table("arrivals").collect())
    # the batch form over the points of each aircraft, airport and hour of flight
    airports = spark.createDataFrame(AIRPORTS, "airport string, ap_lat double, ap_lon double, radius_km double, fence_km double")
    points = track_points(spark.createDataFrame(rows, OBSERVED), airports).withColumns({"day": F.date_format("ts", "yyyy-MM-dd"), "part": F.floor(F.unix_timestamp("ts") / 14400), "point_id": F.lit(0)})
    told = track_status(points, ["hex", "airport", "day", "part"]).where("status = 'confirmed'").select("hex", "airport", "day").distinct()
    want = sorted(map(tuple, told.collect()))
    assert got == want == [("a1", "TPE", "2024-01-05"), ("a1", "TPE", "2024-01-06"), ("a2", "KHH", "2024-01-05"), ("m1", "TPE", "2024-01-08")]
    state = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(state) >= 5 and state[-1] <= 2, state  # of days before nothing is left


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    def judge(arrivals, history):
        before = history.groupBy("hex").agg(F.count("*").alias("n"))
        met = arrivals.join(before, "hex", "left")
        score = F.when(F.col("n") > 0, 10).otherwise(80)
        return met.withColumns({"score": score, "watched": F.lit(False), "second": F.when(F.col("hex") == "a2", "conflict").otherwise("confirmed")}).drop("n")

    folder = str(tmp_path / "out")
    sinks, batches = ArrivalSinks(folder, judge), []

    def keep(df, number):
        batches.append((number, df.collect(), df.schema))
        sinks(df, number)

    started(spark, tmp_path, scans(), "sinks", keep)
    read = lambda name: sorted(str(r) for r in spark.read.parquet(f"{folder}/{name}").collect())
    before = {name: read(name) for name in sinks.TABLES}
    status = {(r.eid, r.status, r.reason) for r in spark.read.parquet(f"{folder}/events").collect()}
    assert sorted(s for _, s, _ in status) == ["candidate", "candidate", "rejected", "rejected"] and {r for *_, r in status} == {None, "conflicting sources", "below threshold"}
    assert len(before["history"]) == 4 and len(before["queue"]) == 2
    for number, rows, schema in batches[::-1]:
        sinks(spark.createDataFrame(rows, schema), number)
    assert {name: read(name) for name in sinks.TABLES} == before
    queue = sinks.read(spark, "queue", spark.read.parquet(f"{folder}/queue").drop("batch_id").schema)
    assert released(queue, F.lit("2030-01-01").cast("timestamp")).count() == 0  # all of the warm-up
    again = ArrivalSinks(str(tmp_path / "cold"), judge, warm_up_days=0)
    for number, rows, schema in batches:
        again(spark.createDataFrame(rows, schema), number)
    late = spark.read.parquet(str(tmp_path / "cold" / "queue"))
    assert released(late.where("not warm_up"), F.lit("2024-01-05 08:20:00").cast("timestamp")).count() == 0
    assert released(late, F.lit("2030-01-01").cast("timestamp")).count() >= 1


def test_stream_windows_equal_batch_windows(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{folder}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{folder}/events.parquet*")
    query = closed_window_counts(stream).writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.start, r.event_type): (r.n, r.total) for r in spark.table("windows").collect()}
    newest = events.agg(F.max("ts").alias("t")).first().t - timedelta(hours=8)
    batch = closed(events, "ts", F.lit(str(newest)).cast("timestamp_ntz")).groupBy("window.start", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    want = {(r.start, r.event_type): (r.n, r.total) for r in batch.collect()}
    assert got and got == want


def test_low_confidence_and_closing():
    sinking = [(*point(i, a, km=k), True) for i, (a, k) in enumerate([(9000.0, 40.0), (4500.0, 18.0), (2200.0, 5.0)])]
    assert assess(sinking) == "approaching"
    assert assess(sinking[:2] + [(*sinking[2][:5], False)]) == "probable"
    assert assess([point(0, 16000.0, km=1.0), point(5, None, True, 1.5, 15.0)]) == "insufficient"  # came from nowhere farther
    assert assess([point(0, 16000.0, km=2.0), point(5, None, True, 1.5, 15.0)]) == "confirmed"
