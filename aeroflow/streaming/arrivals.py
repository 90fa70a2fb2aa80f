"""From a stream of aircraft observations to arrivals and the tables they are written to."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StringType, StructField, StructType, TimestampType

from aeroflow.functions.text import haversine_km
from aeroflow.operators.history import within_radius
from aeroflow.operators.tracks import normalised, position_ok, sensitive_reason

MAX_POINTS = 24
MAX_AGE = pd.Timedelta(minutes=60)

POINT = StructType([StructField("ts", TimestampType()), StructField("alt_ft", DoubleType()), StructField("on_ground", BooleanType()), StructField("distance_km", DoubleType()), StructField("ground_speed", DoubleType()), StructField("low_confidence", BooleanType())])
WHO = [StructField(c, StringType()) for c in ("registration", "type", "callsign")]
ARRIVAL = StructType([StructField("eid", StringType()), StructField("hex", StringType()), StructField("airport", StringType()), StructField("day", StringType()), StructField("ts", TimestampType()), StructField("first_seen", TimestampType()), *WHO])


def assess(points: list[tuple], fence_km: float = 5.0) -> str:
    """What a track of (ts, alt_ft, on_ground, distance_km, ground_speed[, low_confidence]) shows, in order of time.

    The same rules as the batch form ``operators.tracks.track_status``.
    """
    air = [(i, p) for i, p in enumerate(points) if p[1] is not None]
    if not points:
        return "insufficient"
    if air:
        low_at, low = min(((i, p[1]) for i, p in air), key=lambda x: (x[1], x[0]))
        if max((p[1] for i, p in air if i > low_at), default=low) - low > 2000:
            return "overflight"
    last = points[-1]
    if last[2] and last[3] <= fence_km:
        came = any((p[1] is not None and p[1] < 15000) or p[3] > last[3] for p in points[:-1])
        return "insufficient" if last[4] > 100 or not came else "confirmed"
    if not air:
        return "observed"
    (_, begin), (_, end) = air[0], air[-1]
    sure = not all(len(p) > 5 and p[5] for _, p in air)
    if len(air) >= 3 and begin[1] - end[1] > 500 and begin[3] - end[3] > 2 and end[3] <= 2 * fence_km and end[1] <= 3000 and sure:
        return "probable"
    if end[1] >= 15000:
        return "overflight"
    return "approaching" if end[3] < begin[3] else "observed"


def usable(observations: DataFrame) -> DataFrame:
    """Typed observations that may be followed: known addresses, nothing sensitive, a fresh position.

    ``observations`` are raw, with ts. For a stream or a table.
    """
    rows = normalised(observations).where(~F.coalesce("non_icao", F.lit(False)))
    rows = rows.where(sensitive_reason(F.col("dbFlags"), F.col("squawk"), F.col("emergency")).isNull())
    return rows.where(position_ok(F.col("lat"), F.col("lon"), F.col("seen"), F.col("seen_pos"), F.col("source_type")))


def track_points(observations: DataFrame, airports: DataFrame) -> DataFrame:
    """A point for each usable observation and each airport in whose reach it is.

    ``airports``: airport, ap_lat, ap_lon, radius_km, fence_km. A stream meets the airports by equal
    grid cells, so their number is free.
    """
    rows = usable(observations)
    distance = haversine_km(F.col("lat"), F.col("lon"), F.col("ap_lat"), F.col("ap_lon"))
    met = within_radius(rows, airports, ("lat", "ap_lat"), ("lon", "ap_lon"), distance)
    speed = F.coalesce("ground_speed", F.lit(0.0)).alias("ground_speed")
    return met.select("hex", "airport", "ts", "alt_ft", "on_ground", F.round("distance_km", 2).alias("distance_km"), speed, "low_confidence", "fence_km", *(f.name for f in WHO))


class _Tracks(StatefulProcessor):
    """Keeps the last hour of each (hex, airport), tells a confirmed arrival once a day, and forgets.

    A timer an hour after the newest point drops the points; the day that was told goes when no
    later point of that day can come.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.points = handle.getListState("points", POINT)
        self.told = handle.getValueState("told", StructType([StructField("day", StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        points = [tuple(p) for p in self.points.get()] if self.points.exists() else []
        new, fence = [], 5.0
        for pdf in rows:
            for r in pdf.itertuples():
                fence = float(r.fence_km)
                new.append(((r.ts.to_pydatetime(), None if pd.isna(r.alt_ft) else float(r.alt_ft), bool(r.on_ground), float(r.distance_km), float(r.ground_speed), bool(r.low_confidence)), tuple(getattr(r, f.name) for f in WHO)))
        told = self.told.get()[0] if self.told.exists() else None
        for point, who in sorted(new, key=lambda x: (x[0][0], x[0][3])):
            points = sorted({*points, point}, key=lambda p: (p[0], p[3]))
            points = [p for p in points if points[-1][0] - p[0] <= MAX_AGE][-MAX_POINTS:]
            day = str(points[-1][0].date())
            if told != day and assess(points, fence) == "confirmed":
                told = day
                self.told.update((day,))
                row = {"eid": None, "hex": key[0], "airport": key[1], "day": day, "ts": points[-1][0], "first_seen": points[0][0]}
                yield pd.DataFrame([row | {f.name: x for f, x in zip(WHO, who)}])
        self.points.put(points)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        newest = points[-1][0]
        for due in (newest + MAX_AGE, newest.replace(hour=0, minute=0, second=0, microsecond=0) + pd.Timedelta(days=1) + MAX_AGE):
            self.handle.registerTimer(max(int(due.timestamp() * 1000), timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        points = [tuple(p) for p in self.points.get()] if self.points.exists() else []
        if not points or now - pd.Timestamp(points[-1][0]).tz_localize(None) >= MAX_AGE:
            self.points.clear()
        if self.told.exists() and now >= pd.Timestamp(self.told.get()[0]) + pd.Timedelta(days=1) + MAX_AGE:
            self.told.clear()
        yield from ()

    def close(self) -> None:
        pass


def event_id(hex_code: Column, airport: Column, day: Column) -> Column:
    """The id of an aircraft's arrival at an airport on a day."""
    return F.substring(F.sha2(F.concat_ws("|", hex_code, airport, day), 256), 1, 16)


def confirmed_arrivals(points: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A stream of arrivals from a stream of points (see ``track_points``), each aircraft, airport and day once.

    Points may be ``late`` by so much. State is bounded: 24 points of the last hour for each aircraft
    and airport, dropped by a timer when the watermark is an hour past the newest. Needs the
    RocksDB state store.
    """
    timed = points.withWatermark("ts", late)
    out = timed.groupBy("hex", "airport").transformWithStateInPandas(statefulProcessor=_Tracks(), outputStructType=ARRIVAL, outputMode="Append", timeMode="EventTime")
    return out.withColumn("eid", event_id(F.col("hex"), F.col("airport"), F.col("day")))


class ArrivalSinks:
    """``foreachBatch`` target that scores arrivals and writes them to three tables.

    ``folder`` gets history (every arrival), events (a decision for each id) and queue (those to
    report on). Each batch is a partition named by its number, written whole, and is judged
    by the partitions of earlier batches only. So a batch that is run again, after a failure
    between two of the writes too, finds what it found before and writes the same rows.

    ``judge(arrivals, history)`` gives the columns score (0 to 100), watched and second (what
    another source says: ``conflict`` or other) to new arrivals.
    """

    TABLES = ("history", "events", "queue")

    def __init__(self, folder: str, judge, threshold: int = 60, warm_up_days: int = 30, delay_minutes: int = 30):
        self.folder, self.judge, self.threshold, self.warm_up_days, self.delay_minutes = folder, judge, threshold, warm_up_days, delay_minutes

    def _exists(self, spark: SparkSession, path: str) -> bool:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)

    def read(self, spark: SparkSession, name: str, schema: StructType, before: int | None = None) -> DataFrame:
        """The rows of a table, or those of the batches before one."""
        path = f"{self.folder}/{name}"
        if not self._exists(spark, path):
            return spark.createDataFrame([], schema).withColumn("batch_id", F.lit(0))
        rows = spark.read.schema(StructType([*schema, StructField("batch_id", IntegerType())])).parquet(path)
        return rows if before is None else rows.where(F.col("batch_id") < before)

    def __call__(self, arrivals: DataFrame, batch_id: int) -> None:
        spark = arrivals.sparkSession
        known = StructType([StructField("eid", StringType())])
        fresh = arrivals.dropDuplicates(["eid"]).join(self.read(spark, "events", known, batch_id).select("eid").distinct(), "eid", "left_anti")
        past = self.read(spark, "history", arrivals.schema, batch_id)
        first = past.agg(F.min("ts").alias("first"))
        judged = self.judge(fresh, past.drop("batch_id")).crossJoin(F.broadcast(first))  # one row
        low = (F.col("score") < self.threshold) & ~F.coalesce("watched", F.lit(False))
        status = F.when(low, "rejected").when(F.col("second") == "conflict", "rejected").otherwise("candidate")
        reason = F.when(low, "below threshold").when(F.col("second") == "conflict", "conflicting sources")
        warm = F.col("first").isNull() | (F.col("ts") < F.col("first") + F.expr(f"interval {self.warm_up_days} days"))
        routed = judged.withColumns({"status": status, "reason": reason, "warm_up": warm, "not_before": F.col("ts") + F.expr(f"interval {self.delay_minutes} minutes")})
        tables = {
            "history": routed.select(*arrivals.columns),
            "events": routed.select("eid", "status", "reason", "score", "ts"),
            "queue": routed.where("status = 'candidate'").select("eid", "hex", "airport", "ts", "not_before", "score", "second", "warm_up"),
        }
        routed.persist()
        try:
            for name in self.TABLES:
                tables[name].write.mode("overwrite").parquet(f"{self.folder}/{name}/batch_id={batch_id}")
        finally:
            routed.unpersist()


def released(queue: DataFrame, as_of: Column) -> DataFrame:
    """Queued arrivals that may be reported: past their delay, and not of the warm-up, in which everything is rare."""
    return queue.where((F.col("not_before") <= as_of) & ~F.col("warm_up"))
