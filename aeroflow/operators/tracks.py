"""Aircraft observations and tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from aeroflow.functions.text import haversine_km


#: Kinds of sources that are vehicles on the ground, and those whose positions are rough.
GROUND_VEHICLES = ["adsb_icao_nt"]
ROUGH = ["tisb", "other", "mode_s", "mlat"]


def normalised(observations: DataFrame) -> DataFrame:
    """Typed observations: codes trimmed and upper-cased, altitude split from the ground flag.

    ``type`` and ``source_type`` come from the raw fields t and type; columns that the rows do not
    have (ts, type, ownOp) are left out or null.
    """
    there = lambda c: F.col(c) if c in observations.columns else F.lit(None).cast("string")
    code = lambda c: F.nullif(F.upper(F.trim(c)), F.lit(""))
    return observations.select(
        F.lower(F.trim(F.ltrim(F.col("hex"), F.lit("~")))).alias("hex"),
        F.startswith(F.trim("hex"), F.lit("~")).alias("non_icao"),
        code(F.col("r")).alias("registration"),
        code(F.col("t")).alias("type"),
        code(F.col("flight")).alias("callsign"),
        (F.col("alt_baro") == "ground").alias("on_ground"),
        F.col("alt_baro").try_cast("double").alias("alt_ft"),
        F.col("gs").alias("ground_speed"),
        "lat",
        "lon",
        "seen",
        "seen_pos",
        "dbFlags",
        "squawk",
        "emergency",
        there("type").alias("source_type"),
        F.coalesce(there("type").isin(*ROUGH), F.lit(False)).alias("low_confidence"),
        there("ownOp").alias("operator_name"),
        *(["ts"] if "ts" in observations.columns else []),
    )


def sensitive_reason(flags: Column, squawk: Column, emergency: Column) -> Column:
    """Why an aircraft is left out: military or privacy flags, or an emergency; else null."""
    bit = lambda n: F.coalesce(flags.bitwiseAND(n) != 0, F.lit(False))
    urgent = squawk.isin("7500", "7600", "7700") | (F.coalesce(emergency, F.lit("none")) != "none")
    return F.when(bit(1), "military").when(bit(4), "pia").when(bit(8), "ladd").when(urgent, "emergency")


def position_ok(lat: Column, lon: Column, seen: Column, seen_pos: Column, source_type: Column | None = None) -> Column:
    """Whether a row's position can prove something: at most 30 s old, the row at most 60 s, no ground vehicle."""
    fresh = lat.isNotNull() & lon.isNotNull() & (seen_pos <= 30) & F.coalesce(seen <= 60, F.lit(True))
    if source_type is not None:
        fresh = fresh & ~F.coalesce(source_type.isin(*GROUND_VEHICLES), F.lit(False))
    return F.coalesce(fresh, F.lit(False))


def track_status(points: DataFrame, keys: list[str], fence_km: float = 5.0) -> DataFrame:
    """What each track shows, from its points in order of time.

    ``points``: the keys, ts, point_id, alt_ft (null on the ground), on_ground, distance_km,
    ground_speed, low_confidence. In this order: a climb of over 2000 ft after the first lowest
    point is an overflight; on the ground inside the fence is insufficient at over 100 kt, else
    confirmed if an earlier point was below 15 000 ft or farther out than the last; three airborne
    points or more that sink by over 500 ft and close by over 2 km to within two fences and
    3000 ft, not all of low confidence, are a probable arrival; a last airborne point from
    15 000 ft on is an overflight; airborne points that close approach; others are observed.
    """
    order = Window.partitionBy(*keys).orderBy("ts", "point_id")
    marked = points.withColumn("_n", F.row_number().over(order))
    ends = marked.groupBy(*keys).agg(
        F.min_by("_n", F.when(F.col("alt_ft").isNotNull(), F.struct("alt_ft", "_n"))).alias("_low_n"),
        F.min("alt_ft").alias("low"),
        F.max("_n").alias("n_points"),
        F.max_by("distance_km", "_n").alias("last_km"),
    )
    in_air = F.when(F.col("alt_ft").isNotNull(), F.col("_n"))
    farther = F.col("distance_km") > F.col("last_km")
    facts = marked.join(ends, keys).groupBy(*keys).agg(
        F.first("n_points").alias("n_points"),
        F.max(F.when(F.col("_n") > F.col("_low_n"), F.col("alt_ft"))).alias("after_low"),
        F.first("low").alias("low"),
        F.max_by("on_ground", "_n").alias("last_ground"),
        F.max_by("ground_speed", "_n").alias("last_speed"),
        F.first("last_km").alias("last_km"),
        F.count("alt_ft").alias("airborne"),
        F.min_by("alt_ft", in_air).alias("first_alt"),
        F.max_by("alt_ft", in_air).alias("last_alt"),
        F.min_by("distance_km", in_air).alias("first_air_km"),
        F.max_by("distance_km", in_air).alias("last_air_km"),
        F.bool_and(F.when(F.col("alt_ft").isNotNull(), F.col("low_confidence"))).alias("unsure"),
        F.bool_or((F.col("_n") < F.col("n_points")) & (F.coalesce(F.col("alt_ft") < 15000, F.lit(False)) | farther)).alias("came"),
    )
    closing = F.col("first_air_km") - F.col("last_air_km")
    status = (
        F.when(F.col("after_low") - F.col("low") > 2000, "overflight")
        .when(F.col("last_ground") & (F.col("last_km") <= fence_km), F.when(F.col("last_speed") > 100, "insufficient").when(F.col("came"), "confirmed").otherwise("insufficient"))
        .when((F.col("airborne") >= 3) & (F.col("first_alt") - F.col("last_alt") > 500) & (closing > 2) & (F.col("last_air_km") <= 2 * fence_km) & (F.col("last_alt") <= 3000) & ~F.col("unsure"), "probable")
        .when(F.col("last_alt") >= 15000, "overflight")
        .when(closing > 0, "approaching")
        .otherwise("observed")
    )
    return facts.withColumn("status", status)


def cross_check(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Each primary observation against the second source: what agrees and what conflicts.

    ``check`` is unavailable without a row of the second source; conflicting if codes that both
    have differ, if one is on the ground and the other above 10 000 ft, or if positions are over
    30 km apart; primary_only if the second position is stale; else confirmed.
    """
    fields = ("registration", "type", "callsign", "on_ground", "alt_ft", "lat", "lon", "seen", "seen_pos", "source_type")
    s = secondary.select("hex", *(F.col(c).alias(f"s_{c}") for c in fields), F.lit(True).alias("s_there"))
    met = primary.join(s, "hex", "left")
    differs = lambda c: F.coalesce(F.upper(c) != F.upper(f"s_{c}"), F.lit(False))
    apart = F.coalesce((F.col("on_ground") & (F.col("s_alt_ft") > 10000)) | (F.col("s_on_ground") & (F.col("alt_ft") > 10000)), F.lit(False))
    placed = F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("s_lat").isNotNull() & F.col("s_lon").isNotNull()
    far = F.coalesce(placed & (haversine_km(F.col("lat"), F.col("lon"), F.col("s_lat"), F.col("s_lon")) > 30), F.lit(False))
    stale = ~position_ok(*(F.col(f"s_{c}") for c in ("lat", "lon", "seen", "seen_pos", "source_type")))
    conflict = differs("registration") | differs("type") | differs("callsign") | apart | far
    return met.withColumn("check", F.when(F.col("s_there").isNull(), "unavailable").when(conflict, "conflicting").when(stale, "primary_only").otherwise("confirmed")).drop("s_there")
