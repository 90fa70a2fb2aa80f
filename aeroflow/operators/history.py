"""Matches against history and dimensions: counts, rarity, prices, aliases, dated rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from aeroflow.storage import materialise


def history_counts(rows: DataFrame, history: DataFrame, row_id: str, key: str, day: str, windows: Sequence[int]) -> DataFrame:
    """How many history rows of the same key lie in the days before each row; a null key: any.

    ``rows`` and ``history`` have ``key`` and ``day`` (dates). History is counted by key and day,
    and once more by day for the null key; sums over the days before then run in a window of at
    most one row for each day, so a frequent key is no large group, and rows meet their counts by
    an equality of key and day.
    """
    number = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    counted = history.where(F.col(key).isNotNull()).groupBy(key, day).agg(F.count("*").alias("n"))
    everything = history.groupBy(day).agg(F.count("*").alias("n")).select(F.lit(None).cast(history.schema[key].dataType).alias(key), day, "n")
    asked = rows.select(key, day).distinct().withColumn("n", F.lit(0).cast("long"))
    days = counted.unionByName(everything).unionByName(asked).groupBy(key, day).agg(F.sum("n").alias("n")).withColumn("_n", number)
    before = lambda n: Window.partitionBy(key).orderBy("_n").rangeBetween(-n, -1)
    sums = days.select(F.col(key).alias("_k"), F.col(day).alias("_d"), *(F.coalesce(F.sum("n").over(before(n)), F.lit(0)).alias(f"n_{n}d") for n in windows))
    return rows.select(row_id, key, day).join(sums, F.col(key).eqNullSafe(F.col("_k")) & (F.col(day) == F.col("_d")), "left").select(row_id, *(f"n_{n}d" for n in windows))


def rarity(rows: DataFrame) -> DataFrame:
    """Score 0 to 100 from counts and flags, and the reasons in order.

    ``rows``: unusual_operator, unusual_type, usual_operator, usual_type, flagged booleans and
    n_combo_180d, n_registration_365d, n_repeat_30d.
    """
    parts = [
        ("unusual operator", F.col("unusual_operator"), 35),
        ("no such combination in 180 days", F.col("n_combo_180d") == 0, 25),
        ("new registration in 365 days", F.col("n_registration_365d") == 0, 15),
        ("unusual type", F.col("unusual_type"), 15),
        ("flagged", F.col("flagged"), 10),
        ("usual operator", F.col("usual_operator"), -40),
        ("usual type", F.col("usual_type"), -15),
    ]
    score = F.lit(0)
    for _, when, points in parts:
        score = score + F.when(when, points).otherwise(0)
    score = score - 30 * F.least(F.col("n_repeat_30d"), F.lit(2))
    reasons = F.array_compact(F.array(*(F.when(when, F.lit(name)) for name, when, _ in parts)))
    return rows.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int")).withColumn("reasons", reasons)


def watched(rows: DataFrame, watchlist: DataFrame, keys: Sequence[str], row_id: str) -> DataFrame:
    """The first watchlist entry (by ``entry``) that a row fits; a null in an entry fits anything.

    The watchlist is a small dimension kept by hand.
    """
    fits = F.lit(True)
    for key in keys:
        fits = fits & (watchlist[key].isNull() | (watchlist[key] == rows[key]))
    met = rows.join(watchlist, fits).select(rows[row_id], watchlist["entry"])
    return met.groupBy(row_id).agg(F.min("entry").alias("entry"))


def longest_match(rows: DataFrame, prices: DataFrame, label: str, pattern: str, row_id: str) -> DataFrame:
    """For each row the price whose pattern is the longest substring of its label."""
    met = rows.join(prices, F.contains(F.lower(rows[label]), F.lower(prices[pattern])), "left")
    best = Window.partitionBy(row_id).orderBy(F.desc_nulls_last(F.length(pattern)), pattern)
    return met.withColumn("_place", F.row_number().over(best)).where("_place = 1").drop("_place")


def dated_rows(rows: DataFrame, dimension: DataFrame, key: str, day: str, since: str, through: str) -> DataFrame:
    """Dimension rows of the same key that are valid on a row's day; open ends are null."""
    valid = (F.col(since).isNull() | (F.col(since) <= F.col(day))) & (F.col(through).isNull() | (F.col(day) <= F.col(through)))
    return rows.join(dimension, key).where(valid)


def resolved(mentions: DataFrame, aliases: DataFrame, mention: str) -> DataFrame:
    """The entity of each mention; a name that stands for several entities resolves to none.

    ``aliases``: alias, entity.
    """
    unique = aliases.groupBy(F.lower("alias").alias("_alias")).agg(F.count_distinct("entity").alias("_n"), F.min("entity").alias("entity")).where("_n = 1")
    return mentions.join(unique, F.lower(F.col(mention)) == F.col("_alias"), "left").drop("_alias", "_n")


#: Points of one position that meet places in one part, and pairs of one task, about.
PART = 1024
TASK_PAIRS = 8_000_000


def within_radius(points: DataFrame, places: DataFrame, lat: tuple[str, str], lon: tuple[str, str], distance: Column, cell: float = 2.0) -> DataFrame:
    """Points with every place whose ``radius_km`` reaches them.

    The globe is cut into cells of ``cell`` degrees; a place stands in every cell that its radius
    touches, so points meet places by an equality of cells, of whatever number. ``lat`` and ``lon``
    name the columns of points and of places. Cells run over the date line.
    """
    across = int(360 / cell)
    column = lambda c: F.pmod(F.floor((c + 180) / cell).cast("int"), F.lit(across))
    row = lambda c: F.floor((c + 90) / cell).cast("int")
    high = F.degrees(F.col("radius_km") / 6371.0)
    edge = F.abs(F.col(lat[1])) + high
    wide = F.when(edge >= 89, F.lit(180.0)).otherwise(F.least(F.lit(180.0), F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(high)) / F.cos(F.radians(F.col(lat[1]))))))))
    steps = F.sequence(F.floor((F.col(lon[1]) - wide + 180) / cell).cast("int"), F.floor((F.col(lon[1]) + wide + 180) / cell).cast("int"))
    reached = places.select("*", F.explode(F.sequence(row(F.col(lat[1]) - high), row(F.col(lat[1]) + high))).alias("_row"), F.array_distinct(F.transform(steps, lambda x: F.pmod(x, F.lit(across)))).alias("_columns"))
    reached = reached.select("*", F.explode("_columns").alias("_column")).drop("_columns")
    placed = points.withColumns({"_row": row(F.col(lat[0])), "_column": column(F.col(lon[0]))})
    return placed.join(reached, ["_row", "_column"]).drop("_row", "_column").withColumn("distance_km", distance).where(F.col("distance_km") <= F.col("radius_km"))


def copies_within_radius(points: DataFrame, places: DataFrame, lat: tuple[str, str], lon: tuple[str, str], distance: Column) -> DataFrame:
    """As ``within_radius``, for points and places of which many stand at one position.

    Positions meet first, so a distance is told once for all that stand there. The pairs of
    positions are then spread to points and places, the points of a position in parts of about ``PART``,
    over as many tasks as the number of pairs asks for.
    """
    spots = materialise(points.groupBy(lat[0], lon[0]).agg(F.count("*").alias("_points")), "radius-spots")
    site = [lat[1], lon[1], "radius_km"]
    sites = materialise(places.groupBy(*site).agg(F.count("*").alias("_places")), "radius-sites")
    near = materialise(within_radius(spots, sites, lat, lon, distance), "radius-positions")
    pairs = near.agg(F.sum(F.col("_points").cast("double") * F.col("_places"))).first()[0] or 0
    tasks = int(pairs // TASK_PAIRS) + 1
    parts = F.ceil(F.col("_points") / PART)
    own = points.join(spots, [lat[0], lon[0]]).withColumn("_part", F.pmod(F.xxhash64(*points.columns), parts)).drop("_points")
    reached = places.join(near, site).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_points", "_places")
    keys = [lat[0], lon[0], "_part"]
    return own.repartition(tasks, *keys).join(reached.repartition(tasks, *keys).hint("merge"), keys).drop("_part")
