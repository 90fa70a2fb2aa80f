"""Source snapshots: stamps, carried items, status, capped logs, upserts and deltas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_seen(rows: DataFrame, keys: Sequence[str], stamp: str, fallback: str) -> DataFrame:
    """Rows without a ``stamp`` get the first ``fallback`` of their keys, flagged ``inferred``."""
    earliest = F.min(fallback).over(Window.partitionBy(*keys))
    return rows.withColumn("inferred", F.col(stamp).isNull()).withColumn(stamp, F.coalesce(F.col(stamp), earliest))


def carried_forward(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, ok: Column) -> DataFrame:
    """A failed fetch takes over the last good value before it."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("carried", F.last(F.when(ok, F.col(value)), ignorenulls=True).over(before))


def source_status(fetches: DataFrame, source: str, stamp: str, ok: Column) -> DataFrame:
    """Last successful fetch, last fetch and whether it succeeded, per source."""
    return fetches.groupBy(source).agg(F.max(F.when(ok, F.col(stamp))).alias("last_ok"), F.max(stamp).alias("last_fetch"), F.max_by(ok, F.struct(stamp, F.when(ok, 1).otherwise(0))).alias("ok"), F.count("*").alias("fetches"))


def coverage_warnings(status: DataFrame, as_of: Column, max_hours: int) -> DataFrame:
    """Sources that fail or have been silent for long."""
    silent = F.timestamp_diff("HOUR", F.col("last_ok"), as_of) > max_hours
    reason = F.when(F.col("last_ok").isNull(), "never").when(silent, "silent").when(~F.col("ok"), "failing")
    return status.withColumn("warning", reason).where("warning is not null")


def newest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], cap: int) -> DataFrame:
    """The first ``cap`` rows of each key in the given order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= cap)


def clipped(text: Column, chars: int) -> Column:
    return F.when(F.length(text) > chars, F.concat(F.rtrim(F.substring(text, 1, chars - 1)), F.lit("…"))).otherwise(text)


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` replaces rows of ``old`` with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def index_delta(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Each key as added, removed, updated or unchanged by comparing a hash of its content."""
    both = old.select(key, F.col(value).alias("was")).join(new.select(key, F.col(value).alias("now")), key, "full")
    state = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "updated").otherwise("unchanged")
    return both.select(key, state.alias("state"))


def distinct_links(rows: DataFrame, key: str, canonical: str, order: Sequence[str]) -> DataFrame:
    """The first row of each canonical URL within a key."""
    return newest(rows, [key, canonical], [F.col(c) for c in order], 1).drop("place")
