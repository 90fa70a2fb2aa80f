"""Usage, reliability and series metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def usage_totals(calls: DataFrame, label: str, events: str, tokens_in: str, tokens_out: str) -> DataFrame:
    """Calls, calls without usage data and token sums per label, with a row (null) for all."""
    return calls.rollup(label).agg(F.count("*").alias("calls"), F.greatest(F.lit(0), F.count("*") - F.count(events)).alias("unknown_calls"), F.sum(tokens_in).alias("tokens_in"), F.sum(tokens_out).alias("tokens_out"))


def attempt_reliability(attempts: DataFrame, run: str, order: str, label: str, status: str, duration: str) -> DataFrame:
    """Per label: attempts, successes, failures, fallbacks, share of successes, mean duration.

    An attempt is a fallback if its label is not the label of its run's first attempt.
    """
    first = F.first(label).over(Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    marked = attempts.withColumn("_fallback", F.col(label) != first)
    ok = F.col(status) == "ok"
    return marked.groupBy(label).agg(
        F.count("*").alias("attempts"),
        F.count_if(ok).alias("successes"),
        F.count_if(~ok).alias("failures"),
        F.count_if("_fallback").alias("fallbacks"),
        F.round(100.0 * F.count_if(ok) / F.count("*"), 1).alias("success_share"),
        F.round(F.avg(duration), 4).alias("mean_duration"),
    )


def run_summary(attempts: DataFrame, run: str, order: str, label: str, status: str) -> DataFrame:
    """One row over all runs: how many, ended well, with a fallback, and attempts in all."""
    runs = attempts.groupBy(run).agg(F.count("*").alias("n"), F.max_by(status, order).alias("last"), F.count_distinct(label).alias("labels"))
    return runs.agg(F.count("*").alias("runs"), F.count_if(F.col("last") == "ok").alias("published"), F.count_if(F.col("labels") > 1).alias("with_fallback"), F.sum("n").alias("attempts"))


def assist_totals(events: DataFrame, kind: str, value: str) -> DataFrame:
    """Events, errors and summed values by kind."""
    return events.groupBy(kind).agg(F.count("*").alias("events"), F.count_if(F.col(value).isNull()).alias("unknown"), F.round(F.sum(value), 4).alias("total"))


def series_context(series: DataFrame, day: str, value: str) -> DataFrame:
    """For each day: the previous row, 7- and 30-day means (of two rows or more), the 30-day peak
    with its day, and the value 30 days ago. The day itself is left out of what precedes it.

    ``series``: one row per day.
    """
    n = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    whole = Window.orderBy("_n")  # a row for each day
    before = lambda days: whole.rangeBetween(-days, -1)
    mean = lambda days: F.when(F.count(value).over(before(days)) >= 2, F.round(F.avg(value).over(before(days)), 4))
    peak = F.max(F.struct(F.col(value).alias("v"), (-F.col("_n")).alias("n"))).over(before(30))
    return series.withColumn("_n", n).select(
        day,
        value,
        F.lag(value).over(whole).alias("previous"),
        mean(7).alias("mean_7d"),
        mean(30).alias("mean_30d"),
        peak["v"].alias("peak_30d"),
        F.date_add(F.lit("1970-01-01").cast("date"), -peak["n"]).alias("peak_day"),
        F.max(value).over(whole.rangeBetween(-30, -30)).alias("month_ago"),
    )


def retained(rows: DataFrame, stamp: str, as_of: Column, days: int, cap: int, order: Sequence[Column]) -> DataFrame:
    """Rows at most ``days`` old (inclusive), the first ``cap`` of them in ``order``."""
    young = rows.where(F.timestamp_diff("MINUTE", F.col(stamp), as_of) <= days * 1440)
    return young.orderBy(*order).limit(cap)
