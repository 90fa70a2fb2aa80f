"""Fixed windows, updates across windows, sections and request limits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from aeroflow.operators.scan import before, deal
from aeroflow.storage import materialise

#: Windows of 8 hours that end at 07, 15 and 23 UTC.
WINDOW_HOURS, OFFSET_HOURS = 8, 7


def briefing_window(stamp: Column) -> Column:
    """The half-open window of a time: a time on the edge belongs to the later window."""
    return F.window(stamp, f"{WINDOW_HOURS} hours", f"{WINDOW_HOURS} hours", f"{OFFSET_HOURS} hours")


def closed(rows: DataFrame, stamp: str, as_of: Column) -> DataFrame:
    """Rows with their window, without windows that are still open at ``as_of``."""
    return rows.withColumn("window", briefing_window(F.col(stamp))).where(F.col("window.end") <= as_of)


def event_updates(rows: DataFrame, event: str, stamp: str, fact: str, row_id: str) -> DataFrame:
    """What each window says of an event: new, update (facts not known before) or unchanged.

    A fact belongs to the window that names it first; earlier windows hide it later.
    """
    windowed = rows.withColumn("start", briefing_window(F.col(stamp))["start"])
    first = windowed.groupBy(event, fact).agg(F.min("start").alias("start")).groupBy(event, "start").agg(F.array_sort(F.collect_set(fact)).alias("new_facts"))
    seen = windowed.groupBy(event, "start").agg(F.count("*").alias("n_rows"), F.min(row_id).alias("first_row"))
    opened = F.min("start").over(Window.partitionBy(event))
    joined = seen.join(first, [event, "start"], "left").withColumn("_opened", opened)
    state = F.when(F.col("start") == F.col("_opened"), "new").when(F.col("new_facts").isNotNull(), "update").otherwise("unchanged")
    return joined.withColumn("state", state).drop("_opened")


def section_top(rows: DataFrame, groups: Sequence[str], section_rank: Column, order: Sequence[Column], each: int = 6, whole: int = 15) -> DataFrame:
    """At most ``each`` rows a section and ``whole`` in all, trimmed from the last section."""
    own = Window.partitionBy(*groups, "section").orderBy(*order)
    kept = rows.withColumn("place", F.row_number().over(own)).where(F.col("place") <= each)
    across = Window.partitionBy(*groups).orderBy(section_rank, "place")
    return kept.withColumn("total_place", F.row_number().over(across)).where(F.col("total_place") <= whole)


def rate_limited(
    requests: DataFrame,
    user: str,
    stamp: str,
    request: str,
    per_minute: int = 8,
    per_day: int = 50,
    cooldown_s: int = 30,
    question: str | None = None,
    cost: str | None = None,
    budget: float | None = None,
    external: str | None = None,
    external_per_day: int = 10,
) -> DataFrame:
    """user, request, decision and external (null where none was asked for) of each request.

    ``decision`` is, in this order, minute (``per_minute`` requests in the 60 seconds before), cooldown
    (an equal question less than ``cooldown_s`` before), day (``per_day`` answers of the model),
    over_budget (the costs of all users' answers of the day have reached ``budget``; answered without
    the model, at no cost) or allowed. Denied requests do not count. ``external`` says whether a
    request that was not denied may search outside, ``external_per_day`` times a day. Days begin anew.

    A user's requests pass in order of time and id; held are the last minute's times and the day's
    totals. The budget is one for all users: as costs only grow, it is reached at one moment of a
    day, and what comes before does not depend on it. So users are judged without a budget first;
    running totals over parts of a day give the moment; then they are judged by it.
    """
    null = lambda c, kind: F.col(c).cast(kind) if c else F.lit(None).cast(kind)
    rows = requests.select(F.col(user).alias("user"), F.col(request).alias("request"), F.col(stamp).cast("timestamp").alias("ts"), null(question, "string").alias("question"), null(cost, "double").alias("cost"), null(external, "boolean").alias("external"))
    kinds = dict(rows.dtypes)
    limits = (per_minute, per_day, cooldown_s, external_per_day)
    out = f"user {kinds['user']}, request {kinds['request']}, ts timestamp, cost double, decision string, external boolean"

    def judged(rows: DataFrame) -> DataFrame:
        """``rows`` with reached: the first request of their day that finds the budget used, if any."""
        dealt = rows.repartition("user").sortWithinPartitions("user", "ts", "request")
        return dealt.mapInPandas(_limits(*limits), out)

    nothing = F.lit(None).cast(f"struct<ts:timestamp,request:{kinds['request']}>").alias("reached")
    if budget is None:
        return judged(rows.select("*", nothing)).select("user", "request", "decision", "external")
    rows = materialise(rows.withColumn("day", F.to_date("ts")), "limit-requests")
    free = judged(rows.drop("day").select("*", nothing)).where("decision = 'allowed'").select(F.to_date("ts").alias("day"), "ts", "request", "cost")
    order = [F.col("ts"), F.col("request")]
    spent = before(deal(free, ["day"], order, "limit-costs"), ["day"], order, {"spent": (F.sum, F.coalesce("cost", F.lit(0.0)))})
    last = spent.where(F.col("spent") + F.coalesce("cost", F.lit(0.0)) >= budget).groupBy("day").agg(F.min(F.struct("ts", "request")).alias("reached"))  # the answer that uses the budget up
    cut = materialise(last, "limit-reached")
    return judged(rows.join(cut, "day", "left").drop("day")).select("user", "request", "decision", "external")


def _limits(per_minute: int, per_day: int, cooldown_s: int, external_per_day: int):
    """The decisions for requests in order of user and time; later than ``reached`` the budget is used."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, day, answers, searches = None, None, 0, 0
        recent: list[float] = []
        last: dict[str, float] = {}
        for b in batches:
            out, outside = [], []
            for user_id, request, ts, q, wants, reached in zip(b["user"], b["request"], b["ts"], b["question"], b["external"], b["reached"]):
                if own is None or own[0] != user_id or ts.date() != day:
                    own, day, answers, searches, recent, last = (user_id,), ts.date(), 0, 0, [], {}
                t = ts.timestamp()
                recent = [x for x in recent if x >= t - 60]
                last = {k: x for k, x in last.items() if t - x < cooldown_s}
                used = reached is not None and (ts, request) > (pd.Timestamp(reached["ts"]), reached["request"])
                if len(recent) >= per_minute:
                    out.append("minute")
                elif q is not None and q in last:
                    out.append("cooldown")
                elif answers >= per_day:
                    out.append("day")
                else:
                    out.append("over_budget" if used else "allowed")
                    answers += not used
                    recent.append(t)
                    if q is not None:
                        last[q] = t
                may = out[-1] in ("allowed", "over_budget") and searches < external_per_day
                searches += bool(wants) and may
                outside.append(may if wants else None)
            yield b.assign(decision=out, external=pd.Series(outside, index=b.index, dtype=object))[["user", "request", "ts", "cost", "decision", "external"]]

    return fold
