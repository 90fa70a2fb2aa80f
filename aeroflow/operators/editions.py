"""Editions: what each closed window says of an event that earlier windows did not."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from aeroflow.functions import text as T
from aeroflow.operators.briefings import briefing_window, section_top

ITEM = "event {kind}, start timestamp, row_id {id_kind}, state string, new_facts array<string>"


def eligible(title: Column, summary: Column, urls: Column) -> Column:
    """Whether a row can be an item: a title, a summary and a URL that may be shown."""
    some = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    return some(title) & some(summary) & F.coalesce(F.exists(urls, lambda u: T.is_safe_url(T.canonical_url(u))), F.lit(False))


def judged(known: set[str] | None, rows: Iterable[tuple]) -> tuple[set[str] | None, list[tuple]]:
    """States of an event's rows in one window, the newest first, and the facts known after it.

    ``rows``: (row, facts). The first row of an unknown event is new, and its facts are known from
    then on. Of a known event the first row with new facts is an update by these; rows before
    it are unchanged, rows after it (and after a new one) are skipped, as a window has one item.
    """
    out, told = [], False
    for row, facts in rows:
        if told:
            out.append((row, "skipped", []))
        elif known is None:
            known, told = set(facts), True
            out.append((row, "new", []))
        elif fresh := [f for f in dict.fromkeys(facts) if f not in known]:
            known, told = known | set(facts), True
            out.append((row, "update", fresh))
        else:
            out.append((row, "unchanged", []))
    return known, out


def edition_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that can be items, with the start and end of their window, and the ids of the others as warnings.

    ``rows``: event, row_id, ts, title, summary, urls, facts; further columns stay.
    """
    window = briefing_window(F.col("ts"))
    placed = rows.withColumns({"_ok": eligible(F.col("title"), F.col("summary"), F.col("urls")), "start": window["start"], "end": window["end"], "facts": F.coalesce("facts", F.array().cast("array<string>"))})
    warnings = placed.where(~F.col("_ok") & F.col("start").isNotNull()).select("start", "row_id", F.lit("no title, summary or source").alias("warning"))
    return placed.where("_ok and start is not null and event is not null").drop("_ok"), warnings


def edition_items(rows: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(event, start, row_id, state, new_facts) of each row that can be an item.

    ``rows`` as from ``edition_rows``; ``index``: event, facts of the events known before the first
    window. The rows of an event pass in order of windows, within a window from the newest, with
    the event's known facts in hand.
    """
    kinds = dict(rows.dtypes)
    given = rows.select("event", "row_id", F.col("ts").cast("timestamp").alias("ts"), F.col("start").cast("timestamp").alias("start"), "facts", F.lit(1).alias("side"))
    if index is not None:
        none = lambda c: F.lit(None).cast(dict(given.dtypes)[c]).alias(c)
        given = given.unionByName(index.select("event", none("row_id"), none("ts"), none("start"), "facts", F.lit(0).alias("side")))
    dealt = given.repartition("event").sortWithinPartitions("event", "side", "start", F.desc("ts"), "row_id")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        event, start, known, pending = None, None, None, []

        def done() -> list[tuple]:
            nonlocal known
            known, told = judged(known, pending)
            pending.clear()
            return [(event, start, *row) for row in told]

        for batch in batches:
            out = []
            for own, row_id, begin, facts, side in zip(batch["event"], batch["row_id"], batch["start"], batch["facts"], batch["side"]):
                if own != event or side and begin != start:
                    out += done() if pending else []
                    known = None if own != event else known
                    event, start = own, begin
                if side:
                    pending.append((row_id, list(facts)))
                else:
                    known = (known or set()) | set(facts)
            yield pd.DataFrame(out, columns=["event", "start", "row_id", "state", "new_facts"])
        if pending:
            yield pd.DataFrame(done(), columns=["event", "start", "row_id", "state", "new_facts"])

    return dealt.mapInPandas(fold, ITEM.format(kind=kinds["event"], id_kind=kinds["row_id"]))


def briefings(items: DataFrame, rows: DataFrame, warnings: DataFrame, degraded: DataFrame, section_rank: Column, each: int = 6, whole: int = 15) -> tuple[DataFrame, DataFrame]:
    """The items shown in each window, by section, and a row for each window with its counts and status.

    ``items`` from ``edition_items``, ``rows`` with row_id, section and order columns ts; ``degraded``: start
    of windows in which an input was missing. A window with degraded input is partial, never
    empty of events; warnings about single rows do not make it so.
    """
    told = items.where(F.col("state").isin("new", "update")).join(rows.select("row_id", "section", "ts"), "row_id")
    shown = section_top(told, ["start"], section_rank, [F.desc("ts"), F.col("row_id")], each, whole)
    windows = items.select("start").union(warnings.select("start")).union(degraded.select("start")).distinct()
    counts = shown.groupBy("start").agg(F.count("*").alias("n_items"), F.count_if(F.col("state") == "update").alias("n_updates"))
    warned = warnings.groupBy("start").agg(F.count("*").alias("n_warnings"))
    partial = degraded.select("start").distinct().withColumn("partial", F.lit(True))
    out = windows.join(counts, "start", "left").join(warned, "start", "left").join(partial, "start", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return shown, out.select("start", zero("n_items"), zero("n_updates"), zero("n_warnings"), F.when(F.col("partial"), "partial").otherwise("published").alias("status"))
