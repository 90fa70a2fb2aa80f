"""Editions over a stream: event state from a stored index, told when windows close."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType, TimestampType

from aeroflow.operators.editions import judged

RETAIN = pd.Timedelta(days=90)


class _Editions(StatefulProcessor):
    """Holds an event's rows until their window closes, and its known facts until long after."""

    def __init__(self, kind, id_kind):
        self.kind, self.id_kind = kind, id_kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", StructType([StructField("there", BooleanType()), StructField("facts", ArrayType(StringType()))]))
        self.pending = handle.getListState("pending", StructType([StructField("start", TimestampType()), StructField("end", TimestampType()), StructField("ts", TimestampType()), StructField("row_id", self.id_kind), StructField("facts", ArrayType(StringType()))]))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        facts = sorted({f for own in initialState["facts"] for f in own})
        self.known.update((True, facts))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for r in pdf.itertuples():
                self.pending.appendValue((r.start.to_pydatetime(), r.end.to_pydatetime(), r.ts.to_pydatetime(), r.row_id, list(r.facts)))
                self.handle.registerTimer(int(r.end.timestamp() * 1000))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        rows = [tuple(r) for r in self.pending.get()] if self.pending.exists() else []
        due = [r for r in rows if r[1].timestamp() * 1000 <= now]
        rest = [r for r in rows if r[1].timestamp() * 1000 > now]
        if not due:
            if not rest:  # the event has been silent for long
                self.known.clear()
            return
        known, out = set(self.known.get()[1]) if self.known.exists() else None, []
        for start in sorted({r[0] for r in due}):
            own = sorted((r for r in due if r[0] == start), key=lambda r: r[3])
            own.sort(key=lambda r: r[2], reverse=True)
            known, told = judged(known, [(r[3], r[4]) for r in own])
            out += [(key[0], start, *row) for row in told]
        self.known.update((True, sorted(known)))
        self.pending.clear()
        for r in rest:
            self.pending.appendValue(r)
        self.handle.registerTimer(now + int(RETAIN.total_seconds() * 1000))
        yield pd.DataFrame(out, columns=["event", "start", "row_id", "state", "new_facts"])

    def close(self) -> None:
        pass


def edition_stream(rows: DataFrame, index: DataFrame | None = None, late: str = "1 hour") -> DataFrame:
    """The states of ``operators.editions.edition_items`` over a stream of rows, told as windows close.

    ``rows`` as from ``edition_rows`` with ts a timestamp; ``index``: event, facts known before the stream
    began (its initial state). Rows later than ``late`` are lost to their window. An event's facts
    are forgotten 90 days after its last window. Needs the RocksDB state store.
    """
    kinds = {f.name: f.dataType for f in rows.schema}
    out = StructType([StructField("event", kinds["event"]), StructField("start", TimestampType()), StructField("row_id", kinds["row_id"]), StructField("state", StringType()), StructField("new_facts", ArrayType(StringType()))])
    timed = rows.select("event", "row_id", "ts", "start", "end", "facts").withWatermark("ts", late)
    first = index.select("event", "facts").groupBy("event") if index is not None else None
    return timed.groupBy("event").transformWithStateInPandas(statefulProcessor=_Editions(kinds["event"], kinds["row_id"]), outputStructType=out, outputMode="Append", timeMode="EventTime", initialState=first)
