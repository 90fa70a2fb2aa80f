"""Editions of a table and of a stream, against a plain reading of the rules."""

import random
from collections import Counter
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from aeroflow.operators.editions import edition_items, edition_rows
from aeroflow.streaming.editions import edition_stream

SCHEMA = "event string, row_id long, ts timestamp, title string, summary string, urls array<string>, facts array<string>"
T0 = datetime(2024, 1, 5, 0, 0)


def articles(seed=5, n=260):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        ok = rng.random() < 0.9
        facts = rng.choice([[f"f{rng.randrange(12)}" for _ in range(rng.randrange(3))], None])
        rows.append((rng.choice(["storm", "storm", "strike", "merger", f"one{i}"]), i, T0 + timedelta(minutes=rng.randrange(0, 60 * 96, 20)), "T" if ok else " ", "S", ["https://x.org/a"] if rng.random() < 0.95 else [], facts))
    return rows + [(None, 9000, T0, "T", "S", ["https://x.org/a"], [])]


def plain(rows, index):
    start = lambda t: (t - timedelta(hours=7)).replace(minute=0, hour=(t - timedelta(hours=7)).hour // 8 * 8) + timedelta(hours=7)
    known = {k: set(v) for k, v in index.items()}
    out, told = {}, set()
    good = [r for r in rows if r[0] and r[3].strip() and r[5]]
    for r in sorted(good, key=lambda r: (start(r[2]), -r[2].timestamp(), r[1])):
        own, facts = r[0], list(dict.fromkeys(r[6] or []))
        if (own, start(r[2])) in told:
            state, fresh = "skipped", []
        elif own not in known:
            state, fresh, known[own] = "new", [], set(facts)
        else:
            fresh = [f for f in facts if f not in known[own]]
            state = "update" if fresh else "unchanged"
            known[own] |= set(fresh)
        if state in ("new", "update"):
            told.add((own, start(r[2])))
        out[r[1]] = (own, start(r[2]), state, fresh)
    return out


def told(df):
    return {r.row_id: (r.event, r.start, r.state, r.new_facts) for r in df.collect()}


INDEX = {"strike": ["f1", "f2"], "merger": [], "unseen": ["f1"]}


def test_batch_and_stream_say_the_same(spark, tmp_path):
    rows = articles()
    index = spark.createDataFrame(list(INDEX.items()), "event string, facts array<string>")
    items, warnings = edition_rows(spark.createDataFrame(rows, SCHEMA))
    want = plain(rows, INDEX)
    assert told(edition_items(items, index)) == want
    assert told(edition_items(items)) == plain(rows, {})
    assert {r.row_id for r in warnings.collect()} == {r[1] for r in rows if not r[3].strip() or not r[5]}
    states = Counter(s for _, _, s, _ in want.values())
    assert min(states[s] for s in ("new", "update", "unchanged", "skipped")) > 5

    ordered = sorted(rows, key=lambda r: r[2])
    for i in range(0, len(ordered), 60):
        spark.createDataFrame(ordered[i : i + 60], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{i:05d}"))
    last = [(None, 9999, T0 + timedelta(days=9), "T", "S", ["https://x.org/a"], []), ("end", 9998, T0 + timedelta(days=9), "T", "S", ["https://x.org/a"], [])]
    for k in (1, 2):  # moves the watermark past all windows
        spark.createDataFrame([(e, i + 10 * k, t, *r) for e, i, t, *r in last], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"9999{k}"))
    raw = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = edition_stream(edition_rows(raw)[0], index).writeStream.format("memory").queryName("editions").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(400)
    assert query.exception() is None
    got = {k: v for k, v in told(spark.table("editions")).items() if k < 9000}
    assert got == want


def test_no_rows(spark):
    items, warnings = edition_rows(spark.createDataFrame([], SCHEMA))
    assert edition_items(items).count() == warnings.count() == 0
