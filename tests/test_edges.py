"""Queries against their SQL on rows at the edges of their rules: times within a second of an edge, letters beyond ASCII."""

import shutil
from collections import Counter
from datetime import datetime, timedelta

import duckdb
import pytest

from aeroflow.plans.queries import ORACLE_SQL, QUERIES
from test_queries import plain

EDGES = ["2024-01-03 07:00:00", "2024-01-05 23:00:00", "2024-01-15 12:00:00", "2024-01-18 12:00:00", "2024-01-20 06:59:59", "2024-01-20 14:00:00", "2024-01-20 18:00:00", "2024-01-28 23:00:00", "2024-01-29 00:00:00"]
TIMED = ["briefing_windows", "edition_items", "edition_status", "event_updates", "freshness_reasons", "headline_feed", "live_events"]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """Events at less than a second from edges of windows and ages, and texts whose words end before letters beyond ASCII."""
    folder = tmp_path_factory.mktemp("edges")
    steps = [timedelta(microseconds=x) for x in (-1_000_000, -999_999, -600_000, -400_000, -1, 0, 1, 400_000, 600_000, 999_999)]
    times = [datetime.fromisoformat(e) + s for e in EDGES for s in steps]
    rows = [(i, t, i % 7 if i % 3 and i < 80 else 1000 + i, ["view", "click", "error", "signup"][i % 4], float(i % 50), "{}") for i, t in enumerate(times)]
    texts = ["x\ndieüß la an", "x\nthe an", "dieé\nder.", "x\nunderä die", "a\nand_ deŕ", "the² x\nlan", "die1\nand-", None]
    db = duckdb.connect()
    db.execute("CREATE TABLE e (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    db.executemany("INSERT INTO e VALUES (?, ?, ?, ?, ?, ?)", rows)
    db.execute("CREATE TABLE d (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    db.executemany("INSERT INTO d VALUES (?, ?, 'x', 's', 0)", list(enumerate(texts)))
    for table, name in (("e", "events"), ("d", "documents")):
        db.execute(f"COPY {table} TO '{folder}/{name}.parquet'")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM {table}")
    yield str(folder), db
    shutil.rmtree(folder, ignore_errors=True)


@pytest.mark.parametrize("name", [*TIMED, "subject_categories"])
def test_same_as_sql_at_edges(spark, tables, name):
    folder, db = tables
    got = QUERIES[name](spark, folder)
    columns = sorted(got.columns)
    cursor = db.execute(ORACLE_SQL[name])
    names = [x[0] for x in cursor.description]
    want = Counter(tuple(plain(row[names.index(c)]) for c in columns) for row in cursor.fetchall())
    assert want and Counter(tuple(plain(row[c]) for c in columns) for row in got.collect()) == want


def test_ages_are_exact(spark, tables):
    folder, _ = tables
    fresh = {r.reason: r.n for r in QUERIES["freshness_reasons"](spark, folder).groupBy("reason").sum("n").toDF("reason", "n").collect()}
    assert fresh == {"old": 25, "fresh": 41, "future": 24}
    labels = {r.category: r.n for r in QUERIES["subject_categories"](spark, folder).groupBy("category").sum("n").toDF("category", "n").collect()}
    assert labels == {"a": 2, "b": 3, "ops": 3}
