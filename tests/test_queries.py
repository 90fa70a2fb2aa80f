"""Every query of the registry against its SQL on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

from aeroflow.plans.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else f"{value:.9g}"
    return str(value)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, db, name):
    got = QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    cursor = db.execute(ORACLE_SQL[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    want = Counter(tuple(plain(row[names.index(c)]) for c in columns) for row in cursor.fetchall())
    assert Counter(tuple(plain(row[c]) for c in columns) for row in got.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() >= 0


def test_every_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)
