import random

import numpy as np
from pyspark.sql import functions as F

from aeroflow.llm import topk as K


def plain(rows, k=5):
    """All scores by Python integers."""
    vectors = {}
    for i, x in rows:
        if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x):
            vectors.setdefault(i, []).append([int(np.floor(256 * float(np.float32(c)))) for c in x])
    out = []
    for q in vectors:
        if q % 5 == 0:
            best = {}
            for v in vectors[q]:
                for i, ws in vectors.items():
                    for w in ws:
                        if i != q and len(w) == len(v):
                            s = sum(a * b for a, b in zip(v, w))
                            best[i] = max(best.get(i, s), s)
            top = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
            out += [(q, n + 1, i, s) for n, (i, s) in enumerate(top)]
    return sorted(out)


def clustered(rng, n, dim=6, clusters=5):
    centres = [[rng.gauss(0, 2) for _ in range(dim)] for _ in range(clusters)]
    return [[c + rng.gauss(0, 0.05) for c in rng.choice(centres)] for _ in range(n)]


def test_rows(spark, monkeypatch):
    monkeypatch.setattr(K, "DATA_ROWS", 40)
    monkeypatch.setattr(K, "QUERY_ROWS", 9)
    monkeypatch.setattr(K, "LEAF_ROWS", 4)
    rng = random.Random(3)
    rows = list(enumerate(clustered(rng, 250) + [[1.0] * 6] * 100 + [[rng.gauss(0, 1) for _ in range(6)] for _ in range(50)]))
    rows += [(2000 + i, [1e6 + i / 64, 1e6, -3.0, 1e5, 7.0 + i, 0.5]) for i in range(6)]
    rows += [(1000, None), (1005, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1010, [float("nan")] * 6), (1015, [1.0, 2.0]), (1016, [2.0, 1.0]), (1020, []), (None, [1.0] * 6), (5, rows[7][1]), (7, rows[7][1])]
    df = spark.createDataFrame([(i, x, "a", 1) for i, x in rows], "vec_id long, embedding array<float>, id string, cell int")
    got = K.top_k(df, F.col("vec_id") % 5 == 0)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect())) == plain(rows)


def test_empty_and_few(spark):
    schema = "vec_id long, embedding array<float>"
    assert K.top_k(spark.createDataFrame([], schema), F.col("vec_id") % 5 == 0).collect() == []
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], schema)
    assert [tuple(r) for r in K.top_k(few, F.col("vec_id") % 5 == 0).collect()] == [(0, 1, 1, 256 * 512)]


def search(q, x, leaf_rows):
    best = K.Best(len(q), 5)
    queries = K.Tree.over(q.astype(float), np.arange(len(q)), leaf_rows)
    scored = K.dual_search(queries, K.Tree.unpacked(K.Tree.over(x.astype(float), np.arange(len(x)), leaf_rows).packed()), best)
    for row, query in enumerate(queries.ids.tolist()):
        s = x @ q[query]
        order = [i for i in np.lexsort((np.arange(len(x)), -s)) if i != query][:5]
        assert best.ids[row].tolist() == order
    return scored


def test_pruning_skips_most_scores():
    """At the shipped leaf size: of clustered vectors few scores are computed, of others all at most."""
    rng = random.Random(1)
    x = np.floor(256 * np.array(clustered(rng, 4000, 8, 40))).astype(np.int64)
    assert search(x[:200], x, K.LEAF_ROWS) < 0.4 * 200 * 4000
    plain = np.floor(256 * np.array([[rng.gauss(0, 1) for _ in range(24)] for _ in range(1500)])).astype(np.int64)
    assert search(plain[:100], plain, K.LEAF_ROWS) <= 100 * 1500
    assert search(x[:40], x[:300], 3) < 40 * 300


def test_given_tables_have_trees_of_several_levels(spark):
    """At the shipped sizes every pair of nodes is judged by its bound, on the given tables too."""
    import pyarrow.parquet as pq

    x = np.floor(256 * np.array(pq.read_table("/root/testdata/sf0.01/embeddings.parquet")["embedding"].to_pylist()))
    tree = K.Tree.over(x, np.arange(len(x)))
    depth, level = 0, np.zeros(1, np.int64)
    while len(level := np.concatenate([np.arange(tree.child[n], tree.child[n] + tree.children[n]) for n in level])):
        depth += 1
    assert depth >= 2 and (tree.children > 0).sum() > 10
    df = spark.createDataFrame([(i, v) for i, v in enumerate((x / 256).tolist())], "vec_id long, embedding array<double>")
    assert 0 < K.share_scored(df, F.col("vec_id") % 50 == 0) <= 1


def test_tree_covers():
    rng = random.Random(2)
    x = np.array(clustered(rng, 500, 3, 20))

    def walk(node, x):
        assert K._distances(x[node.rows], node.centre).max() <= node.radius + 1e-9
        assert node.children or len(node.rows) <= 4 or node.radius == 0
        if node.children:
            assert sorted(np.concatenate([c.rows for c in node.children])) == sorted(node.rows)
            assert len(node.children) == K.FAN_OUT or all(c.radius <= node.radius / 2 + 1e-9 for c in node.children)
            for c in node.children:
                walk(c, x)

    plain = np.array([[rng.gauss(0, 1) for _ in range(40)] for _ in range(700)])
    for rows in (x, plain, np.array([[1.3**i] for i in range(900)] * 2)):  # the last has a deep tree
        walk(K.cover_tree(rows, 4), rows)


def test_ids_in_many_blocks_and_large_components(spark, monkeypatch):
    monkeypatch.setattr(K, "DATA_ROWS", 12)
    monkeypatch.setattr(K, "QUERY_ROWS", 5)
    monkeypatch.setattr(K, "LEAF_ROWS", 3)
    rng = random.Random(9)
    rows = [(i % 40, [rng.gauss(0, 1) * 10.0 ** rng.randrange(5) for _ in range(2)]) for i in range(160)]
    rows += [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0]), (200, [1e8, 0.0]), (201, [1e8, 3.0]), (202, [-1e8, 1e-3]), (205, [-1e9, 1e9])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, K.top_k(df, F.col("vec_id") % 5 == 0).collect()))
    want = [(q, n, i, max(K.LEAST, min(K.MOST, s))) for q, n, i, s in plain(rows)]
    assert [r for r in got if abs(r[3]) < K.MOST] == [r for r in want if abs(r[3]) < K.MOST]
    assert [(r[0], r[1], r[3]) for r in got] == [(r[0], r[1], r[3]) for r in want]
