"""Pairs of token sets met in blocks, against comparisons of all pairs."""

import random

import duckdb

from aeroflow.operators import grouping as P, sets


ACTIONS = ["ta", "tbb", "tccc"] + ["tdddd" + "d" * i for i in range(30)]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def drawn(seed, n):
    rng = random.Random(seed)
    base = [rng.sample(range(900), k) for k in (4, 7, 30, 200, 700)]
    word = lambda x: "t" + "abcdefghij"[x % 10] * (x // 10) if x % 9 else f"{x}"
    out = [sorted({word(x) for x in rng.choice(base) if rng.random() < 0.8} | {word(rng.randrange(1200)) for _ in range(rng.randrange(9))}) for _ in range(n)]
    return out + out[: n // 10]


def components(nodes, links):
    label = {x: x for x in nodes}
    for a, b in links * len(label):
        label[a] = label[b] = min(label[a], label[b])
    return label


def test_anchored_sets_meet_in_blocks(spark, monkeypatch):
    """No row for each pair or token is shuffled: the only exchange is that of equal sets."""
    monkeypatch.setattr(P, "PART", 50)
    monkeypatch.setattr(sets, "AT_ONCE", 700)
    monkeypatch.setattr(sets, "ROWS", 16)
    held = drawn(3, 160)
    items = spark.createDataFrame([(f"i{i:03}", s) for i, s in enumerate(held)], "id string, tokens array<string>")
    found = P.anchored_links(items, ACTIONS)
    assert "Join" not in plan(found) and "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    first = {}
    for i, s in enumerate(held):
        first.setdefault(tuple(s), f"i{i:03}")
    rows = [(i, set(s)) for s, i in first.items()]

    def alike(x, y):
        common, n = x & y, len(x & y)
        enough = n >= 4 and (n >= 0.55 * min(len(x), len(y)) or n >= 0.38 * len(x | y))
        return any(t.isdigit() for t in common) and n >= 3 and n >= 0.45 * min(len(x), len(y)) or bool(common & set(ACTIONS)) and enough

    want = {(i, j) for i, x in rows for j, y in rows if i < j and alike(x, y)}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    few = [tuple(r) for r in P.anchored_links(items, ACTIONS, forest=True).collect()]
    nodes = sorted(first.values())
    assert set(few) < want and components(nodes, few) == components(nodes, sorted(want))


def test_whole_texts_are_grouped(spark, tmp_path):
    """Texts that differ early and agree later are one group, and those that agree at their beginning only are not."""
    from aeroflow.plans.queries import ORACLE_SQL, QUERIES

    words = lambda c, n: " ".join(c * 5 + "abcdefghij"[i % 10] * (1 + i // 10) for i in range(n))
    texts = ["one\n" + words("v", 40) + " " + words("w", 200), "two\n" + words("x", 40) + " " + words("w", 200), "one\n" + words("v", 40) + " " + words("y", 200), ""]
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.group_id for r in QUERIES["token_groups"](spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == dict(db.execute(ORACLE_SQL["token_groups"]).fetchall()) == {0: 0, 1: 0, 2: 2, 3: 3}


def test_searches_keep_few_tokens_and_blocks_are_bound_by_tokens(spark, monkeypatch):
    """Documents keep the tokens that are asked for, and the best rows are those of plain counts in any blocks."""
    from aeroflow.operators import overlap

    kept = []
    rng = random.Random(5)
    docs = [(i, rng.choice("ab"), sorted({f"w{int(60 * rng.random() ** 2)}" for _ in range(rng.randrange(40))}) + [f"only{i}"] * 3) for i in range(200)]
    asked = [(i, rng.choice("ab"), sorted({f"w{int(60 * rng.random() ** 2)}" for _ in range(9)}), 1 + i % 3) for i in range(60)]
    frame = spark.createDataFrame([(*d, [1] * len(d[2])) for d in docs], "id long, source string, tokens array<string>, weights array<int>")
    queries = spark.createDataFrame(asked, "query_id int, source string, tokens array<string>, least int")
    piece = spark.createDataFrame([(1, "a", [5, 6, 7], [1, 2, 3]), (2, "b", [9], [1])], "id long, source string, tokens array<long>, weights array<int>")
    monkeypatch.setattr(overlap, "read_batches", lambda *_: iter([overlap.pa.RecordBatch.from_pydict({"tokens": [[7, 5], [4]]})]))
    for batch in overlap._asked_for([])(iter(piece.toArrow().to_batches())):
        kept += batch.to_pylist()
    assert kept == [{"id": 1, "source": "a", "tokens": [5, 7], "weights": [1, 3]}]
    monkeypatch.undo()
    for most, few in ((500, 10**6), (10**6, 0)):
        monkeypatch.setattr(overlap, "BLOCK_TOKENS", most)
        monkeypatch.setattr(overlap, "FEW_TOKENS", few)
        found = overlap.best_overlaps(queries, frame, 3, apart=True)
        want = set()
        for query, source, tokens, least in asked:
            scored = sorted((-len(set(tokens) & set(d[2])), d[0]) for d in docs if d[1] != source and d[0] != query)
            want |= {(query, i, -n, place) for place, (n, i) in enumerate([x for x in scored if -x[0] >= least][:3], 1)}
        assert {tuple(r) for r in found.select("query_id", "id", "score", "place").collect()} == want and len(want) > 100


def test_group_links_shuffle_no_tokens(spark, monkeypatch):
    """Links of groups come without an exchange, and a task's are a forest that keeps the components."""
    held = drawn(6, 120)
    items = spark.createDataFrame([(i, s) for i, s in enumerate(held)], "id long, tokens array<string>")
    found = P.same_event_links(items)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    label = components(range(len(held)), [tuple(r) for r in found.collect()])
    first = {}
    for i, s in enumerate(held):
        first.setdefault(tuple(s), i)
    want = {i: label[first[tuple(s)]] if len(s) >= 4 else i for i, s in enumerate(held)}
    assert {r.id: r.group_id for r in P.token_groups(items).collect()} == want and len(set(want.values())) < 100
