import random
import re
from collections import defaultdict

import pytest

from aeroflow.llm.mixing import mix_sources, mixed_documents


def water_fill(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    """Reshare the excess again and again, as the contract words it."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, fixed, left = {}, set(), share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        total = sum(weight[s] for s in free)
        target |= {s: left * weight[s] / total for s in free}
        over = [s for s in free if target[s] > cap * sizes[s] + 1e-9]
        if not over:
            return target
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
            fixed.add(s)


def rows(seed=1, n=3000):
    rng = random.Random(seed)
    sources = ["b", "a", None, "ä", "Z", "src10", "src9"]
    weights = [60, 1, 3, 9, 5, 0.5, 20]
    out = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 30, 80])) + rng.choice(["", " ", " ***"]), rng.choices(sources, weights)[0], "x") for i in range(n)]
    return out + [(None, "a b c", "b", "x"), (7, None, None, "x"), (7, "twice", "b", "x"), (7, "twice", "b", "x")]


def test_targets_and_budgets(spark):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, size string")
    got = mix_sources(docs).collect()
    assert len(got) == len(data)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, s, _ in data:
        sizes[s] += size(t)
    want = water_fill(sizes)
    assert sorted(r["size"] for r in got) == sorted(size(t) for _, t, _, _ in data)
    taken = defaultdict(int)
    for r in got:
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[round(r.target, 6), r.source_size] += r.taken
    assert {k[0] for k in taken} == {round(x, 6) for x in want.values()}
    for (target, _), words in taken.items():
        assert abs(words - target) <= 41
    for s in sizes:  # complete epochs come first
        own = [r for r in got if r.source_size == sizes[s] and r.target == pytest.approx(want[s])]
        assert {r.epochs for r in own} <= {int(want[s] // sizes[s]), int(want[s] // sizes[s]) + 1}
    again = mix_sources(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_clean_documents_are_preferred(spark):
    docs = spark.createDataFrame([(i, "w w w w ****" if i % 2 else "w w w w wwww", "ab"[i % 4 // 2 and 1], 0) for i in range(4000)], "doc_id long, text string, source string, n int")
    got = mix_sources(docs, weights=(1, 1), share=0.5).collect()
    clean = sum(r.epochs for r in got if r.doc_id % 2 == 0)
    assert clean > sum(r.epochs for r in got if r.doc_id % 2)


def test_documents_of_the_mix(spark):
    docs = spark.createDataFrame(rows(2, 500), "doc_id long, text string, source string, _c string")
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    epochs = {r.doc_id: r.epochs for r in mix_sources(docs).collect() if r.doc_id not in (7, None)}
    got = defaultdict(int)
    for r in mixed.collect():
        got[r.doc_id] += 1
    assert {k: v for k, v in epochs.items() if v} == {k: v for k, v in got.items() if k not in (7, None)}


def test_repeated_rows_are_taken_as_planned(spark):
    rng = random.Random(4)
    data = [(7, "w " * 5, "a", "x")] * 40 + [(7, "w " * 5, "a", "y")] * 3 + [(i, "w " * rng.randrange(1, 9), rng.choice("ab"), "x") for i in range(20, 60)] + [(8, "one two", "b", "x")] * 25
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, s string")
    planned, got = defaultdict(int), defaultdict(int)
    for r in mix_sources(docs).collect():
        planned[r.doc_id] += r.epochs
    for r in mixed_documents(docs).collect():
        got[r.doc_id] += 1
    assert got == {k: v for k, v in planned.items() if v}
    assert 40 < got[7] < 86 or 25 < got[8] < 50  # one of them is cut


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix_sources(docs).count() == 0
    assert mixed_documents(docs).count() == 0
    only_empty = spark.createDataFrame([(1, "", "a"), (2, None, "a")], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mix_sources(only_empty).collect()] == [(0.0, 0), (0.0, 0)]


def test_a_source_of_symbols_fills_no_bucket(spark, monkeypatch):
    import aeroflow.llm.mixing as M

    monkeypatch.setattr(M, "PER_BUCKET", 50)
    data = [(i, "word ** $$ ## && || <> ** ## " * 2, "only") for i in range(4000)] + [(None, f"text {i}", "only") for i in range(400)]
    drawn = M._drawn(spark.createDataFrame(data, "id long, text string, source string"), 42).toPandas()
    import numpy as np

    bucket = np.floor(np.log2(drawn.key) * np.ceil(len(drawn) / 50))
    assert bucket.value_counts().max() < 50


def test_documents_with_clashing_columns(spark):
    data = [(i, "a b c d", "x" if i % 3 else None, i, "k") for i in range(200)] + [(7, None, "x", 1, "k"), (None, "a b", "x", 2, "k")] * 2
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, _mix_id int, _mix_copy string")
    taken = {}
    for r in mix_sources(docs).collect():
        taken[r.doc_id, r.text_hash] = max(r.epochs, taken.get((r.doc_id, r.text_hash), 0))
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    rows = {(r.doc_id, r.h): r.n for r in out.selectExpr("doc_id", "xxhash64(coalesce(text, '')) h").groupBy("doc_id", "h").agg({"*": "count"}).toDF("doc_id", "h", "n").collect()}
    copies = {(None, h): 2 for (i, h) in taken if i is None}
    expected = {k: n * (2 if k[0] is None or (k[0] == 7 and k != first_seven(taken)) else 1) for k, n in taken.items() if n}
    assert rows == expected and copies


def first_seven(taken):
    """The key of the only row with id 7 that is not repeated: its text is not null."""
    from collections import Counter

    return max((k for k in taken if k[0] == 7), key=lambda k: Counter(x[1] for x in taken)[k[1]])
