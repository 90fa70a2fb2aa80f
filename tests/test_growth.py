"""Joins whose rows must not grow with the square of a key's rows, against plain readings of the rules."""

import random

import pytest
from pyspark.sql import functions as F

from aeroflow.functions.text import haversine_km
from aeroflow.operators import grouping as P
from aeroflow.operators import history, overlap
from aeroflow.operators.desk import archive_ranking
from aeroflow.operators.publish import registry_match
from aeroflow.operators.site import best_match


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_links_meet_without_broadcast(spark, monkeypatch):
    """Exploded sets are larger than their file says; a frequent token meets in parts, and no link is lost."""
    monkeypatch.setattr(P, "PART", 5)
    rng = random.Random(4)
    base = [rng.sample(range(300), n) for n in (5, 9, 30, 120)]
    sets = [sorted({f"t{x}" for x in rng.choice(base) if rng.random() < 0.8} | {f"t{rng.randrange(400)}" for _ in range(rng.randrange(6))}) for _ in range(150)]
    items = spark.createDataFrame(list(enumerate(sets)), "id int, tokens array<string>")
    got = P.same_event_links(items)
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().sparkPlan().toString()
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(tuple(s), i)
    held = [(i, set(s)) for s, i in first.items() if len(s) >= 4]
    alike = lambda a, b, c: c >= 4 and (c >= 0.55 * min(a, b) or c >= 0.38 * (a + b - c))
    want = {(i, j) for i, x in held for j, y in held if i < j and alike(len(x), len(y), len(x & y))}
    assert want and {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize("newest", [False, True])
def test_overlaps_in_blocks(spark, monkeypatch, newest):
    monkeypatch.setattr(overlap, "BLOCK", 40)
    rng = random.Random(7)
    word = lambda: f"w{int(30 * rng.random() ** 2)}"
    docs = [(i, rng.choice(["a", "b", None]), [word() for _ in range(rng.randrange(6))]) for i in range(150)]
    docs = [(*d, [rng.randrange(1, 5) for _ in d[2]]) for d in docs]
    asked = [(i, rng.choice(["a", "b", None]), list({word() for _ in range(5)}), rng.randrange(1, 7)) for i in range(90)]
    got = overlap.best_overlaps(spark.createDataFrame(asked, "query_id int, source string, tokens array<string>, least int"), spark.createDataFrame(docs, "id long, source string, tokens array<string>, weights array<int>"), 3, newest, apart=not newest)
    want = set()
    for query, source, tokens, least in asked:
        scored = [(sum(w for t, w in zip(d[2], d[3]) if t in tokens), d[0]) for d in docs if newest or source and d[1] and d[1] != source and d[0] != query]
        best = sorted((x for x in scored if x[0] >= least), key=lambda x: (-x[0], -x[1] if newest else x[1]))[:3]
        want |= {(query, i, score, place) for place, (score, i) in enumerate(best, 1)}
    assert {tuple(r) for r in got.select("query_id", "id", "score", "place").collect()} == want


def test_companions_and_searches_count_in_place(spark):
    """No row for each pair: the only joins left are those of phrases."""
    items = spark.createDataFrame([(1, "a", ["x", "y"]), (2, "b", ["x", "y", "z"]), (3, "b", ["z"])], "id long, source string, tokens array<string>")
    found = P.companions(items.withColumnRenamed("id", "seed_id"), items)
    assert "Join" not in plan(found) and {(r.seed_id, r.id, r.shared) for r in found.collect()} == {(1, 2, 2)}
    searched = P.lexical_search(spark.createDataFrame([(9, ["z", "x"])], "query_id int, tokens array<string>"), items.select("id", F.col("tokens").alias("title_tokens")), spark.createDataFrame([(9, 3), (8, 1)], "query_id int, id long"))
    assert "Join" not in plan(searched)
    assert {(r.query_id, r.id, r.score, r.place) for r in searched.collect()} == {(9, 3, 10, 1), (9, 2, 8, 2), (9, 1, 4, 3), (8, 1, 6, 1)}


def test_keys_meet_by_their_first_record(spark):
    rows = spark.createDataFrame([(i, f"u{i % 3}", "t") for i in range(40)], "a int, u string, t string")
    records = spark.createDataFrame([(100 + i, f"u{i % 2}", "t") for i in range(40)], "b int, u string, t string")
    found = best_match(rows, records, "a", "b", "u", "t")
    assert plan(found).count("Aggregate") >= 3
    assert {tuple(r) for r in found.collect()} == {(i, 100 + i % 3 if i % 3 < 2 else 100, 0 if i % 3 < 2 else 1) for i in range(40)}
    asked = spark.createDataFrame([(i, i * 3, ["x", "y"]) for i in range(20)], "row int, event int, urls array<string>")
    registry = spark.createDataFrame([(i, ["y" if i > 5 else "z"]) for i in range(2, 20)], "event int, urls array<string>")
    got = registry_match(asked, registry)
    assert plan(got).count("Aggregate") >= 2
    assert {tuple(r) for r in got.collect()} == {(i, i * 3, 0) if 2 <= i * 3 < 20 else (i, 6, 1) for i in range(20)}


def test_archives_are_ranked_in_place(spark, monkeypatch):
    """No row for each pair of rows that share a key, and the same ranks as by all pairs."""
    monkeypatch.setattr(overlap, "BLOCK", 15)
    rng = random.Random(12)
    rows = [(rng.choice([None, *range(60)]), rng.randrange(25), rng.choice(["error", "purchase", "view", "click", None])) for _ in range(400)]
    found = archive_ranking(spark.createDataFrame(rows, "u long, k long, e string"), "u", "k", "e", ["error", "purchase"], 3)
    assert "Join" not in plan(found)
    own = {}
    for u, k, e in rows:
        if u is not None and e is not None:
            own.setdefault(u, set()).add((k, e))
    want = set()
    for u, mine in own.items():
        met = [(min({"error": 1, "purchase": 2}.get(e, 3) for _, e in mine & theirs), -len(mine & theirs), -v) for v, theirs in own.items() if v < u and mine & theirs]
        want |= {(u, -v, tier, -n, place) for place, (tier, n, v) in enumerate(sorted(met)[:3], 1)}
    assert {tuple(r) for r in found.select("current", "archive", "tier", "shared", "place").collect()} == want


def test_points_of_one_position_meet_in_parts(spark, monkeypatch):
    """A crowded position is dealt to several tasks, and no pair is lost or doubled."""
    monkeypatch.setattr(history, "PART", 4)
    monkeypatch.setattr(history, "TASK_PAIRS", 30)
    rng = random.Random(13)
    points = [(i, *rng.choice([(50.0, 8.0), (50.5, 8.5), (-10.0, 179.9), (None, 1.0)])) for i in range(40)]
    places = [(i, *rng.choice([(50.1, 8.1), (-10.0, -179.9)]), rng.choice([40.0, 100.0])) for i in range(12)]
    p, q = spark.createDataFrame(points, "p int, lat double, lon double"), spark.createDataFrame(places, "q int, plat double, plon double, radius_km double")
    distance = haversine_km(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"))
    found = history.copies_within_radius(p, q, ("lat", "plat"), ("lon", "plon"), distance)
    got = sorted((r.p, r.q, round(r.distance_km, 6)) for r in found.collect())
    assert got == sorted((r.p, r.q, round(r.km, 6)) for r in p.crossJoin(q).withColumn("km", distance).where("km <= radius_km").collect()) and len(got) > 30
    assert f"{len(got) // 30 + 1}), REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()


def test_a_sentence_cut_reads_its_sentences_once(spark):
    """One search for sentences in the plan, and only the first words are put in single spaces."""
    from aeroflow.operators.site import HARD, sentence_cut

    words = ["aé", "b.", "c,", "d!)"]
    texts = ["   " + " \t\n".join(words[(i * k) % 4] for i in range(n)) + "　" for n in (1, 40, HARD, HARD + 1, HARD + 2, 900) for k in (1, 3, 4)] + ["", " ", "x" * 600, " " + "y \n" * 600]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = df.select(sentence_cut(F.col("t")).alias("long"), sentence_cut(F.trim(F.substring(F.regexp_replace("t", r"(?U)\s+", " "), 1, 600))).alias("short"))
    assert plan(df.select(sentence_cut(F.col("t")).alias("s"))).count("regexp_extract_all") == 1
    assert all(r.long == r.short for r in out.collect())


def test_phrases_of_a_group_meet_by_keys(spark, monkeypatch):
    """No automaton holds the phrases, however many they are; phrases of any length are found, in their group only."""
    from aeroflow.operators import dictionary

    monkeypatch.setattr(dictionary, "_finder", None)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abé𝄞 ") for _ in range(rng.randrange(2, 7)))
    texts = [(rng.choice(["x", "y", None]), " ".join(word() for _ in range(rng.randrange(60)))) for _ in range(60)] + [("x", None), ("x", "a" * 90), ("y", "")]
    phrases = [("x", "a" * n) for n in (8, 64, 90, 91)]
    for group, text in texts * 6:
        n = rng.choice([8, 9, 15, 16, 17, 31, 32, 40, 41, 63, 64, 65, 130])
        at = rng.randrange(len(text or "") + 1)
        if len(piece := (text or "")[at : at + n]) >= 8:
            phrases.append((rng.choice([group, "x", "y"]), piece if rng.random() < 0.7 else piece[:-1] + "z"))
    found = dictionary.grouped_phrases(spark.createDataFrame(texts, "g string, text string"), spark.createDataFrame(phrases, "g string, p string"), "g", "text", "p")
    want = {(g, p) for g, p in phrases if g and any(h == g and p in (t or "") for h, t in texts)}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and 50 < len(want) < len(set(phrases))


def test_index_lists_are_dealt_once(spark):
    from aeroflow.sources import lexical_index as L

    docs = spark.createDataFrame([(1, ["a", "b"], ["b"]), (2, None, ["b"])], "id long, title_tokens array<string>, text_tokens array<string>")
    lists = L._lists(L.index_records(docs))
    assert {(r.token, r.id, r.weight) for r in lists.collect()} == {("a", 1, 4), ("b", 1, 5), ("b", 2, 1)}
    assert lists._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1
    assert "hashpartitioning(bucket" in lists._jdf.queryExecution().executedPlan().toString()
