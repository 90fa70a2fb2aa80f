"""Joins that must lose no pair, against brute force."""

import difflib
import random

from pyspark.sql import functions as F

from aeroflow.functions.text import haversine_km
from aeroflow.operators.articles import evidence_budget
from aeroflow.operators.briefings import rate_limited
from aeroflow.operators.gates import verified_quotes
from aeroflow.operators.grouping import anchored_links, pending_groups, similar_titles, token_groups
from aeroflow.operators.history import within_radius


def test_similar_titles_are_all_found(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefg hij") for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    titles = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base):
        changed = list(t)
        for _ in range(rng.randrange(1, 6)):
            changed[rng.randrange(len(changed))] = rng.choice("xyz")
        titles.append((100 + i, "".join(changed)))
    df = spark.createDataFrame(titles, "id long, title string")
    got = {(r.src, r.dst) for r in similar_titles(df.where("id < 40"), df).collect()}
    want = {(i, j) for i, a in titles if i < 40 for j, b in titles if i != j and difflib.SequenceMatcher(None, a, b).ratio() >= 0.75}
    assert got == want and len(want) > 20


def test_quotes_of_any_length_are_found(spark):
    rng = random.Random(5)
    texts = [(i, " ".join(rng.choice(["alpha", "be", "gamma", "delta", "eps", "zeta", "unquestionably"]) + rng.choice(["", "", ",", "s"]) for _ in range(rng.randrange(0, 60)))) for i in range(60)]
    quotes = []
    for k in range(150):
        text = texts[rng.randrange(60)][1]
        start = rng.randrange(max(1, len(text)))
        quotes.append((k, text[start : start + rng.randrange(1, 90)].strip()))
    quotes += [(200, "questionab"), (201, "seven words of quote are not here"), (202, None)]
    got = {(r.q, r.t) for r in verified_quotes(spark.createDataFrame(quotes, "q int, quote string"), spark.createDataFrame(texts, "t int, text string"), "quote", "text", "t").collect()}
    assert got == {(q, t) for q, x in quotes if x and len(x) >= 8 for t, text in texts if x in text}
    assert len(got) > 100


def test_places_in_reach(spark):
    rng = random.Random(7)
    points = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(300)] + [(900, 89.9, 10.0), (901, 0.0, 179.95), (902, -89.99, -170.0)]
    places = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180), rng.choice([50.0, 800.0, 3000.0])) for i in range(40)] + [(90, 89.5, -170.0, 200.0), (91, 0.1, -179.9, 50.0), (92, -89.0, 0.0, 300.0)]
    distance = haversine_km(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"))
    p, q = spark.createDataFrame(points, "p int, lat double, lon double"), spark.createDataFrame(places, "q int, plat double, plon double, radius_km double")
    got = {(r.p, r.q) for r in within_radius(p, q, ("lat", "plat"), ("lon", "plon"), distance).collect()}
    want = {(r.p, r.q) for r in p.crossJoin(q).where(distance <= F.col("radius_km")).collect()}
    assert got == want and {(900, 90), (901, 91), (902, 92)} <= got


def test_anchored_links_are_all_found(spark):
    rng = random.Random(9)
    words = [f"w{chr(97 + i)}" for i in range(26)] + ["order", "a320", "b7", "crash"]
    items = sorted({(tuple(sorted(rng.sample(words, rng.randrange(2, 12))))) for _ in range(150)})
    got = {(r.src, r.dst) for r in anchored_links(spark.createDataFrame([(i, list(t)) for i, t in enumerate(items)], "id int, tokens array<string>"), ["order", "crash"]).collect()}
    want = set()
    for i, x in enumerate(items):
        for j in range(i):
            c = set(x) & set(items[j])
            m, union = min(len(x), len(items[j])), len(set(x) | set(items[j]))
            anchored = any(ch.isdigit() for t in c for ch in t) and len(c) >= 3 and len(c) >= 0.45 * m
            acted = c & {"order", "crash"} and len(c) >= 4 and (len(c) >= 0.55 * m or len(c) >= 0.38 * union)
            if min(len(x), len(items[j])) >= 3 and (anchored or acted):
                want.add((j, i))
    assert got == want and len(want) > 50


def test_pending_groups(spark):
    story = [f"token{i}" for i in range(8)]
    rows = [
        (1, "a", 5, "Story", "long enough summary of it", False, story),
        (2, "b", 3, "Story again", "short", True, [*story[:7], "other"]),
        (3, "c", 1, "Known", "all seen before, quite long too", True, ["known", "before"]),
        *[(10 + i, "n", i, f"Notice {i}", "", False, [f"notice{i}"]) for i in range(8)],
        (30, "z", 2, "Alone", "", False, ["alone"]),
    ]
    items = spark.createDataFrame(rows, "id long, source string, age long, title string, summary string, echoes boolean, tokens array<string>").withColumn("is_new", ~F.col("echoes"))
    got = pending_groups(items, token_groups(items), F.col("title").startswith("Notice")).orderBy("rank").collect()
    assert [(r.group_id, r.roundup, r.is_update, r.n_members, r.lead_id) for r in got] == [(1, False, True, 2, 1), (10, True, False, 6, 10), (16, True, False, 2, 16), (30, False, False, 1, 30)]


def test_budget_and_limits_pass_in_order(spark):
    rng = random.Random(11)
    facts = [(rng.choice("ab"), rng.randrange(5), rng.randrange(3), i, "x" * rng.randrange(0, 40)) for i in range(400)]
    got = {(r.grp, r.number) for r in evidence_budget(spark.createDataFrame(facts, "g string, e int, r int, n int, t string"), "g", "e", "r", "n", "t", chars=150).collect()}
    want = set()
    for g in "ab":
        left, room, taken = 150, 12, 0
        for key in sorted({(f[2], f[1]) for f in facts if f[0] == g}):
            fits = 0
            for f in sorted(x for x in facts if x[0] == g and (x[2], x[1]) == key and taken < 3):
                if len(f[4]) > left or not room:
                    break
                left, room, fits = left - len(f[4]), room - 1, 1
                want.add((g, f[3]))
            taken += fits
    assert got == want and got
    asked = spark.createDataFrame([("u", i, s, q) for i, (s, q) in enumerate([(0, "a"), (10, "a"), (20, "b"), (30, "c"), (31, "d"), (100, "a")])], "u string, i int, s int, q string").withColumn("ts", F.timestamp_seconds("s"))
    told = {r.request: r.decision for r in rate_limited(asked, "u", "ts", "i", per_minute=2, question="q").collect()}
    assert told == {0: "allowed", 1: "cooldown", 2: "allowed", 3: "minute", 4: "minute", 5: "allowed"}


def plain_limits(rows, per_minute, per_day, cooldown, budget, outside):
    """Requests (user, id, seconds, question, cost, wants) one by one, all users together."""
    state, spent, out = {}, {}, {}
    for user, i, t, q, cost, wants in sorted(rows, key=lambda r: (r[2], r[1])):
        day = t // 86400
        s = state.get(user)
        if s is None or s["day"] != day:
            s = state[user] = {"day": day, "recent": [], "last": {}, "answers": 0, "outside": 0}
        over = spent.get(day, 0) >= budget
        if len([x for x in s["recent"] if x >= t - 60]) >= per_minute:
            told = "minute"
        elif q in s["last"] and t - s["last"][q] < cooldown:
            told = "cooldown"
        elif s["answers"] >= per_day:
            told = "day"
        else:
            told = "over_budget" if over else "allowed"
            s["recent"].append(t)
            s["last"][q] = t
            if not over:
                s["answers"] += 1
                spent[day] = spent.get(day, 0) + cost
        may = told in ("allowed", "over_budget") and s["outside"] < outside
        s["outside"] += wants and may
        out[i] = (told, may if wants else None)
    return out


def test_one_budget_for_all_users(spark):
    rng = random.Random(21)
    rows = [(rng.choice("aaaaabcd"), i, 86400 * rng.randrange(4) + rng.randrange(3000) // 5 * 5, rng.choice("xyz"), float(rng.randrange(4)), rng.random() < 0.5) for i in range(900)]
    df = spark.createDataFrame(rows, "u string, i int, s int, q string, c double, w boolean").withColumn("ts", F.timestamp_seconds("s"))
    for budget, per_day in ((60.0, 30), (1e9, 12), (0.5, 5)):
        got = {r.request: (r.decision, r.external) for r in rate_limited(df, "u", "ts", "i", per_minute=4, per_day=per_day, cooldown_s=30, question="q", cost="c", budget=budget, external="w", external_per_day=3).collect()}
        assert got == plain_limits(rows, 4, per_day, 30, budget, 3)
        assert {"minute", "cooldown", "allowed"} <= {d for d, _ in got.values()}
    edge = spark.createDataFrame([(i, "u", s) for i, s in enumerate([0, 60, 121])], "i int, u string, s int").withColumn("ts", F.timestamp_seconds("s"))
    assert [r.decision for r in rate_limited(edge, "u", "ts", "i", per_minute=1).orderBy("request").collect()] == ["allowed", "minute", "allowed"]


def test_running_totals_over_parts(spark):
    from aeroflow.operators.gates import chunked, context_budget
    from aeroflow.operators.scan import before, deal

    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 1, 2, 3]), "x" * rng.randrange(0, 30)) for i in range(500)] + [(900, "a", 1, None)]
    df = spark.createDataFrame(rows, "i int, g string, o int, t string")
    order = [F.col("o").asc_nulls_first(), F.col("i")]
    ordered = {g: sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is not None, r[2] or 0, r[0])) for g in ("a", "b", None)}
    got = {r.i: (r.n, r.x) for r in before(deal(df.where("g is not null"), ["g"], order, "t"), ["g"], order, {"n": (F.sum, F.lit(1)), "x": (F.bit_xor, F.col("i").cast("long"))}).collect()}
    for g in ("a", "b"):
        x = 0
        for n, r in enumerate(ordered[g]):
            assert got[r[0]] == (n, x)
            x ^= r[0]
    got = {r.i: (r.place, r.chunk, r.chunk_rows) for r in chunked(df, ["g"], order, 6).collect()}
    assert got == {r[0]: (n + 1, n // 6, min(6, len(ordered[g]) - n // 6 * 6)) for g in ordered for n, r in enumerate(ordered[g])}
    got = {r.i: r.part for r in context_budget(df, ["g"], order, "t", 20, 200, "i").collect()}
    want = {}
    for g in ordered:
        left = 200
        for r in ordered[g]:
            if left > 0:
                want[r[0]] = (r[3] or "")[:20][:left]
                left -= len((r[3] or "")[:20])
    assert got == want
