"""Story groups by titles, tokens and anchors, against comparisons of all pairs."""

import datetime
import difflib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from aeroflow.functions import text as T
from aeroflow.operators import grouping as P, titles
from aeroflow.operators.titles import longest_common_subsequences, similar_titles


def plain_tokens(title, summary):
    found = re.findall("[A-Za-z0-9][A-Za-z0-9+'-]*|[㐀-鿿]{2,}", f"{title} {(summary or '')[:280]}")
    found = {t.lower() for t in found}
    return {t for t in found if t not in P.STOP_WORDS and not re.fullmatch(r"(19|20)\d\d|\d{1,2}(st|nd|rd|th)", t) and (len(t) >= 3 or re.search("[0-9]", t))}


def one_event(a, b):
    """Whether two items (title key, tokens) in this order tell one event."""
    ratio = difflib.SequenceMatcher(None, a[0], b[0]).ratio()
    if ratio >= 0.75:
        return True
    common = a[1] & b[1]
    if len(common) < 3:
        return False
    cover, jaccard = len(common) / min(len(a[1]), len(b[1])), len(common) / len(a[1] | b[1])
    ident, act = any(re.search("[0-9]", t) for t in common), bool(common & set(P.ACTIONS))
    return ratio >= 0.6 and (ident or act) or ident and cover >= 0.45 or act and len(common) >= 4 and (cover >= 0.55 or jaccard >= 0.38)


def plain_groups(items):
    """items: (id, title key, tokens, url) in the order of ids."""
    parent = {i[0]: i[0] for i in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(items):
        for b in items[n + 1 :]:
            if find(a[0]) != find(b[0]) and (a[3] and a[3] == b[3] or a[1] and b[1] and one_event(a[1:3], b[1:3])):
                x, y = find(a[0]), find(b[0])
                parent[max(x, y)] = min(x, y)
    return {i[0]: find(i[0]) for i in items}


def headlines(seed, n):
    rng = random.Random(seed)
    words = "airline orders twelve aircraft a350 b787 delivery delayed after inspection in spring city airport opens route flight council bridge river crash investigation 900 engine maker results fall short trouble over wing panel checks".split()
    out = []
    for i in range(n):
        if out and rng.random() < 0.5:
            title = (rng.choice(out)[1] or "empty once").split()
            for _ in range(rng.randrange(0, 4)):
                title[rng.randrange(len(title))] = rng.choice(words)
            title = " ".join(title)
        else:
            title = " ".join(rng.sample(words, rng.randrange(1, 9)))
        out.append((i, rng.choice([title] * 8 + [""]), " ".join(rng.sample(words, rng.randrange(0, 12))), rng.choice([None, "", f"u{rng.randrange(3 * n)}"])))
    return out


def test_groups_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(titles, "TILE", 20)
    rows = headlines(4, 220)
    df = spark.createDataFrame(rows, "id long, title string, summary string, url string")
    items = df.select("id", "title", P.event_tokens(F.col("title"), F.col("summary")).alias("tokens"), "url")
    tokens = {r.id: set(r.tokens) for r in items.collect()}
    assert tokens == {i: plain_tokens(t, s) for i, t, s, _ in rows}
    got = {r.id: r.group_id for r in P.event_groups(items).collect()}
    want = plain_groups([(i, t, tokens[i], u) for i, t, s, u in rows])
    assert got == want and 5 < len(set(want.values())) < 200


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_groups_of_the_documents(spark, folder):
    from aeroflow.plans.queries import QUERIES

    docs = duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet' ORDER BY doc_id").fetchall()
    parts = [(i, *t.partition("\n")[::2]) for i, t in docs]
    keys = {r.id: r.key for r in spark.createDataFrame([(i, a) for i, a, _ in parts], "id long, t string").select("id", T.title_key(F.col("t")).alias("key")).collect()}
    want = plain_groups([(i, keys[i], plain_tokens(a, b), None) for i, a, b in parts])
    assert {r.doc_id: r.group_id for r in QUERIES["event_groups"](spark, folder).collect()} == want


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before, row = row, [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(row[j], before[j + 1]))
    return row[-1]


def test_bounds_hold():
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abc dé\U0001f600") for _ in range(rng.randrange(1, n)))
    for _ in range(60):
        many, b = [word(80) for _ in range(rng.randrange(1, 9))], word(90)
        assert longest_common_subsequences(many, b) == [plain_lcs(a, b) for a in many]
    for _ in range(300):
        a, b = word(300), word(300)
        b = rng.choice([b, a[: len(a) // 2] + b[: len(b) // 3]])
        ratio = difflib.SequenceMatcher(None, a, b).ratio()
        tile = titles.Tile([{"title": a}])
        assert tile.reach([0], b)[0] >= ratio
        if ratio >= 0.5:
            assert tile.near(b, ratio)[0].tolist() == [0]


def test_equal_lengths_fill_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(titles, "TILE", 8)
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("abcdef") for _ in range(30))) for i in range(60)]
    rows += [(100 + i, t[:25] + "zzzzz") for i, t in rows[:30]] + [(300, ""), (301, None), (302, rows[0][1])]
    df = spark.createDataFrame(rows, "id long, title string")
    got = {(r.src, r.dst): r.ratio for r in similar_titles(df, df).collect()}
    want = {(i, j): r for i, a in rows for j, b in rows if i != j and a and b and (r := difflib.SequenceMatcher(None, a, b).ratio()) >= 0.75}
    assert got == pytest.approx(want) and len(want) > 50
    assert similar_titles(df.limit(0), df).count() == similar_titles(df, df.limit(0)).count() == 0


def test_from_items_to_pending_groups(spark):
    """15 items: one untitled, one too old, one of a seen URL; the rest are 6 groups in rank order."""
    now = datetime.datetime(2026, 7, 1, 12)
    hours = lambda h: now - datetime.timedelta(hours=h)
    long = "A summary that says a good deal more than the title does, with facts."
    rows = [
        (1, "reuters", "Storm closes Denver airport runway for repairs", "https://r/1", 3, long + " Really."),
        (2, "faa", "Storm closes Denver airport runway, long repairs", "https://f/1", 4, long),
        (3, "easa", "Regulator proposes rules on cabin crew training", "https://e/1", 5, long),
        (4, "boeing", "Boeing delivers 100th 787 to Emirates!", "https://b/2", 6, long),
        (5, "airbus", "Airbus opens new A320 production line in Toulouse", "https://a/1", 7, long),
        (6, "ntsb", "Investigators look into gear collapse at Tulsa", "https://n/1", 8, long),
        *[(7 + i, "herald", f"Incident: {x}", f"https://h/{i}", 20 + i, long[: 30 + i]) for i, x in enumerate(["red balloon in a field", "glider lost canopy", "bird strike on climb", "smoke below deck", "hail dents nose cone", "gear door missing"])],
        (13, "faa", "Statement on winter operations of the agency", "https://f/9", 2, long),
        (14, "faa", "Archive of old advisory circulars", "https://f/10", 130, long),
        (15, "easa", "   ", "https://e/9", 1, long),
    ]
    df = spark.createDataFrame([(i, s, t, u, hours(h), long) for i, s, t, u, h, long in rows], "id long, source string, raw string, link string, stamp timestamp_ntz, summary string")
    as_of = F.lit(now).cast("timestamp_ntz")
    from aeroflow.operators.gates import freshness

    fresh = df.where(freshness(F.col("stamp"), as_of, F.col("raw")) == "fresh")
    fresh = fresh.select("id", "source", "summary", F.timestamp_diff("HOUR", F.col("stamp"), as_of).alias("age"), T.title_key(F.col("raw")).alias("title"), T.canonical_url(F.col("link")).alias("url"), P.event_tokens(F.col("raw"), F.col("summary")).alias("tokens"))
    seen_urls = spark.createDataFrame([("https://f/9",)], "url string")
    seen_titles = spark.createDataFrame([("boeing delivers 100th 787 to emirates", hours(24 * 5)), ("airbus opens new a320 production line in toulouse", hours(24 * 30))], "title string, first_seen timestamp_ntz")
    told = P.novelty(fresh, seen_urls, seen_titles, as_of)
    assert {r.id: (r.is_new, r.echoes) for r in told.collect() if r.id in (4, 5, 13)} == {4: (True, True), 5: (True, False), 13: (False, True)}
    groups = P.event_groups(fresh)
    got = P.pending_groups(told, groups, F.col("title").startswith("incident")).orderBy("rank").collect()
    assert sum(r.n_members for r in got) == 12 and len(got) == 6
    assert [(r.group_id, r.lead_id, r.is_update, r.roundup) for r in got] == [(1, 1, False, False), (3, 3, False, False), (4, 4, True, False), (5, 5, False, False), (6, 6, False, False), (7, 12, False, True)]


def test_long_titles_are_bound_by_common_grams(monkeypatch):
    """Unlike long titles of one language are left out before any subsequence is told; no like pair is lost."""
    rng = random.Random(8)
    syllables = ["the", "an", "ing", "er", "ou", "th", "and", "re", "st", "ha", "we", "on", " ", " ", "ti", "bl"]
    base = ["".join(rng.choice(syllables) for _ in range(n)) + rng.choice("qxzjkv") for n in [95, 110, 130, 60] * 12]
    changed = []
    for t in base:
        for share in (0.03, 0.12, 0.25):
            c = list(t)
            for _ in range(int(len(c) * share)):
                c[rng.randrange(len(c))] = rng.choice("abcdeghij ")
            changed.append("".join(c))
    every = base + changed
    tile = titles.Tile([{"title": t, "id": i} for i, t in enumerate(every)])
    asked = base[::4] + base[3::12]
    n_near, n_like = 0, 0
    for t in asked:
        for both in (False, True):
            near, _ = tile.near(t, 0.75, both=both)
            reach = dict(zip(near.tolist(), tile.reach(near.tolist(), t)))
            for i, r in enumerate(tile.rows):
                ratio = difflib.SequenceMatcher(None, t, r["title"]).ratio()
                ratio = max(ratio, difflib.SequenceMatcher(None, r["title"], t).ratio()) if both else ratio
                if ratio >= 0.75:
                    n_like += 1
                    assert reach.get(i, 0) >= ratio - 1e-12
            if not both and len(t) >= titles.LONG:
                n_near += sum(len(tile.rows[i]["title"]) >= titles.LONG for i in near.tolist())
    assert n_like > 60 and n_near < 100  # by characters alone, more than 1000


def test_subsequences_in_arrays(monkeypatch):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdé 漢") for _ in range(rng.randrange(1, 260))) for _ in range(90)]
    tile = titles.Tile([{"title": t} for t in words])
    for t in [*words[:6], "a" * 64, "ab" * 64, "漢" * 63, "x" * 300]:
        want = [2 * n / (len(r["title"]) + len(t)) for n, r in zip(longest_common_subsequences([r["title"] for r in tile.rows], t), tile.rows)]
        assert tile.reach(list(range(90)), t) == want


def test_groups_of_characters_bound_subsequences():
    """Most unlike titles of one language fall out by groups of characters, and none that is like enough."""
    rng = random.Random(14)
    letters = "eeeeetttaaaooiinnsshhrrddlluucmwfgypbvkxjqzéß漢 "
    many = ["".join(rng.choice(letters) for _ in range(rng.randrange(60, 240))) for _ in range(200)]
    many += ["".join(rng.choice(letters) if rng.random() < 0.15 else c for c in t) for t in many[:40]]
    tile = titles.Tile([{"title": t, "id": i} for i, t in enumerate(many)])
    n_left, n_like, n_all = 0, 0, 0
    for t in [*many[:25], "e" * 90, "漢" * 70]:
        near = tile.near(t, 0.7)[0]
        left = set(tile.sifted(near, t, 0.7).tolist())
        like = {i for i, r in zip(near.tolist(), tile.reach(near.tolist(), t)) if r >= 0.7}
        assert like <= left <= set(near.tolist())
        n_left, n_like, n_all = n_left + len(left), n_like + len(like), n_all + len(near)
    assert n_like >= 40 and n_left < n_all / 5


def test_titles_are_not_shuffled_for_tiles(spark, monkeypatch):
    """What is shuffled does not grow with the tiles that a title may meet, and every pair comes once."""
    monkeypatch.setattr(titles, "TILE", 5)
    rng = random.Random(15)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(20, 60))) for _ in range(30)]
    rows = [(i, t[: rng.randrange(len(t) * 3 // 4, len(t) + 1)] + "xyz"[i % 3]) for i, t in enumerate(base * 4)]
    rows = list({t: (i, t) for i, t in rows}.values())
    df = spark.createDataFrame(rows, "id long, title string")
    found = similar_titles(df, df, once=True)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = {(i, j) for i, a in rows for j, b in rows if i < j and difflib.SequenceMatcher(None, a, b).ratio() >= 0.75}
    got = [(r.src, r.dst) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
