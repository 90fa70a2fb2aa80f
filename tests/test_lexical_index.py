"""The stored lexical index against plain scoring, and its refresh."""

import os
import random
from collections import defaultdict

from aeroflow.sources import lexical_index as L
from aeroflow.sources.lexical_index import LexicalIndex, index_records

SCHEMA = "id long, title_tokens array<string>, entity_tokens array<string>, text_tokens array<string>"


def documents(rng, n):
    words = [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(400)]
    pick = lambda k: list(dict.fromkeys(rng.choice(words) for _ in range(rng.randrange(k))))
    return [(i, pick(6), rng.choice([pick(4), None]), pick(40)) for i in range(n)], pick


def plain(docs, queries, phrases, top=5, least=3):
    out = []
    for q, tokens in queries:
        scores = defaultdict(int)
        for i, title, entities, text in docs:
            for t in tokens:
                scores[i] += 4 * (t in title) + 3 * (t in (entities or [])) + (t in text)
        for p, i in set(phrases):
            if p == q:
                scores[i] += 6
        best = sorted(((s, i) for i, s in scores.items() if s >= least), reverse=True)[:top]
        out += [(q, i, s, n + 1) for n, (s, i) in enumerate(best)]
    return sorted(out)


def stamps(folder):
    return {d: sorted(os.listdir(f"{folder}/lists/{d}")) for d in os.listdir(f"{folder}/lists") if d.startswith("bucket")}


def test_search_and_refresh(spark, tmp_path):
    rng = random.Random(8)
    docs, pick = documents(rng, 400)
    queries = [(q, pick(14)) for q in range(40)] + [(90, []), (91, ["unheard"])]
    phrases = [(q, rng.randrange(400)) for q in range(0, 40, 3) for _ in range(3)]
    asked, held = spark.createDataFrame(queries, "query_id int, tokens array<string>"), spark.createDataFrame(phrases, "query_id int, id long")
    index = LexicalIndex(spark, str(tmp_path / "index"))
    assert index.search(asked).count() == 0
    assert index.refresh(index_records(spark.createDataFrame(docs, SCHEMA)))["added"] == 400
    assert sorted(map(tuple, index.search(asked, held).collect())) == plain(docs, queries, phrases)
    assert sorted(map(tuple, index.search(asked, None, 2, 6).collect())) == plain(docs, queries, [], 2, 6)

    before = stamps(tmp_path / "index")
    assert index.refresh(index_records(spark.createDataFrame(docs, SCHEMA))) == {"added": 0, "changed": 0, "removed": 0, "kept": 400, "folders": 0}
    assert stamps(tmp_path / "index") == before
    changed = [*docs[2:], (1, ["w1", "brandnew"], None, ["w2"]), (1000, ["brandnew"], [], [])]
    told = index.refresh(index_records(spark.createDataFrame(changed, SCHEMA)))
    assert (told["added"], told["changed"], told["removed"], told["kept"]) == (1, 1, 1, 398) and 0 < told["folders"] < L.BUCKETS
    after = stamps(tmp_path / "index")
    assert sum(before.get(d) == after.get(d) for d in before) == len(before) - told["folders"]  # the other folders keep their files
    queries += [(92, ["brandnew", "w1"])]
    asked = spark.createDataFrame(queries, "query_id int, tokens array<string>")
    assert sorted(map(tuple, index.search(asked, held).collect())) == plain(changed, queries, phrases)
