import random
import re
from collections import Counter, defaultdict

import pytest

from aeroflow.llm import source_audit
from aeroflow.llm.source_audit import source_divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, at int"


def brute(rows, min_docs, top):
    uses, in_docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        lower = "".join(c.lower() if c.isascii() else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        groups.add((lang or "", source or ""))
        uses[lang or "", source or ""].update(terms)
        in_docs[lang or ""].update(set(terms))
    out = []
    share = lambda n, total, v: 1 + 10**9 * (n + 5) // (total + 5 * v)
    for lang, source in groups:
        kept = sorted(t for t, n in in_docs[lang].items() if n >= min_docs)
        own = {s: uses[lang, s] for x, s in groups if x == lang}
        p = {s: {t: share(c[t], sum(c[k] for k in kept), len(kept)) for t in kept} for s, c in own.items()}
        whole = sum(own.values(), Counter())
        total = sum(whole[k] for k in kept)
        pairs = [(s, sum(abs(p[source][t] - p[s][t]) for t in kept)) for s in own if s != source]
        gaps = [(t, p[source][t] - share(whole[t], total, len(kept))) for t in kept if own[source][t]]
        for part, found, most in (("pair", pairs, None), ("term", [x for x in gaps if x[1] > 0], top)):
            ordered = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(ordered)]
    return sorted(out)


def documents(seed, n=240):
    rng = random.Random(seed)
    words = ["Ab", "aB", "cd", "é", "zürich", "日本", "\U0001f600x", "q", "don't", "x1y", " ", "Ä", "ä", *(f"w{c}" for c in "abcdefghij")]
    rows = []
    for i in range(n):
        text = rng.choice(["", " ", "\x00"]).join(rng.choice([" ", "-", "\n"]) + rng.choice(words[: rng.choice([3, 9, 23])]) for _ in range(rng.choice([0, 1, 8, 40])))
        rows.append((i, rng.choice([text, text, text, None]), rng.choice(["en", "en", "en", "de", None]), rng.choice(["a", "a", "a", "b", "é", "z", None]), "x", 1, 2))
    return rows + [(None, "only here", "fr", "one", "", 0, 0), rows[3], rows[3]]


@pytest.mark.parametrize(("seed", "min_docs", "top"), [(1, 30, 50), (2, 5, 4), (3, 1, 2)])
def test_same_as_brute_force(spark, monkeypatch, seed, min_docs, top):
    monkeypatch.setattr(source_audit, "PROFILES", 4)
    rows = documents(seed)
    got = source_divergence(spark.createDataFrame(rows, SCHEMA).repartition(3), min_docs=min_docs, top=top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(rows, min_docs, top)


def test_text_in_pieces(monkeypatch):
    monkeypatch.setattr(source_audit, "PIECE", 16)
    text = ("Abc déf " * 20 + "x" * 50 + " 12 Y").encode()
    assert [t for p in source_audit._pieces(text) for t in p] == re.findall(rb"[a-z\x80-\xff]+", text.lower())


def test_blocks_of_cells(monkeypatch, spark):
    monkeypatch.setattr(source_audit, "CELLS", 8)
    rows = documents(5, 120)
    assert sorted(map(tuple, source_divergence(spark.createDataFrame(rows, SCHEMA), min_docs=2).collect())) == brute(rows, 2, 50)


def test_empty(spark):
    assert source_divergence(spark.createDataFrame([], SCHEMA)).count() == 0
