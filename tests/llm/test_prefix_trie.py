import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from aeroflow.llm import prefix_trie
from aeroflow.llm.prefix_trie import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, a string, depth long, words string, _part int"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0, role, digest), (role, text)))
    turns = {c: [t for _, t in sorted(own[c])] for c in own}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
    nodes = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            nodes[t[:d]].append(c)
    children = defaultdict(set)
    for n in nodes:
        if n:
            children[n[:-1]].add(n)
    words = {n: len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0 for n in nodes}
    leaves, saved = defaultdict(int), defaultdict(int)
    for n in nodes:
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += (len(nodes[n]) - 1) * words[n]
    return sorted(
        (min(m), len(n), min(nodes[n[:-1]]) if n else None, len(m), len(children[n]), leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(c for c in m if len(built[c]) == len(n)))).encode()).hexdigest())
        for n, m in nodes.items()
    )


def conversations(seed, n=400, deep=0):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-60, n * 2), n):
        for turn in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, rng.choice([turn, turn, turn, None, 2]), rng.choice(["user", "user", None]), rng.choice(["hello there", "a b c", "", None, "é ü x"]), "x", 1, None, 3))
    rows += [(7777, t, "user", f"w{t % 3} again", "x", 0, "", 1) for t in range(deep)] + [(8888, t, "user", f"w{t % 3} again" if t < deep - 3 else "end", "x", 0, "", 1) for t in range(deep)]
    return rows + [(None, 1, "user", "nobody", "x", 0, "", 1), rows[0], rows[0]]


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize(("band", "deep"), [(16, 40), (2, 23), (3, 10)])
def test_same_as_brute_force(spark, band, deep):
    rows = conversations(band, 150, deep)
    got = conversation_trie(spark.createDataFrame(rows, SCHEMA), band=band)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows), key=str)


def test_many_conversations_end_at_one_node(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS_PER_ROW", 8)
    rows = [(c, t, "user", "same", None, None, None, None) for c in range(300) for t in range(3)]
    assert sorted(map(tuple, conversation_trie(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == sorted(brute(rows), key=str)


def test_empty(spark):
    assert conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
