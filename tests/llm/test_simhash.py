import random
import re

import numpy as np
import xxhash

from aeroflow.llm import simhash as S


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if sum(h >> i & 1 for h in hashes) * 2 > len(hashes))


def plain_pairs(fps, bits=2):
    fps = sorted(set(fps))
    return {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= bits}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def spread(rng, base, n, bits):
    out = {base}
    while len(out) < n:
        x = rng.choice(list(out)[:50])
        for i in rng.sample(bits, 2):
            x ^= 1 << i
        out.add(x)
    return out


def test_masks_cover_two_bits():
    masks = S.signature_masks()
    flips = [1 << a | 1 << b for a in range(64) for b in range(a + 1)]
    assert all(any(not flip & m for m in masks) for flip in flips)
    assert all(m.bit_count() >= 42 for m in masks)


def test_fingerprints():
    rng = random.Random(4)
    for text in [None, "", " \n", "One", "one Two", "É é ABC", "A\x85b c\x1cd e"] + [" ".join(rng.choice("aB cD é the The of".split()) for _ in range(rng.randrange(60))) for _ in range(50)]:
        assert S.fingerprint(text) == plain_fingerprint(text)


def test_links_are_all_pairs(spark):
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(300)} | {0, 1, (1 << 64) - 1}
    fps |= spread(rng, rng.getrandbits(64), 400, range(64)) | spread(rng, rng.getrandbits(64), 600, range(12)) | spread(rng, rng.getrandbits(64), 200, range(30, 44))
    table = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    want = {tuple(sorted((signed(a), signed(b)))) for a, b in plain_pairs(fps)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = [tuple(r) for r in S.links(table).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(set(got))
    assert set(got) == want
    assert {tuple(r) for r in S.links(table).collect()} == want


def test_probing_equals_pairs():
    rng = random.Random(2)
    fps = np.array(sorted(spread(rng, 77, 500, range(20, 37))), np.uint64)
    a, b = S._close_in_run(fps, 2)
    assert {tuple(sorted(map(int, p))) for p in zip(a, b)} == plain_pairs(map(int, fps))


def make_docs(rng):
    words = [f"w{i}" for i in range(500)]
    docs = []
    for _ in range(60):
        text = [rng.choice(words) for _ in range(300)]
        for _ in range(rng.choice([1, 1, 3])):
            copy = list(text)
            if rng.random() < 0.7:
                copy[rng.randrange(300)] = "changed"
            docs.append(" ".join(copy))
    return docs + ["", None, " \t", "one", "One", docs[0], docs[0].upper()]


def test_groups_and_kept_documents(spark):
    rng = random.Random(8)
    texts = make_docs(rng)
    ids = rng.sample(range(1000), len(texts))
    rows = [(i, t, "q", 1) for i, t in zip(ids, texts)] + [(ids[3], texts[3], "q", 1), (None, "no id", "q", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    fps = [plain_fingerprint(r[1]) for r in rows]
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in plain_pairs(fps):
        parent[find(a)] = find(b)
    smallest = {}
    for r, f in zip(rows, fps):
        if r[0] is not None:
            smallest[find(f)] = min(smallest.get(find(f), 10**9), r[0])
    want = sorted(((r[0], signed(f), smallest.get(find(f))) for r, f in zip(rows, fps)), key=str)
    assert sorted(map(tuple, S.near_duplicates(docs).collect()), key=str) == want
    assert len(smallest) < len(rows) - 5
    kept = S.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(smallest.values())
    assert kept.where("doc_id is null").count() == 1


def test_rows_of_one_id_or_none_are_told_apart_by_text(spark):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(6)]
    rows = list(zip([None, None, None, 1, 2, 2], texts, range(6), "abcdef"))
    schema = "doc_id long, text string, _row int, _kept string"
    kept = S.deduplicated(spark.createDataFrame([*rows, rows[1], (2, texts[5], 9, "z"), (7, texts[0], 0, "a"), (8, texts[3], 3, "d")], schema))
    assert kept.columns == ["doc_id", "text", "_row", "_kept"]
    want = [(7, texts[0], 0, "a"), *rows[1:]]  # an id comes before none, and the copy under 8 goes
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(want, key=str)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(docs).count() == 0
    assert S.deduplicated(docs).count() == 0
