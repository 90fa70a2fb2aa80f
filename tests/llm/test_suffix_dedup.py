import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from aeroflow.llm import suffix_dedup
from aeroflow.llm.suffix_dedup import _common, merged, repeated_bytes

SCHEMA = "doc_id long, text string, t string, sha string, copies int, bytes string"


def brute(rows, length):
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for ident, t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((ident, len(t), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=str)


def documents(seed, length, n=60):
    rng = random.Random(seed)
    alphabet = rng.choice(["a", "ab", "abcdé", "abcdefghijklmnopqrstuvwxyz ü日"])
    word = lambda most: "".join(rng.choice(alphabet) for _ in range(rng.randint(0, most)))
    shared = [word(5 * length) for _ in range(6)]
    rows = []
    for i in range(n):
        text = "".join(rng.choice([word(length), rng.choice(shared), rng.choice(shared)[rng.randint(0, 7) :]]) for _ in range(rng.randint(0, 6)))
        rows.append((rng.choice([i, i, None]), rng.choice([text] * 9 + [None]), "x", "y", 1, "z"))
    edited = rows[1][1] or "abc" * length
    return [*rows, (1000, edited[: len(edited) // 2] + "#" + edited[len(edited) // 2 :], "", "", 0, ""), rows[2], rows[2]]


@pytest.mark.parametrize(("seed", "length", "run_bytes"), [(1, 20, 10**7), (2, 12, 4000), (3, 33, 900), (4, 400, 50_000)])
def test_same_as_brute_force(spark, monkeypatch, seed, length, run_bytes):
    monkeypatch.setattr(suffix_dedup, "RUN_BYTES", run_bytes)
    monkeypatch.setattr(suffix_dedup, "ROW_SUFFIXES", 9)
    monkeypatch.setattr(suffix_dedup, "PIECE", 3 * length if seed % 2 else 1 << 22)
    rows = documents(seed, length)
    got = repeated_bytes(spark.createDataFrame(rows, SCHEMA).repartition(5), length=length)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, length)


def test_long_text_of_one_character(spark):
    rows = [(1, "a" * 300_000, "", "", 0, ""), (2, "b" * 399, "", "", 0, ""), (3, "c" * 401, "", "", 0, ""), (4, "c" * 399 + "d", "", "", 0, "")]
    assert sorted(map(tuple, repeated_bytes(spark.createDataFrame(rows, SCHEMA)).collect())) == brute(rows, 400)


def test_merge_tells_common_lengths():
    rng = random.Random(1)
    for k in (1, 2, 3, 5, 8):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 30))) for _ in range(k)]
        coded = [iter([(_common(a, b, 0), b) for a, b in zip([b"", *r], r, strict=False)]) for r in runs]
        got = list(merged(coded))
        want = sorted(x for r in runs for x in r)
        assert [x for _, x in got] == want
        assert [n for n, _ in got] == [_common(a, b, 0) for a, b in zip([b"", *want], want, strict=False)]


def test_empty(spark):
    assert repeated_bytes(spark.createDataFrame([], SCHEMA)).count() == 0
