import random
import re

import numpy as np
import pytest

import corpus_pipeline as P
from test_mixing import water_fill
from test_simhash import plain_fingerprint
from test_substring_dedup import prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    rows = [(i, "\n".join(prose(rng, rng.randrange(40, 120)) for _ in range(3)), "en", rng.choice("aab"), 0) for i in range(120)]
    rows += [(200 + i, rows[i][1], "en", "b", 0) for i in range(10)]  # copies
    rows += [(300 + i, "too short", "en", "a", 0) for i in range(5)]
    passage = prose(rng, 70)
    rows += [(400 + i, f"{prose(rng, 60)} {passage} {prose(rng, 60)}", "en", "b", 0) for i in range(4)]
    rows += [(500, None, None, None, 0)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path, rows, passage


def test_stages_in_turn(spark, folder):
    path, rows, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    seen = []
    for _, stage in P.STAGES:
        docs = P.materialise(stage(spark, docs, path), "stage-test")
        seen.append(docs.collect())
    assert all(sorted(x[0].asDict()) == sorted(columns) for x in seen[:-1])
    good, single, cut, mixed, encoded = seen
    assert {r.doc_id for r in good} == {r[0] for r in rows if r[0] < 300 or 400 <= r[0] < 500}
    prints = {r.doc_id: plain_fingerprint(r.text) for r in good}
    assert {r.doc_id for r in single} == {i for i in prints if not any((prints[i] ^ prints[j]).bit_count() <= 2 for j in prints if j < i)}
    assert {r.doc_id for r in cut} == {r.doc_id for r in single}
    text = {r.doc_id: r.text for r in cut}
    assert passage in text[400]
    before = {r[0]: r[1] for r in rows}
    assert all(text[i].split() == before[i].split()[:60] + before[i].split()[130:] for i in (401, 402, 403))
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sizes, taken = {}, {}
    for r in cut:
        sizes[r.source] = sizes.get(r.source, 0) + size(r.text)
    for r in mixed:
        taken[r.source] = taken.get(r.source, 0) + size(r.text)
    for s, words in water_fill(sizes).items():
        assert abs(taken[s] - words) <= max(size(r.text) for r in cut)
    assert sorted((r.doc_id, bytes(r.decoded).decode()) for r in encoded) == sorted((r.doc_id, r.text) for r in mixed)


def test_run_is_the_stages(spark, folder):
    path = folder[0]
    once = P.run(spark, path).collect()
    again = P.run(spark, path).collect()
    key = lambda r: (r.doc_id, r.ids)
    assert sorted(map(key, once)) == sorted(map(key, again)) and len(once) > 100
    assert np.all([len(r.ids) > 0 for r in once])


def test_runs_do_not_disturb_each_other(spark, folder):
    """Stages of two runs in turn; what a stage returns can be read twice, also after later stages."""
    path = folder[0]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    held = {}
    for run in ("a", "b"):
        out = docs
        for name, stage in P.STAGES[:4]:
            returned = stage(spark, out, path)
            held[run, name] = returned
            out = P.materialise(returned, "twice-test")
    key = lambda r: (r.doc_id is None, r.doc_id, r.text or "")
    for name, _ in P.STAGES[:4]:
        a, b = (sorted(map(key, held[run, name].collect())) for run in ("a", "b"))
        assert a == b and a
