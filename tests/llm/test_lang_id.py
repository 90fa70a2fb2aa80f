import random

import numpy as np

from aeroflow.llm import lang_id as L

BAGS = {
    "en": "the of and to in that this with which from have been were their would".split(),
    "fr": "le la les des et dans une avec pour qui été était leurs cette elle".split(),
    "de": "der die das und nicht mit für über wäre haben werden auch sich eine".split(),
}


def documents(n, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(BAGS[x]) for _ in range(rng.randrange(5, 60))), x, "z", 0.5) for i in range(n) for x in [rng.choice([*BAGS, "en", "en"])]]


def test_held_out_accuracy(spark):
    rows = documents(600)
    odd = [(10_000, None, "en", "z", 0.5), (10_001, "", "en", "z", 0.5), (10_002, "12 .,! ² _", None, "z", 0.5), (10_003, "the and", None, "z", 0.5), (None, "der die das", "de", "z", 0.5), (5, "le la les", "fr", "z", 0.5)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, lang_pred string, score double")
    model = L.train(docs.where(~L.held_out()))
    got = L.identify(docs, model).withColumn("held_out", L.held_out()).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id != 5]
    assert len(held) > 80 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].lang_pred for i in (10_000, 10_001, 10_002)] == ["und"] * 3
    assert by_id[10_003].lang_pred == "en" and by_id[None].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in got)
    assert L.train(docs.where(~L.held_out())).weights.tobytes() == model.weights.tobytes()
    assert (model.weights == 0).mean() > 0.5  # sparse


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in L.identify(docs, L.train(docs)).collect()} == {"und"}
    empty = docs.limit(0)
    assert L.identify(empty, L.train(empty)).collect() == []
    one = spark.createDataFrame([(1, "some text", "xx")], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in L.identify(one, L.train(one)).collect()] == [("xx", 1.0)]


def test_temperature_calibrates():
    rng = np.random.default_rng(1)
    logits = rng.normal(size=(4000, 3))
    targets = np.array([rng.choice(3, p=L.softmax(x)) for x in logits])
    assert abs(L.temperature(logits * 5, targets) - 5) < 0.7


def test_counts_ignore_case_and_marks():
    assert (L.counts("Le chat, 12 noir") == L.counts("le CHAT noir")).all()
    assert L.counts("x" * 100_000).sum() == 100_000 + 99_999 + 99_998
    assert L.counts("a") is not None


def test_counts_and_frequencies_by_direct_loops(spark):
    """N-grams, document frequencies and TF-IDF against loops over characters."""
    texts = ["Abc  d1e", "abc", None, "42", "é!é", "abc abc"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found, n = L._document_frequencies(df.where("text is not null"))

    def buckets(text):
        letters = "".join(c if c.isalpha() else " " for c in text.lower())
        while "  " in letters:
            letters = letters.replace("  ", " ")
        x = [ord(c) for c in letters]
        m = lambda v: v & 0xFFFFFFFF
        one = [m(a * 0x9E3779B1) for a in x]
        two = [m(m(p * 31) + m(b * 0x85EBCA77)) for p, b in zip(one, x[1:])]
        three = [m(m(p * 31) + m(c * 0xC2B2AE3D)) for p, c in zip(two, x[2:])]
        return [g >> 17 for g in [*one, *(m(g * 0x27D4EB2F) for g in two), *(m(g * 0x165667B1) for g in three)]]

    lettered = [t for t in texts if t and any(c.isalpha() for c in t)]
    want = np.zeros(L.BUCKETS)
    for t in lettered:
        for b in set(buckets(t)):
            want[b] += 1
        count = L.counts(t)
        assert count.sum() == len(buckets(t)) and all(count[b] == buckets(t).count(b) for b in set(buckets(t)))
    assert n == len(lettered) and (found == want).all()


def test_ftrl_updates_by_direct_loops():
    """Each coordinate by the published update, one at a time."""
    rng = random.Random(4)
    model, z, n = L.Ftrl(6, 3, l1=1.0), [[0.0] * 3 for _ in range(6)], [[0.0] * 3 for _ in range(6)]

    def weight(i, k):
        if abs(z[i][k]) <= model.l1:
            return 0.0
        sign = 1 if z[i][k] > 0 else -1
        return -(z[i][k] - sign * model.l1) / ((model.beta + n[i][k] ** 0.5) / model.alpha + model.l2)

    for _ in range(80):
        at = sorted(rng.sample(range(6), 3))
        x, target = [rng.random() for _ in at], rng.randrange(3)
        w = [[weight(i, k) for k in range(3)] for i in at]
        logits = [sum(v * w[j][k] for j, v in enumerate(x)) for k in range(3)]
        e = [np.exp(v - max(logits)) for v in logits]
        for j, i in enumerate(at):
            for k in range(3):
                g = x[j] * (e[k] / sum(e) - (k == target))
                sigma = ((n[i][k] + g * g) ** 0.5 - n[i][k] ** 0.5) / model.alpha
                z[i][k] += g - sigma * w[j][k]
                n[i][k] += g * g
        model.update(np.array(at), np.array(x), target)
    assert np.allclose(model.weights(), [[weight(i, k) for k in range(3)] for i in range(6)])
    assert (model.weights() == 0).any()


def test_a_very_long_text_and_many_languages(spark, monkeypatch):
    monkeypatch.setattr(L, "MAX_LANGUAGES", 2)
    rows = [(i, t, x) for i, t, x, _, _ in documents(300)] + [(1000, "der die das " * 40_000, "de")]
    model = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 2 and "en" in model.languages
    got = L.identify(spark.createDataFrame(rows[-1:], "doc_id long, text string, lang string"), model).collect()
    assert got[0].lang_pred in model.languages and 0 <= got[0].score <= 1
