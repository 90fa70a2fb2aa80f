import random

import numpy as np

from aeroflow.llm import quality_model as Q


def test_em_finds_the_accuracies():
    rng = np.random.default_rng(2)
    truth = rng.random(20000) < 0.8
    accuracy, covered = np.array([0.95, 0.9, 0.8, 0.7, 0.85]), np.array([0.9, 0.6, 0.8, 0.9, 0.3])
    right = rng.random((20000, 5)) < accuracy
    vote = np.where(right == truth[:, None], 1, -1) * (rng.random((20000, 5)) < covered)
    patterns, counts = np.unique(vote, axis=0, return_counts=True)
    model = Q.fit_labels(patterns, counts.astype(float))
    assert abs(model.prior - 0.8) < 0.03
    assert np.abs(model.accuracies() - accuracy).max() < 0.04
    posterior = model.posterior(vote)
    majority = np.where(vote.sum(axis=1) == 0, 1, np.sign(vote.sum(axis=1))) == 1
    assert ((posterior > 0.5) == truth).mean() >= (majority == truth).mean()


def rows(n=400, seed=4):
    rng = random.Random(seed)
    syllables = "ba be bi bo ta te ti to la le li lo ra re sa se".split()
    words = [a + b + c for a in syllables for b in syllables for c in ("", *syllables[:6])]
    out = []
    for i in range(n):
        sentence = lambda: " ".join(x for w in range(5) for x in (rng.choice(["a", "the", "of", "in", "it"]), rng.choice(words)))
        text = ". ".join(sentence() for _ in range(rng.randrange(5, 20))) + "."
        good = i % 4 > 0
        if not good:
            text = rng.choice([" ".join(w + rng.choice(["***", "&&&", "$$$"]) for w in text.split()), " | ".join(rng.choice(words) * 2 for _ in range(60))])
        out.append((i, text, good, 0.5, "x"))
    return out


def test_scores_separate(spark):
    made = rows()
    odd = [(1000, None, False, 0.5, "x"), (1001, "", False, 0.5, "x"), (1002, " \n ", False, 0.5, "x"), (None, made[1][1], True, 0.5, "x"), (1, made[1][1], True, 0.5, "x"), (1003, "word " * 20000, False, 0.5, "x"), (1004, "x", False, 0.5, "x")]
    docs = spark.createDataFrame(made + odd, "doc_id long, text string, good boolean, score double, votes string")
    model = Q.train(docs)
    got = Q.classify(docs, model).collect()
    assert len(got) == len(made) + len(odd)
    truth = {r[0]: r[2] for r in made}
    assert np.mean([r.kept == truth[r.doc_id] for r in got if r.doc_id in truth]) > 0.97
    assert all(r.kept for r in got if truth.get(r.doc_id))
    assert {r.score for r in got if r.doc_id in (1000, 1001, 1002)} == {0.0}
    assert all(0 <= r.score <= 1 and 0 <= r.weak_label <= 1 for r in got)
    assert np.array_equal(Q.train(docs.repartition(3)).weights, model.weights)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert Q.classify(docs, Q.train(docs)).collect() == []


def test_em_against_direct_loops():
    """Posteriors and accuracies document by document, without patterns and counts."""
    import random

    import numpy as np

    from aeroflow.llm import quality_model as Q

    rng = random.Random(6)
    docs = []
    for _ in range(400):
        good = rng.random() < 0.7
        docs.append([0 if rng.random() < 0.3 else (1 if good == (rng.random() < a) else -1) for a in (0.9, 0.8, 0.65, 0.95)])
    names = sorted({tuple(x) for x in docs})
    model = Q.fit_labels(np.array(names), np.array([sum(tuple(x) == n for x in docs) for n in names]), rounds=7)
    p = [min(0.98, max(0.02, 0.5 + sum(x) / 8)) for x in docs]
    for _ in range(7):
        prior = min(1 - 1e-3, max(1e-3, sum(p) / len(p)))
        right = []
        for j in range(4):
            cell = {(kind, v): 1.0 + sum(w for x, w in zip(docs, p if kind else [1 - q for q in p]) if x[j] == v) for kind in (0, 1) for v in (-1, 1)}
            right.append([max(0.5, cell[0, -1] / (cell[0, -1] + cell[0, 1])), max(0.5, cell[1, 1] / (cell[1, -1] + cell[1, 1]))])
        new = []
        for x in docs:
            bad, good = 1 - prior, prior
            for j, v in enumerate(x):
                if v:
                    bad *= right[j][0] if v < 0 else 1 - right[j][0]
                    good *= right[j][1] if v > 0 else 1 - right[j][1]
            new.append(good / (good + bad))
        done = max(abs(a - b) for a, b in zip(new, p)) < 1e-9
        p = new
        if done:
            break
    assert np.allclose(model.posterior(np.array(docs)), p, atol=1e-6)
    assert abs(model.prior - prior) < 1e-6
