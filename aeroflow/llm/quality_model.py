"""Quality classifier: heuristic labellers, their accuracies by EM, and a hashed linear scorer."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from aeroflow.llm.frames import groups, table
from aeroflow.storage import materialise

BUCKETS = 1 << 15

#: At most this many documents of each weak label are fitted on.
TRAIN_PER_LABEL = 2000
EPOCHS = 6

#: A document is kept if the scorer gives it this probability of good quality.
KEEP_FROM = 0.3

GOOD, BAD, NONE = 1, -1, 0


def _between(value: float, bad_below: float, good_from: float, good_to: float, bad_above: float) -> int:
    if value < bad_below or value > bad_above:
        return BAD
    return GOOD if good_from <= value <= good_to else NONE


def shares(text: str) -> dict[str, float]:
    """The quantities that the labellers judge; none for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return {}
    chars = sum(map(len, words))
    lines = [x for x in text.split("\n") if x.strip()]
    plain = [w.isalpha() for w in (w.strip(".,;:!?'\"()[]-") for w in words)]
    ends = sum(map(text.count, (". ", "! ", "? ", ".\n"))) + text.endswith((".", "!", "?"))
    return {
        "symbols": sum(map(text.count, "#*$%&|<>{}=~^")) / chars,
        "stutter": sum(map(str.__eq__, words, words[1:])) / n,
        "variety": 1 - len(set(words)) / n,
        "lines": 1 - len(set(lines)) / max(1, len(lines)),
        "short_words": sum(p and len(w) <= 3 for w, p in zip(words, plain)) / n,
        "sentences": ends / n,
        "word_length": chars / n,
        "plain_words": sum(plain) / n,
        "words": n,
        "n_lines": len(lines),
    }


#: Labellers: the quantity, bad below, good from, good to, bad above, and the least number of
#: words and of lines to vote on.
LABELLERS = {
    "symbols": (-1, 0, 0.003, 0.02, 1, 1),
    "stutter": (-1, 0, 0.02, 0.1, 5, 1),
    "variety": (-1, 0, 0.6, 0.85, 30, 1),
    "lines": (-1, 0, 0.05, 0.3, 1, 3),
    "short_words": (0.08, 0.2, 0.7, 0.9, 20, 1),
    "sentences": (0.005, 0.02, 0.35, 0.5, 20, 1),
    "word_length": (2, 3, 9, 14, 5, 1),
    "plain_words": (0.7, 0.9, 1, 2, 5, 1),
    "words": (-1, 40, float("inf"), float("inf"), 1, 1),
}


def votes(found: dict[str, float]) -> tuple[int, ...]:
    """One vote of each labeller: 1 good, -1 bad, 0 abstains. They overlap on purpose."""
    if not found:
        return (BAD,) * len(LABELLERS)
    return tuple(_between(found[name], *limits) if found["words"] >= words and found["n_lines"] >= lines else NONE for name, (*limits, words, lines) in LABELLERS.items())


@dataclass
class LabelModel:
    """What EM estimates: the share of good documents and each labeller's votes for both kinds."""

    prior: float
    #: votes[labeller, quality, 0 for a bad vote and 1 for a good one], of documents voted on
    votes: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of good quality for rows of votes; abstentions say nothing."""
        log = np.log((1 - self.prior) / self.prior) + sum((patterns == v) @ np.log(self.votes[:, 0, i] / self.votes[:, 1, i]) for i, v in ((0, BAD), (1, GOOD)))
        return 1 / (1 + np.exp(np.clip(log, -500, 500)))

    def accuracies(self) -> np.ndarray:
        """For each labeller, how often its vote is right when it votes."""
        return (1 - self.prior) * self.votes[:, 0, 0] + self.prior * self.votes[:, 1, 1]


def _better_than_chance(shares: np.ndarray) -> np.ndarray:
    """A labeller's vote is taken to be right at least half the time for either kind."""
    right = np.maximum(0.5, shares[:, [0, 1], [0, 1]])
    return np.stack([np.stack([right[:, 0], 1 - right[:, 0]], -1), np.stack([1 - right[:, 1], right[:, 1]], -1)], 1)


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over vote patterns and how many documents show each.

    Starts from the majority vote; a pseudo-count in each cell keeps labellers that never err in
    a small table from certainty.
    """
    p = np.clip(0.5 + patterns.sum(axis=1) / (2 * patterns.shape[1]), 0.02, 0.98)
    model = LabelModel(0.5, np.zeros((patterns.shape[1], 2, 2)))
    for _ in range(rounds):
        weight = np.stack([(1 - p) * counts, p * counts])
        cells = np.stack([(weight @ (patterns == v)) for v in (BAD, GOOD)], axis=-1) + 1.0
        model = LabelModel(float(np.clip(weight[1].sum() / counts.sum(), 1e-3, 1 - 1e-3)), _better_than_chance((cells / cells.sum(axis=-1, keepdims=True)).transpose(1, 0, 2)))
        new = model.posterior(patterns)
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return model


def hashed_features(text: str, found: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values: byte pairs and triples by log count, and the shares by steps.

    Both kinds have unit length, so a long text weighs no more than a short one.
    """
    x = np.frombuffer(text.encode(), np.uint8).astype(np.uint32)
    with np.errstate(over="ignore"):
        two = x[:-1] * np.uint32(0x9E3779B1) + x[1:] * np.uint32(0x85EBCA77)
        grams = np.concatenate([two * np.uint32(0x27D4EB2F), (two[:-1] + x[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x165667B1)])
    count = np.bincount(grams >> np.uint32(17), minlength=BUCKETS)
    at = np.flatnonzero(count)
    value = np.log1p(count[at])
    steps = [zlib.crc32(f"{name}:{int(8 * np.log2(1 + (50 if name != 'words' else 1) * v))}".encode()) % BUCKETS for name, v in found.items()]
    return np.r_[at, steps].astype(np.int64), np.r_[value / max(1e-12, float(np.sqrt(value @ value))), np.full(len(steps), 1 / max(1, len(steps)) ** 0.5)]


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray, float]]) -> np.ndarray:
    """Logistic regression on soft labels by AdaGrad; the last weight is the bias."""
    w, seen = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-2)
    for _ in range(EPOCHS):
        for at, x, label in rows:
            error = 1 / (1 + np.exp(-np.clip(x @ w[at] + w[-1], -30, 30))) - label
            gradient = error * x
            np.add.at(seen, at, gradient**2)
            seen[-1] += error**2
            np.add.at(w, at, -0.3 * gradient / np.sqrt(seen[at]))
            w[-1] -= 0.1 * error / np.sqrt(seen[-1])
    return w


def vote_patterns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, votes) with a letter b, - or g for each labeller."""
    kept = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = ["".join("b-g"[v + 1] for v in votes(shares(x.as_py()))) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], names=["id", "votes"])

    return kept.mapInArrow(run, f"id {kept.dtypes[0][1]}, votes string")


def _patterns(names: list[str]) -> np.ndarray:
    return np.array([["b-g".index(c) - 1 for c in x] for x in names]).reshape(len(names), len(LABELLERS))


@dataclass
class QualityModel:
    labels: LabelModel
    weights: np.ndarray

    def score(self, text: str, found: dict[str, float]) -> float:
        if not found:
            return 0.0
        at, x = hashed_features(text, found)
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights[at] + self.weights[-1], -30, 30))))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Estimate the labellers on all documents, then fit the scorer on their posterior labels.

    EM sees the number of documents with each pattern of votes (at most 3 to the power of the
    number of labellers), so all documents count. The scorer is fitted on TRAIN_PER_LABEL
    documents at most of either weak label, drawn by a hash.
    """
    kept = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    voted = materialise(vote_patterns(kept.select(F.xxhash64("id", "text").alias("h"), "text"), "h"), "quality-votes")
    counted = sorted((r.votes, r["count"]) for r in voted.groupBy("votes").count().collect())
    if not counted:
        return QualityModel(LabelModel(0.5, np.full((len(LABELLERS), 2, 2), 1 / 2)), np.zeros(BUCKETS + 1))
    patterns = _patterns([x for x, _ in counted])
    labels = fit_labels(patterns, np.array([n for _, n in counted], float))
    posterior = labels.posterior(patterns)
    spark = docs.sparkSession
    sizes = [sum(n for (_, n), p in zip(counted, posterior) if (p >= 0.5) == good) for good in (False, True)]
    weak = spark.createDataFrame([(x, float(p), min(1.0, (1.5 * TRAIN_PER_LABEL + 50) / max(1, sizes[int(p >= 0.5)]))) for (x, _), p in zip(counted, posterior)], "votes string, posterior double, share double")
    draw = F.pmod(F.xxhash64(F.lit(11), "h"), F.lit(1 << 30))
    drawn = voted.withColumnRenamed("id", "h").join(F.broadcast(weak), "votes").withColumn("draw", draw).where(F.col("draw") < F.col("share") * (1 << 30))
    first = Window.partitionBy(F.col("posterior") >= 0.5).orderBy("draw", "h")
    chosen = drawn.withColumn("n", F.row_number().over(first)).where(F.col("n") <= TRAIN_PER_LABEL).select("h", "draw", "posterior").dropDuplicates(["h"])
    rows = kept.withColumn("h", F.xxhash64("id", "text")).join(F.broadcast(chosen), "h").select("h", "draw", "posterior", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in groups(b.column(3).to_pylist(), 200_000):
                found = [hashed_features(x, shares(x)) for x in b.column(3).slice(i, j - i).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(k).slice(i, j - i) for k in range(3)), pa.array([a.astype("<i4").tobytes() for a, _ in found], pa.binary()), pa.array([x.astype("<f4").tobytes() for _, x in found], pa.binary())],
                    names=["h", "draw", "posterior", "at", "x"],
                )

    sample = {r.h: r for r in rows.mapInArrow(run, "h long, draw long, posterior double, at binary, x binary").dropDuplicates(["h"]).collect()}
    ordered = sorted(sample.values(), key=lambda r: (r.draw, r.h))
    return QualityModel(labels, fit_scorer([(np.frombuffer(r["at"], "<i4"), np.frombuffer(r.x, "<f4").astype(float), r.posterior) for r in ordered]))


def classify(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text.

    Returns one row per input row: the id column, ``weak_label`` (the posterior of the labellers'
    votes), ``score`` (the scorer's probability of good quality; 0 for a null or blank text) and
    ``kept``. Null and repeated ids and repeated rows pass through; further columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x.as_py() for x in b.column(1)]
            found = [shares(x) for x in texts]
            scores = [shared.value.score(x, f) for x, f in zip(texts, found)]
            weak = shared.value.labels.posterior(np.array([votes(f) for f in found]).reshape(len(texts), len(LABELLERS)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(weak), pa.array(scores, pa.float64()), pa.array([x >= KEEP_FROM for x in scores], pa.bool_())], names=["id", "weak_label", "score", "kept"])

    return kept.mapInArrow(run, f"id {kept.dtypes[0][1]}, weak_label double, score double, kept boolean").withColumnRenamed("id", id_col)


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text by the scorer that is trained on the posterior of the heuristic labellers."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, train(docs))
