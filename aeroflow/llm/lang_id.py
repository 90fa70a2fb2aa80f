"""Language identification by sparse multinomial logistic regression on character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from aeroflow.llm.frames import table

UNDETERMINED = "und"

#: N-grams of 1 to 3 characters fall into this many buckets.
BUCKETS = 1 << 15

#: At most this many documents are fitted on, spread evenly over the languages (MIN_PER_LANGUAGE
#: or more of each). The n-grams' document frequencies come from all training documents.
TRAIN_ROWS = 3000
MIN_PER_LANGUAGE = 20

#: Languages that are learned at most: those with the most training documents, of equally frequent
#: ones the first. This bounds the weights on the driver and in each worker.
MAX_LANGUAGES = 256

#: One in so many of the fitted documents serves to find the temperature only.
CALIBRATION = 5

EPOCHS = 4

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point, itself if it is a letter, else a space; made once for each worker."""
    if not _LETTERS:
        points = np.arange(0x110000, dtype=np.uint32)
        letter = np.fromiter((chr(x).isalpha() for x in range(0x110000)), bool, 0x110000)
        _LETTERS.append(np.where(letter, points, 32))
    return _LETTERS[0]


def counts(text: str) -> np.ndarray | None:
    """Counts of a text's n-grams by bucket; None without a letter.

    The text is lower-cased and each run of characters other than letters becomes one space.
    """
    x = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
    blank = x == 32
    if blank.all():
        return None
    x = x[np.r_[True, ~(blank[1:] & blank[:-1])]]
    with np.errstate(over="ignore"):
        one = x * np.uint32(0x9E3779B1)
        two = one[:-1] * np.uint32(31) + x[1:] * np.uint32(0x85EBCA77)
        three = two[:-1] * np.uint32(31) + x[2:] * np.uint32(0xC2B2AE3D)
        grams = np.concatenate([one, two * np.uint32(0x27D4EB2F), three * np.uint32(0x165667B1)])
    return np.bincount(grams >> np.uint32(17), minlength=BUCKETS)


def features(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of unit length."""
    x = count * idf
    return x / max(1e-12, float(np.sqrt(x @ x)))


@dataclass
class Ftrl:
    """Follow-the-regularised-leader with elastic-net penalties, a weight column per class.

    ``l1`` keeps weights of rare evidence at exactly zero, ``l2`` shrinks the others.
    """

    buckets: int
    classes: int
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1

    def __post_init__(self) -> None:
        self.z = np.zeros((self.buckets, self.classes))
        self.n = np.zeros((self.buckets, self.classes))

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, at: np.ndarray, x: np.ndarray, target: int) -> None:
        w = self.weights(at)
        error = softmax(x @ w)
        error[target] -= 1
        gradient = x[:, None] * error
        sigma = (np.sqrt(self.n[at] + gradient**2) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += gradient - sigma * w
        self.n[at] += gradient**2


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, targets: np.ndarray) -> float:
    """The divisor of the logits that makes the targets most likely, by golden-section search."""
    if not len(targets):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))[np.arange(len(targets)), targets]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    low, high, ratio = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        count = counts(text) if text and self.languages else None
        if count is None:
            return UNDETERMINED, 0.0
        p = softmax(features(count, self.idf) @ self.weights / self.temperature)
        return self.languages[int(p.argmax())], float(min(1.0, p.max()))


def _document_frequencies(training: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, and the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            for text in b.column(0):
                count = counts(text.as_py())
                if count is not None:
                    total += count > 0
                    n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.r_[at, -1], pa.int32()), "n": pa.array(np.r_[total[at], n], pa.int64())})

    found = training.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS)
    n = 0
    for row in found:
        if row.bucket < 0:
            n = row.n
        else:
            out[row.bucket] = row.n
    return out, n


def _sample(training: DataFrame, sizes: dict[str, int]) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(lang, buckets, counts) of a bounded sample, in an order set by a hash."""
    each = max(MIN_PER_LANGUAGE, TRAIN_ROWS // len(sizes))
    keep = training.sparkSession.createDataFrame([(x, min(1.0, 1.5 * each / n + 20 / n)) for x, n in sizes.items()], "lang string, share double")
    draw = F.pmod(F.xxhash64(F.lit(7), "id", "text"), F.lit(1 << 30))
    drawn = training.withColumn("draw", draw).join(F.broadcast(keep), "lang").where(F.col("draw") < F.col("share") * (1 << 30))
    first = Window.partitionBy("lang").orderBy("draw", "id", "text")
    rows = drawn.withColumn("n", F.row_number().over(first)).where(F.col("n") <= each).select("lang", "draw", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [counts(x.as_py()) for x in b.column(2)]
            at = [np.flatnonzero(c) if c is not None else np.zeros(0, np.int64) for c in found]
            n = [c[a].astype("<i4").tobytes() if c is not None else b"" for c, a in zip(found, at)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([a.astype("<i4").tobytes() for a in at], pa.binary()), pa.array(n, pa.binary())], names=["lang", "draw", "at", "n"])

    found = rows.mapInArrow(run, "lang string, draw long, at binary, n binary").where(F.octet_length("at") > 0).collect()
    found.sort(key=lambda r: (r.draw, r.lang, bytes(r["at"])))
    return [(r.lang, np.frombuffer(r["at"], "<i4"), np.frombuffer(r.n, "<i4")) for r in found]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on all rows of ``docs`` that have a text and one of the MAX_LANGUAGES commonest languages.

    Document frequencies cover all of them. The weights are fitted by FTRL on a sample of
    TRAIN_ROWS documents at most (more only if there are over TRAIN_ROWS / MIN_PER_LANGUAGE
    languages), drawn by a hash; a fifth of it is held back to set the temperature.
    """
    kept = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    kept = kept.where("text is not null and lang is not null")
    sizes = {r.lang: r["count"] for r in kept.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()}
    if not sizes:
        return Model([], np.zeros(BUCKETS), np.zeros((BUCKETS, 0)), 1.0)
    frequencies, n = _document_frequencies(kept.where(F.col("lang").isin(*sizes)))
    idf = np.log((1 + n) / (1 + frequencies)) + 1
    languages = sorted(sizes)
    place = {x: i for i, x in enumerate(languages)}
    rows = [(place[lang], at, (v := c * idf[at]) / np.sqrt(v @ v)) for lang, at, c in _sample(kept, sizes)]
    held = rows[::CALIBRATION] if len(rows) >= 10 * CALIBRATION else []
    fitted = [r for i, r in enumerate(rows) if not held or i % CALIBRATION]
    ftrl = Ftrl(BUCKETS, len(languages))
    for _ in range(EPOCHS):
        for target, at, x in fitted:
            ftrl.update(at, x, target)
    weights = ftrl.weights()
    logits = np.array([x @ weights[at] for _, at, x in held]).reshape(len(held), len(languages))
    return Model(languages, idf, weights.astype(np.float32), temperature(logits, np.array([t for t, _, _ in held], np.int64)))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Predict the language of every whole text.

    Returns one row per input row: the id column, ``lang_pred`` (a language the model knows;
    ``und`` for a null text, one without a letter, or a model without languages) and ``score``,
    the calibrated probability (0 for ``und``). Null and repeated ids and repeated rows pass
    through; further columns are left out. The model, of BUCKETS weights a language, is sent to
    each executor once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shared.value.predict(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())], names=["id", "lang_pred", "score"])

    return kept.mapInArrow(run, f"id {kept.dtypes[0][1]}, lang_pred string, score double").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from the documents that are not held out; und without a letter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs, train(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
