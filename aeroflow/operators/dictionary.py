"""Find the phrases of a dictionary in texts by one linear pass over each text."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from aeroflow.storage import materialise

#: Characters of phrases in one automaton; a larger dictionary is split and takes a pass for each part.
PART_CHARS = 1_000_000


def _finder(part, whole_words: bool):
    """For each text the phrases of ``part`` (a broadcast list) that occur, how often and where first."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, automaton = part.value, ahocorasick.Automaton()
        for i, phrase in enumerate(phrases):
            automaton.add_word(phrase, i)
        automaton.make_automaton()
        sizes = [len(p) for p in phrases]
        for batch in batches:
            owner, found, counts, firsts = [], [], [], []
            for row, text in enumerate(batch["text"]):
                text = text.as_py() or ""
                seen: dict[int, list[int]] = {}
                for end, i in automaton.iter(text):
                    start = end + 1 - sizes[i]
                    if whole_words and (start > 0 and text[start - 1].isalnum() and text[start].isalnum() or end + 1 < len(text) and text[end].isalnum() and text[end + 1].isalnum()):
                        continue
                    if i in seen:
                        seen[i][0] += 1
                    else:
                        seen[i] = [1, start + 1]
                owner += [row] * len(seen)
                found += [phrases[i] for i in seen]
                counts += [n for n, _ in seen.values()]
                firsts += [at for _, at in seen.values()]
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(owner, pa.int64())), pa.array(found, pa.string()), pa.array(counts, pa.int32()), pa.array(firsts, pa.int32())], names=["id", "phrase", "n", "first"])

    return find


def phrases_in(texts: DataFrame, phrases: DataFrame, text: str, text_id: str, phrase: str, whole_words: bool = False) -> DataFrame:
    """(id, phrase, n, first): each phrase that occurs in a text, how often and at which character first.

    Occurrences may overlap. The distinct phrases, without null and empty ones, are dealt to parts of about
    ``PART_CHARS`` characters by a hash; a part is broadcast and becomes an Aho-Corasick automaton in
    each task, so the time for a text is linear in its length and its matches. The number of
    parts, not their size, grows with the dictionary. With ``whole_words`` an occurrence that splits a
    run of letters and digits at either end does not count. Null texts hold nothing.
    """
    spark = texts.sparkSession
    kind = dict(texts.dtypes)[text_id]
    words = materialise(phrases.select(F.col(phrase).alias("phrase")).where(F.col(phrase) != "").distinct(), "phrases")
    n_parts = -(-(words.agg(F.sum(F.length("phrase"))).first()[0] or 0) // PART_CHARS)
    given = texts.select(F.col(text_id).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    found = given.where("false").select("id", F.col("text").alias("phrase"), F.lit(0).alias("n"), F.lit(0).alias("first"))
    for k in range(n_parts):
        part = words.where(F.pmod(F.xxhash64("phrase"), F.lit(n_parts)) == k)
        held = spark.sparkContext.broadcast(sorted(r.phrase for r in part.collect()))  # about PART_CHARS characters
        found = found.unionByName(given.mapInArrow(_finder(held, whole_words), f"id {kind}, phrase string, n int, first int"))
    return found


#: The longest start of a phrase that chooses its key, and the least that one may have.
LONGEST, SHORTEST = 64, 8


def _span(chars: int) -> int:
    """Characters of a phrase's start that choose its key."""
    return min(LONGEST, chars // SHORTEST * SHORTEST)


def _least(text: str, span: int) -> np.ndarray:
    """For each run of ``span`` characters the least hash of its grams, salted by ``span``."""
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    if len(h) < span:
        return np.zeros(0, np.int64)
    gram, width = 16 if span >= 32 else 8, 1
    while width < gram:
        h = (h[:-width] * np.uint64(0x9E3779B97F4A7C15)) ^ h[width:]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        width *= 2
    size, width = span - gram + 1, 1
    while 2 * width <= size:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    if width < size:
        h = np.minimum(h[: len(h) - (size - width)], h[size - width :])
    return (h ^ np.uint64(span)).view(np.int64)


def grouped_phrases(texts: DataFrame, phrases: DataFrame, group: str, text: str, phrase: str) -> DataFrame:
    """The distinct (group, phrase) of which a text of the same group holds the phrase literally.

    ``phrases``: of SHORTEST characters or more; shorter ones raise. The dictionary may grow with the texts:
    a phrase's key is the least gram hash of its start, and a text gives the least gram hash of
    each of its runs of that length, so texts meet phrases by (group, key), and a text is then searched
    for the phrases that it met only.
    """
    kinds = dict(texts.dtypes)
    given = texts.select(F.col(group).alias("g"), F.col(text).alias("text")).where("g is not null and text is not null").withColumn("t", F.xxhash64("g", "text"))
    words = materialise(phrases.select(F.col(group).cast(kinds[group]).alias("g"), F.col(phrase).alias("phrase")).where("g is not null and phrase is not null").distinct(), "grouped-phrases")
    size = F.length("phrase")
    spans = sorted({r.span for r in words.select(F.least(F.lit(LONGEST), F.floor(size / SHORTEST) * SHORTEST).alias("span")).distinct().collect()})  # LONGEST / SHORTEST at most
    if spans and not spans[0]:
        raise ValueError(f"phrases must have {SHORTEST} characters or more")

    def of_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [int(_least(x[: _span(len(x))], _span(len(x)))[0]) for x in b["phrase"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["g"], b["phrase"], pa.array(keys, pa.int64())], names=["g", "phrase", "key"])

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                b = batch.slice(i, 256)
                keys = [np.unique(np.concatenate([_least(x.as_py(), s) for s in spans])) for x in b["text"]]
                owner = pa.array(np.repeat(np.arange(b.num_rows), [len(k) for k in keys]))
                yield pa.RecordBatch.from_arrays([b["g"].take(owner), b["t"].take(owner), pa.array(np.concatenate(keys))], names=["g", "t", "key"])

    if not spans:
        return words.select(F.col("g").alias(group), F.col("phrase").alias(phrase))
    asked = materialise(words.mapInArrow(of_phrases, f"g {kinds[group]}, phrase string, key long"), "grouped-keys")
    met = given.mapInArrow(of_texts, f"g {kinds[group]}, t long, key long").join(asked, ["g", "key"])
    met = materialise(met.groupBy("g", "t").agg(F.collect_set("phrase").alias("phrases")), "grouped-met")
    held = given.join(met, ["g", "t"]).select("g", F.explode(F.filter("phrases", lambda p: F.contains(F.col("text"), p))).alias("phrase"))
    return held.distinct().select(F.col("g").alias(group), F.col("phrase").alias(phrase))
