"""Near-duplicate documents by SimHash, linked through deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from aeroflow.llm.frames import table
from aeroflow.operators.components import connected_components
from aeroflow.storage import materialise, scratch

SHINGLE_WORDS = 3
SEED = 42

#: Hashes whose bits are counted at once.
COUNT_AT_ONCE = 200_000


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text's word shingles; 0 without a word."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and white space is \x20 and \x09-\x0D
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE_WORDS)))) if len(words) >= SHINGLE_WORDS else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(x, SEED) for x in shingles), "<u8")
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), COUNT_AT_ONCE):
        part = hashes[start : start + COUNT_AT_ONCE]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, fp long) of every whole text: its hash and its fingerprint, whose bits are the long's."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x.as_py()) for x in b.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], names=["id", "h", "fp"])

    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, h long, fp long")


def signature_masks() -> list[int]:
    """The bits that each signature of a fingerprint keeps.

    Cut a fingerprint into two segments. If two fingerprints differ in at most 2 bits, then (a)
    one segment is equal and one of three parts of the other is, or (b) each segment differs in
    one bit. For (b) the first segment with one bit deleted is equal for the right choice of the
    bit, and one half of the second segment is equal. So such fingerprints share one of 3 + 3 +
    32 * 2 signatures, each of which fixes 42 bits or more.
    """
    low, high = (1 << 32) - 1, ((1 << 32) - 1) << 32
    thirds = [((1 << 11) - 1), ((1 << 11) - 1) << 11, ((1 << 10) - 1) << 22]
    halves = [(1 << 16) - 1, ((1 << 16) - 1) << 16]
    exact = [high | t for t in thirds] + [low | t << 32 for t in thirds]
    return exact + [high & ~(1 << i) | h for i in range(32, 64) for h in halves]


def _signatures(fps: np.ndarray) -> np.ndarray:
    """Hashed signatures, a row for each mask."""
    masks = np.array(signature_masks(), np.uint64)[:, None]
    with np.errstate(over="ignore"):
        x = (fps[None, :] & masks) + np.arange(1, len(masks) + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(31)


def _bit_count(x: np.ndarray) -> np.ndarray:
    return np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=1)


#: Runs up to this length are compared pair by pair; longer ones probe for each flip of bits.
PAIRWISE = 64


def _close_in_run(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among distinct fingerprints that share a signature and so vary in 22 bits at most.

    Each fingerprint is looked up with each one or two of the varying bits flipped, so the work
    grows with the run's length and not with its square.
    """
    fps = np.sort(fps)
    varying = int(np.bitwise_or.reduce(fps ^ fps[0]))
    bits = [1 << i for i in range(64) if varying >> i & 1]
    flips = bits + ([a | b for i, a in enumerate(bits) for b in bits[:i]] if max_bits > 1 else [])
    left, right = [], []
    for flip in flips:
        other = fps ^ np.uint64(flip)
        at = np.searchsorted(fps, other)
        found = (fps[np.minimum(at, len(fps) - 1)] == other) & (fps < other)
        left.append(fps[found])
        right.append(other[found])
    return np.concatenate(left), np.concatenate(right)


def _close(keys: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints that share a key; equal keys stand together."""
    begins = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    lengths = np.diff(np.r_[begins, len(keys)])
    left, right = [], []
    short = np.repeat(lengths <= PAIRWISE, lengths)
    k, f = keys[short], fps[short]
    for step in range(1, int(lengths[lengths <= PAIRWISE].max(initial=1))):
        same = np.flatnonzero(k[step:] == k[:-step])
        if not len(same):
            break
        a, b = f[same], f[same + step]
        near = (_bit_count(a ^ b) <= max_bits) & (a != b)
        left.append(a[near])
        right.append(b[near])
    for begin, length in zip(begins[lengths > PAIRWISE], lengths[lengths > PAIRWISE]):
        a, b = _close_in_run(fps[begin : begin + length], max_bits)
        left.append(a)
        right.append(b)
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """All pairs (src, dst) of distinct fingerprints that differ in at most ``max_bits`` <= 2 bits.

    ``fps``: one column ``fp`` without repeats. Fingerprints are dealt out by signature, sorted,
    and compared where signatures are equal. At most 2^22 fingerprints can share a signature, as
    it leaves no more bits open, so a run always fits a task.
    """
    if not 1 <= max_bits <= 2:
        raise ValueError("the signatures cover differences of up to 2 bits")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for keys in _signatures(x):
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), b.column(0)], names=["key", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            if not len(keys):
                continue
            held.append((keys, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            if keys[0] == keys[-1] and (len(held) == 1 or held[0][0][0] == keys[0]):
                continue  # the run goes on
            k, f = (np.concatenate(x) for x in zip(*held))
            whole = int(np.searchsorted(k, k[-1]))  # rows before the last run
            held = [(k[whole:], f[whole:])]
            yield _pairs(*_close(k[:whole], f[:whole], max_bits))
        if held:
            yield _pairs(*_close(*(np.concatenate(x) for x in zip(*held)), max_bits))

    signed = fps.select("fp").mapInArrow(sign, "key long, fp long").repartition("key").sortWithinPartitions("key")
    return signed.mapInArrow(compare, "src long, dst long").distinct()


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    a, b = a.view(np.int64), b.view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["src", "dst"])


def _groups(docs: DataFrame, max_bits: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, h, fp) of every row, and (fp, root) of every distinct fingerprint."""
    marked = materialise(fingerprints(docs, id_col, text_col), "simhash")
    distinct = materialise(marked.select("fp").distinct(), "simhash-distinct")
    labels = connected_components(links(distinct, max_bits)).withColumnRenamed("node", "fp")
    return marked, distinct.join(labels, "fp", "left").select("fp", F.coalesce("component", "fp").alias("root"))


def near_duplicates(docs: DataFrame, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group documents whose fingerprints are linked, directly or through others.

    Returns one row per input row: the id column, ``fp`` and ``component_id``, the smallest id
    reachable over links, the document's own included. Equal fingerprints are linked, so copies
    meet in one pre-aggregated row before the comparison. A null, empty or blank text has
    fingerprint zero and is linked like any other. Null ids are kept; a component without any id
    gets null. Repeated ids and rows pass through; an empty table gives no rows; further columns
    are left out.
    """
    marked, roots = _groups(docs, max_bits, id_col, text_col)
    first = marked.groupBy("fp").agg(F.min("id").alias("first"))
    smallest = materialise(first.join(roots, "fp").groupBy("root").agg(F.min("first").alias("component_id")), "simhash-components")
    return marked.join(roots.join(smallest, "root").select("fp", "component_id"), "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def deduplicated(docs: DataFrame, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near duplicates, with all its columns.

    The row with the smallest id stays (null last), of rows with that id the one with the smallest
    hash of the text. Rows are told apart by id and text, so different texts under one id or
    without an id are judged on their own. Of rows that agree in both, one stays: the first by the
    other columns. An empty table gives no rows.

    Only keys of rows to drop are joined to the texts: broadcast while they are few, shuffled with
    them beyond the session's broadcast size.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    held = docs.toDF(*names)
    own, text = (names[docs.columns.index(x)] for x in (id_col, text_col))
    with scratch(docs.sparkSession) as keep:
        marked, roots = _groups(held, max_bits, own, text)
        order = F.struct(F.col("id").isNull().alias("none"), "id", "h")
        classes = marked.groupBy("id", "h", "fp").agg(F.count("*").alias("n")).join(roots, "fp")
        classes = materialise(classes.select("root", "n", order.alias("doc")), "simhash-classes")
        firsts = classes.groupBy("root").agg(F.min("doc").alias("first"))
        judged = classes.join(firsts, "root").select(F.col("doc.id").alias("k"), F.col("doc.h").alias("kh"), "n", F.col("doc").eqNullSafe(F.col("first")).alias("stays"))
        judged = keep(materialise(judged.where("not stays or n > 1"), "simhash-judged"))
    here = F.col(own).eqNullSafe(F.col("k")) & (F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))) == F.col("kh"))
    single = held.join(judged.select("k", "kh"), here, "left_anti")
    copies = held.join(judged.where("stays").select("k", "kh"), here)
    sortable = [F.col(c) for c, t in copies.dtypes if c in names and not any(x in t for x in ("map<", "variant", "interval"))]
    one = copies.withColumn("n", F.row_number().over(Window.partitionBy("k", "kh").orderBy(*sortable))).where("n = 1")
    return single.unionByName(one.select(*names)).toDF(*docs.columns)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every whole text and the smallest doc_id that its links reach."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
