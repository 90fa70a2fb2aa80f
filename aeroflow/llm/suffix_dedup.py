"""Bytes of texts that lie in a long string occurring twice, by sorting suffixes across the cluster."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from aeroflow.llm.frames import table
from aeroflow.storage import materialise, new_path

#: Bytes of a gram whose hash chooses anchors, and bytes of text hashed at once.
GRAM = 8
PIECE = 1 << 22

#: Bytes of suffixes that a task sorts into one run, and suffixes of one row of a run.
RUN_BYTES = 24_000_000
ROW_SUFFIXES = 2048

_PLACE = (1 << 24) - 1
_ANCHORS = "h long, t binary, at int, low int, high int"
_ROWS = "bucket int, run string, row int, common array<int>, rest array<binary>, left array<binary>, n array<int>, ts array<binary>, ats array<int>"
_STARTS = "t binary, first int, last int"


def _window(length: int) -> int:
    """Places among which a string of ``length`` bytes has its anchor: all grams lie inside the string."""
    return max(1, min(length - GRAM + 1, length * 3 // 5))


def _grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the gram at each place."""
    n = len(data) - GRAM + 1
    g = np.zeros(n, np.uint64)
    for k in range(GRAM):
        g |= data[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    g *= np.uint64(0x9E3779B97F4A7C15)
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(32)
    return g


def _anchors(data: np.ndarray, length: int, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of the strings that begin at ``starts``: place, first and last string, hash of what follows.

    A string's anchor is the place of its least gram hash, the last of equals, so equal strings have
    it at the same distance from their start. Strings with the same anchor are neighbours.
    """
    window = _window(length)
    g = _grams(data)
    least = (g & ~np.uint64(_PLACE)) | (np.uint64(_PLACE) - np.arange(len(g), dtype=np.uint64))
    span = 1
    while 2 * span <= window:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < window:
        least = np.minimum(least[: len(least) - (window - span)], least[window - span :])
    place = (np.uint64(_PLACE) - (least[starts] & np.uint64(_PLACE))).astype(np.int64)
    edge = np.flatnonzero(np.diff(place)) + 1
    low, high = starts[np.r_[0, edge]], starts[np.r_[edge - 1, len(starts) - 1]]
    at = place[np.r_[0, edge]]
    shared = length - window + 1  # bytes from the anchor on that every string with it holds
    h = np.zeros(len(at), np.uint64)
    for k in (*range(0, shared - GRAM, GRAM), shared - GRAM):
        h = (h ^ g[at + k]) * np.uint64(0x100000001B3)
        h ^= h >> np.uint64(31)
    return at, low, high, h


def _pieces(sizes: list[int], length: int) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (text, from, to) with about ``PIECE`` bytes; parts of a long text share ``length`` - 1 bytes."""
    out, total = [], 0
    for i, size in enumerate(sizes):
        start = 0
        while size - start >= length:
            end = min(size, start + PIECE)
            out.append((i, start, end))
            total += end - start
            if total >= PIECE:
                yield out
                out, total = [], 0
            if end == size:
                break
            start = end - length + 1
    if out:
        yield out


def _find(length: int):
    names = pa.schema([("h", pa.int64()), ("t", pa.binary()), ("at", pa.int32()), ("low", pa.int32()), ("high", pa.int32())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = batch["bytes"], batch["t"]
            sizes = [len(x.as_buffer()) for x in texts]
            for parts in _pieces(sizes, length):
                data = np.frombuffer(b"".join(memoryview(texts[i].as_buffer())[a:b] for i, a, b in parts), np.uint8)
                begin = np.cumsum([0, *(b - a for _, a, b in parts)])
                starts = np.concatenate([np.arange(x, y - length + 1) for x, y in zip(begin, begin[1:], strict=False)])
                at, low, high, h = _anchors(data, length, starts)
                part = np.searchsorted(begin, at, "right") - 1
                shift = begin[part] - np.array([a for _, a, _ in parts])[part]
                owner = pa.array(np.array([i for i, _, _ in parts])[part])
                columns = [pa.array(h.view(np.int64)), keys.take(owner), *(pa.array((x - shift).astype(np.int32)) for x in (at, low, high))]
                yield from pa.Table.from_arrays(columns, schema=names).to_batches(max_chunksize=50_000)

    return find


def _common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings that agree in the first ``known`` bytes."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


def _runs(length: int, buckets: int):
    """Sorted, front-coded runs of the suffixes at anchors, cut by buckets."""
    shared = length - _window(length) + 1

    def rows(held: dict) -> Iterator[pa.RecordBatch]:
        run, out, taken = uuid.uuid4().hex[:16], None, 0
        schema = pa.schema([("bucket", pa.int32()), ("run", pa.string()), ("row", pa.int32()), ("common", pa.list_(pa.int32())), ("rest", pa.list_(pa.binary())), ("left", pa.list_(pa.binary())), ("n", pa.list_(pa.int32())), ("ts", pa.list_(pa.binary())), ("ats", pa.list_(pa.int32()))])
        full = lambda: pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(out, schema.types, strict=True)], schema=schema)
        before = b""
        for bucket, right, left in sorted(held):
            if out is None or out[0] != bucket or taken >= ROW_SUFFIXES:
                if out:
                    yield full()
                before = before if out and out[0] == bucket else b""
                out, taken = [bucket, run, out[2] + 1 if out and out[0] == bucket else 0, [], [], [], [], [], []], 0
            known = _common(before, right, 0)
            members = held[bucket, right, left]
            for column, value in zip(out[3:7], (known, right[known:], left, len(members)), strict=True):
                column.append(value)
            out[7].extend(m[0] for m in members)
            out[8].extend(m[1] for m in members)
            before, taken = right, taken + 1 + len(members)
        if out:
            yield full()

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in batches:
            for key, text, anchors in zip(batch["t"], batch["bytes"], batch["anchors"], strict=True):
                key, text, anchors = key.as_py(), text.as_py(), anchors.values
                for at, low, high in zip(*(np.asarray(anchors.field(x)).tolist() for x in ("at", "low", "high")), strict=True):
                    right, left = text[at : high + length], text[low:at][::-1]
                    entry = zlib.crc32(right[:shared]) % buckets, right, left
                    found = held.setdefault(entry, [])
                    size += 40 if found else len(right) + len(left) + 200
                    found.append((key, at))
                    if size > RUN_BYTES:
                        yield from rows(held)
                        held, size = {}, 0
        yield from rows(held)

    return sort


def _unpacked(blocks: list[dict]) -> Iterator[tuple[int, bytes, bytes, list]]:
    """The suffixes of one run: bytes in common with the one before, the suffix, what stands left of it, members."""
    before = b""
    for block in blocks:
        member = 0
        for known, rest, left, n in zip(block["common"], block["rest"], block["left"], block["n"], strict=True):
            before = before[:known] + rest
            yield known, before, left, list(zip(block["ts"][member : member + n], block["ats"][member : member + n], strict=True))
            member += n


def merged(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """Merge sorted runs of (common, key, ...) by a tree of losers; common is what a key shares with the key before.

    Each loser keeps the length that it has in common with the winner it lost to. Of two
    candidates the one with more in common with the last winner comes first, without a look at
    its bytes; only equal lengths are compared, from the first unknown byte on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    runs = [*runs, *(iter(()) for _ in range(k - len(runs)))]
    now = [next(r, None) for r in runs]
    common, loser = [0] * k, [0] * k

    def first(a: int, b: int) -> tuple[int, int]:
        if now[a] is None or now[b] is None:
            return (a, b) if now[b] is None else (b, a)
        if common[a] != common[b]:
            return (a, b) if common[a] > common[b] else (b, a)
        x, y = now[a][1], now[b][1]
        n = _common(x, y, common[a])
        a, b = (a, b) if n == len(x) or n < len(y) and x[n] < y[n] else (b, a)
        common[b] = n
        return a, b

    winners = [*([0] * k), *range(k)]
    for node in range(k - 1, 0, -1):
        winners[node], loser[node] = first(winners[2 * node], winners[2 * node + 1])
    best = winners[1] if k > 1 else 0
    while now[best] is not None:
        yield (common[best], *now[best][1:])
        now[best] = next(runs[best], None)
        common[best] = now[best][0] if now[best] else 0
        node = (best + k) // 2
        while node:
            best, loser[node] = first(best, loser[node])
            node //= 2


def _repeats(group: list[tuple], length: int, shared: int) -> Iterator[tuple[list, int, int]]:
    """Members of suffixes and the distances (from, to) to their left at which a repeated string starts.

    ``group``: suffixes in order that have ``shared`` bytes or more in common. The string that starts
    o bytes left of an anchor occurs twice if another suffix agrees with it in ``length`` - o bytes
    to the right and o bytes to the left. As o grows, fewer bytes must agree to the right and
    neighbours join into classes; in a class the longest agreement to the left is with a
    neighbour in the order by the bytes to the left.
    """
    distinct: list[list] = []  # bytes in common with the one before, length, left, members
    place: dict[bytes, int] = {}
    for common, right, left, members in group:
        if not (distinct and common == len(right) == distinct[-1][1]):
            place = {}
        if left in place:
            distinct[place[left]][3].extend(members)
        else:
            place[left] = len(distinct)
            distinct.append([common, len(right), left, list(members)])
    for _, size, left, members in distinct:
        if len(members) > 1:
            yield members, length - size, len(left)
    if len(distinct) < 2:
        return
    commons = np.array([0, *(x[0] for x in distinct[1:])])
    levels = sorted({*commons[1:].tolist()}, reverse=True)
    known: dict[tuple[int, int], list[int]] = {}
    for level, below in zip(levels, [*levels[1:], shared - 1], strict=True):
        edges = np.r_[np.flatnonzero(commons < level), len(distinct)]
        now: dict[tuple[int, int], list[int]] = {}
        for start, end in zip(edges.tolist(), edges[1:].tolist(), strict=False):
            if end - start < 2:
                continue
            longest = known.get((start, end))
            if longest is None:
                order = sorted(range(start, end), key=lambda i: distinct[i][2])
                longest = [0] * (end - start)
                for i, j in zip(order, order[1:], strict=False):
                    n = _common(distinct[i][2], distinct[j][2], 0)
                    longest[i - start] = max(longest[i - start], n)
                    longest[j - start] = max(longest[j - start], n)
            now[start, end] = longest
            for (_, size, left, members), most in zip(distinct[start:end], longest, strict=True):
                low, high = max(length - level, length - size), min(length - 1 - below, most, len(left))
                if low <= high and len(members) == 1:
                    yield members, low, high
        known = now


def _merge(length: int):
    shared = length - _window(length) + 1
    schema = pa.schema([("t", pa.binary()), ("first", pa.int32()), ("last", pa.int32())])

    def starts(blocks: list[dict]) -> Iterator[tuple[bytes, int, int]]:
        by_run: dict[str, list[dict]] = {}
        for block in blocks:
            by_run.setdefault(block["run"], []).append(block)
        group: list[tuple] = []
        for common, *suffix in merged([_unpacked(x) for x in by_run.values()]):
            if common < shared and group:
                for members, low, high in _repeats(group, length, shared):
                    yield from ((t, at - high, at - low) for t, at in members)
                group = []
            group.append((common, *suffix))
        for members, low, high in _repeats(group, length, shared):
            yield from ((t, at - high, at - low) for t, at in members)

    def batched(blocks: list[dict]) -> Iterator[pa.RecordBatch]:
        out = []
        for row in starts(blocks):
            out.append(row)
            if len(out) >= 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[dict] = []
        for batch in batches:
            for block in batch.to_pylist():
                if blocks and blocks[0]["bucket"] != block["bucket"]:
                    yield from batched(blocks)
                    blocks = []
                blocks.append(block)
        if blocks:
            yield from batched(blocks)

    return merge


def _cut(length: int):
    schema = pa.schema([("t", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text, found in zip(batch["t"], batch["bytes"], batch["starts"], strict=True):
                text, digest, end, removed, spans = text.as_buffer(), hashlib.sha256(), 0, 0, 0
                view = memoryview(text)
                ranges = np.stack([np.asarray(found.values.field(k)) for k in ("first", "last")], 1)
                for first, last in ranges[np.argsort(ranges[:, 0], kind="stable")].tolist():
                    if first > end or not spans:
                        digest.update(view[end:first])
                        spans, removed, end = spans + 1, removed + last + length - first, last + length
                    elif last + length > end:
                        removed, end = removed + last + length - end, last + length
                digest.update(view[end:])
                out.append((key.as_py(), removed, spans, digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 4, schema.types, strict=True)], schema=schema)

    return cut


def _by_text(texts: DataFrame, label: str) -> DataFrame:
    """A table in buckets by ``t``, so that later joins with it shuffle no text."""
    spark = texts.sparkSession
    name = f"{label}_{uuid.uuid4().hex[:12]}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts.write.format("parquet").bucketBy(n, "t").option("path", new_path(spark, label)).saveAsTable(name)
    return spark.table(name)


def repeated_bytes(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How many bytes of each text lie in a string of ``length`` bytes that also starts elsewhere, and what is left.

    Texts are UTF-8 bytes, null is empty; rows that repeat a text are places of their own. Returned:
    the id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 (of the bytes left).
    Ids may be null or repeated: each row gets a row. An empty table gives none.

    Of all suffixes those at anchors are sorted, places that any string of ``length`` bytes chooses by
    its own content, and of these only those whose first bytes (a fixed number, by hash) occur
    twice. Tasks sort them, join equal ones, and exchange front-coded runs by a hash of
    these first bytes, which suffixes that can match share; runs meet in trees of losers.
    Texts that occur twice as a whole are one text in all this.
    """
    spark = docs.sparkSession
    names = [f"c{i}" for i in range(len(docs.columns))]
    ident, text = (F.col(names[docs.columns.index(c)]) for c in (id_col, text_col))
    held = docs.toDF(*names).select(ident.alias("id"), F.coalesce(text.cast("string"), F.lit("")).cast("binary").alias("bytes"))
    held = held.withColumns({"sha": F.sha2("bytes", 256), "n_bytes": F.octet_length("bytes").cast("long")})
    texts = held.where(F.col("n_bytes") >= length).groupBy(F.substring(F.unhex("sha"), 1, 16).alias("t")).agg(F.first("bytes").alias("bytes"), F.count("*").alias("copies"))
    texts = _by_text(texts, "suffix_texts")
    anchors = materialise(texts.select("t", "bytes").mapInArrow(_find(length), _ANCHORS), "suffix-anchors")
    often = materialise(anchors.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "suffix-often")
    often = anchors.join(often, "h", "left_semi").groupBy("t").agg(F.collect_list(F.struct("at", "low", "high")).alias("anchors"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = texts.select("t", "bytes").join(often, "t").mapInArrow(_runs(length, buckets), _ROWS)
    runs = runs.repartition(buckets, "bucket").sortWithinPartitions("bucket", "run", "row")
    starts = runs.mapInArrow(_merge(length), _STARTS).groupBy("t").agg(F.collect_list(F.struct("first", "last")).alias("starts"))
    starts = materialise(starts, "suffix-starts")
    once = texts.where("copies = 1").select("t", "bytes").join(starts, "t")
    cut = once.mapInArrow(_cut(length), "t binary, n_removed long, n_spans long, kept_sha256 string")
    copied = texts.where("copies > 1").select("t", F.lit(None).cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(b""), 256).alias("kept_sha256"))
    found = materialise(cut.unionByName(copied), "suffix-cuts").withColumn("found", F.lit(True))
    rows = held.select("id", "n_bytes", "sha", F.substring(F.unhex("sha"), 1, 16).alias("t")).join(found, "t", "left")
    removed = F.when(F.col("found"), F.coalesce("n_removed", "n_bytes")).otherwise(0).alias("n_removed")
    return rows.select(F.col("id").alias(id_col), "n_bytes", removed, F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings of 400 bytes in all documents: n_bytes, n_removed, n_spans and kept_sha256 of each."""
    return repeated_bytes(table(spark, sf_dir, "documents"))
