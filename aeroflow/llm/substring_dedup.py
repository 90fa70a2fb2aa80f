"""Passages that repeat across documents: paragraph MinHash banding and anchored windows.

Paragraphs (lines of MIN_PARAGRAPH words or more, and runs of shorter lines up to a blank or a long
line that have as many together) are banded by MinHash over five-word shingles;
paragraphs that collide are compared by exact Jaccard similarity and clustered by components. A
passage set into the middle of other paragraphs shares no paragraph, so each text also gives
windows of WINDOW words at anchors that its content sets (winnowing); equal windows repeat. Any
passage of WINDOW + ANCHOR - 1 = 49 words or more that two texts share word by word holds a
window that both give. The windows at the ends of a repeat are then extended, word by word, as
far as their texts agree; by the choice of anchors that is less than ANCHOR words.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from aeroflow.llm.frames import table
from aeroflow.operators.components import connected_components
from aeroflow.storage import materialise, release, scratch

SHINGLE = 5
WINDOW = 25
ANCHOR = 25
MIN_PARAGRAPH = 50
SIMILARITY = 0.8

#: A paragraph has BANDS keys of ROWS minima each: a pair of similarity 0.8 shares a key with
#: probability 1 - (1 - 0.8^2)^6 = 0.998, one of 0.9 with 0.99995.
BANDS, ROWS = 6, 2

#: Members of a band's bucket that are dealt out together, about.
BLOCK = 2048

#: Bytes of texts whose words are hashed together, about: many short texts cost no more calls than one.
TOGETHER = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_ODD = [np.uint64(int.from_bytes(xxhash.xxh64_digest(b"m%d" % i), "big") | 1) for i in range(BANDS * ROWS)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of the base and of its inverse, grown as longer texts come."""

    def __init__(self):
        self.forth = self.back = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.forth) <= n:
            size = max(2 * n, 1 << 14)
            with np.errstate(over="ignore"):
                self.forth, self.back = (np.cumprod(np.r_[np.uint64(1), np.full(size, x)].astype(np.uint64)) for x in (_BASE, _INVERSE))
        return self.forth[: n + 1], self.back[: n + 1]


_POWERS = _Powers()


class _Hashes:
    """Hashes of the words of some texts, one text after the other, and of any run of them.

    ``bounds``: the words before each text, and all. ``lines``: the words before each line, and
    all; a blank line stands between texts.
    """

    def __init__(self, texts: Iterable[str]):
        parts = [text.encode() for text in texts]
        chars = np.frombuffer(b"\n\n".join(parts).lower(), np.uint8)
        solid = (chars != 32) & (chars - np.uint8(9) > 4)
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        at = np.flatnonzero(first)
        n = len(at)
        body = chars[solid]
        offsets = np.append(np.flatnonzero(first[solid]), len(body)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(body)]).dictionary_encode()
        told = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_numpy(zero_copy_only=False)), np.uint64, len(coded.dictionary))
        self.words = told[coded.indices.to_numpy()]
        self.lines = np.concatenate([[0], np.searchsorted(at, np.flatnonzero(chars == 10)), [n]])
        begins = np.cumsum([0, *(len(part) + 2 for part in parts)])[:-1]
        self.bounds = np.append(np.searchsorted(at, begins), n)
        forth, self.back = _POWERS.upto(n)
        self.sums = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(self.words * forth[:-1], out=self.sums[1:])

    def runs(self, starts: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mix((self.sums[starts + length] - self.sums[starts]) * self.back[starts])

    def shingles(self) -> np.ndarray:
        """Hashes of all runs of SHINGLE words, those that go on in the next text included."""
        n = max(0, len(self.words) - SHINGLE + 1)
        with np.errstate(over="ignore"):
            return _mix((self.sums[SHINGLE:] - self.sums[:n]) * self.back[:n]) if n else np.zeros(0, np.uint64)


def _over_windows(x: np.ndarray, size: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` (minimum or maximum) of each ``size`` neighbours, by doubling."""
    width = 1
    while 2 * width <= size:
        x = pick(x[:-width], x[width:])
        width *= 2
    return pick(x[: len(x) - (size - width)], x[size - width :]) if size > width else x


def anchors(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Places that hold the least hash of some ANCHOR neighbouring places of their text."""
    sizes = np.diff(bounds)
    span = ANCHOR + SHINGLE - 1  # words
    few = np.flatnonzero((sizes >= SHINGLE) & (sizes <= span))
    found = [bounds[few] + np.fromiter((shingles[i : j - SHINGLE + 1].argmin() for i, j in zip(bounds[few], bounds[few + 1], strict=True)), np.int64, len(few))]
    if len(shingles) >= ANCHOR:
        least = _over_windows(shingles, ANCHOR, np.minimum)
        whole = np.repeat(np.where(sizes > span, bounds[1:], 0), sizes) - np.arange(bounds[-1]) >= span
        least[~whole[: len(least)]] = 0
        none = np.zeros(ANCHOR - 1, np.uint64)  # a place is such if the largest of its windows' minima is its own hash
        found.append(np.flatnonzero(_over_windows(np.concatenate([none, least, none]), ANCHOR, np.maximum) == shingles))
    return np.sort(np.concatenate(found))


def signatures(shingles: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """BANDS keys, a row for each paragraph with the shingles from a start up to an end."""
    bounds = np.stack([starts, ends], axis=1).ravel()
    padded = np.append(shingles, np.uint64(0))  # so that an end may be that of the text
    least = np.empty((BANDS * ROWS, len(starts)), np.uint64)
    with np.errstate(over="ignore"):
        for i, odd in enumerate(_ODD):
            least[i] = np.minimum.reduceat(padded * odd, bounds)[::2]
        least = least.reshape(BANDS, ROWS, -1)
        return _mix(_mix(least[:, 0]) * _BASE + _mix(least[:, 1] + _BASE) + np.arange(BANDS, dtype=np.uint64)[:, None]).T


def _paragraphs(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the paragraphs, from those of the lines."""
    long = sizes >= MIN_PARAGRAPH
    short = np.zeros(len(sizes) + 2, np.int8)
    short[1:-1] = (sizes > 0) & ~long
    steps = np.diff(short)
    first, after = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
    together = starts[after - 1] + sizes[after - 1] - starts[first]
    wrapped = together >= MIN_PARAGRAPH
    return np.concatenate([starts[long], starts[first[wrapped]]]), np.concatenate([sizes[long], together[wrapped]])


@dataclass
class Units:
    """What texts are looked up by: windows, and paragraphs with their band keys.

    Arrays hold one text after the other; ``windows`` and ``paragraphs`` count each text's.
    """

    windows: np.ndarray
    window_keys: np.ndarray
    window_starts: np.ndarray
    paragraphs: np.ndarray
    keys: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    bands: np.ndarray


def units(*texts: str) -> Units:
    """The windows and paragraphs of some texts."""
    hashes = _Hashes(texts)
    bounds, shingles = hashes.bounds, hashes.shingles()

    def owner(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        of = np.searchsorted(bounds, at, side="right") - 1
        return of, np.bincount(of, minlength=len(texts))

    at = anchors(shingles, bounds)
    of, _ = owner(at)
    inside = at + WINDOW <= bounds[of + 1]
    at, of = at[inside], of[inside]
    starts, sizes = _paragraphs(hashes.lines[:-1], np.diff(hashes.lines))
    order = np.argsort(starts)
    starts, sizes = starts[order], sizes[order]
    home, paragraphs = owner(starts)
    keys = _mix(hashes.runs(starts, sizes) + np.uint64(1))
    bands = signatures(shingles, starts, starts + sizes - SHINGLE + 1) if len(starts) else np.zeros((0, BANDS), np.uint64)
    return Units(np.bincount(of, minlength=len(texts)), hashes.runs(at, WINDOW), at - bounds[of], paragraphs, keys, starts - bounds[home], sizes, bands)


_UNITS = "id {id}, h long, w_keys array<long>, w_starts array<int>, p_keys array<long>, p_starts array<int>, p_sizes array<int>, bands array<array<long>>"


def _kind(docs: DataFrame) -> str:
    return docs.schema["id"].dataType.simpleString()


def _lists(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), values)


def _together(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Groups of texts of about TOGETHER bytes, with the place of the first; a longer text is a group."""
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
    i = 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + TOGETHER, side="right")))
        yield i, column.slice(i, j - i).to_pylist()
        i = j


def _all_units(docs: DataFrame) -> DataFrame:
    """A row of arrays for each text that has a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, texts in _together(b.column(2)):
                u = units(*texts)
                row = b.slice(i, len(texts))
                bands = _lists(np.full(len(u.keys), BANDS), pa.array(np.ascontiguousarray(u.bands).view(np.int64).ravel()))
                lists = [
                    _lists(u.windows, pa.array(u.window_keys.view(np.int64))),
                    _lists(u.windows, pa.array(u.window_starts.astype(np.int32))),
                    _lists(u.paragraphs, pa.array(u.keys.view(np.int64))),
                    _lists(u.paragraphs, pa.array(u.starts.astype(np.int32))),
                    _lists(u.paragraphs, pa.array(u.sizes.astype(np.int32))),
                    _lists(u.paragraphs, bands),
                ]
                told = pa.RecordBatch.from_arrays([row.column(0), row.column(1), *lists], names=["id", "h", "w_keys", "w_starts", "p_keys", "p_starts", "p_sizes", "bands"])
                yield told.filter(pa.array(u.windows + u.paragraphs > 0))

    return docs.mapInArrow(run, _UNITS.format(id=_kind(docs)))


def _shingle_sets(docs: DataFrame) -> DataFrame:
    """(key, shingles): the distinct 64-bit shingle hashes, sorted, of the paragraphs at ``places``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bounds, places = b.column(1).offsets.to_numpy(), b.column(1).values
            starts, sizes = places.field("start").to_numpy(), places.field("n").to_numpy()
            sets = []
            for i, texts in _together(b.column(0)):
                hashes = _Hashes(texts)
                shingles = hashes.shingles()
                told = slice(bounds[i], bounds[i + len(texts)])
                first = starts[told] + np.repeat(hashes.bounds[:-1], np.diff(bounds[i : i + len(texts) + 1]))
                for x, y in zip(first.tolist(), (first + sizes[told] - SHINGLE + 1).tolist(), strict=True):
                    members = np.sort(shingles[x:y])
                    sets.append(members[np.append(True, members[1:] != members[:-1])].tobytes())
            keys = places.field("key").slice(bounds[0], bounds[-1] - bounds[0])
            yield pa.RecordBatch.from_arrays([keys, pa.array(sets, pa.binary())], names=["key", "shingles"])

    return docs.select("text", "places").mapInArrow(run, "key long, shingles binary")


class _Sets:
    """Sets so far, by their shingles."""

    def __init__(self):
        self.sizes, self.index = array("q"), {}

    def add(self, members: list[int]) -> None:
        for s in members:
            self.index.setdefault(s, array("I")).append(len(self.sizes))
        self.sizes.append(len(members))

    def alike(self, members: list[int]) -> list[int]:
        """The places of the sets that are similar to one."""
        postings = [self.index[s] for s in members if s in self.index]
        if not postings:
            return []
        common = np.bincount(np.frombuffer(b"".join(postings), np.uintc))
        whole = len(members) + np.frombuffer(self.sizes, np.int64)[: len(common)] - common
        return np.flatnonzero((common > 0) & (common >= SIMILARITY * whole)).tolist()


class _Bucket:
    """The paragraphs of a bucket so far: leaders, the others, and their groups."""

    def __init__(self):
        self.leaders: list[int] = []
        self.sets, self.told = _Sets(), _Sets()  # of leaders, of others
        self.group: list[int] = []  # of each leader, by union-find
        self.others: list[tuple[int, bytes, int]] = []  # with their leader
        self.led: set[int] = set()  # groups of the others

    def _find(self, i: int) -> int:
        while self.group[i] != i:
            self.group[i] = i = self.group[self.group[i]]
        return i

    def add(self, key: int, raw: bytes) -> list[int]:
        """Earlier keys that link a paragraph to all groups with a member similar to it."""
        members = np.frombuffer(raw, "<u8").tolist()
        alike = self.sets.alike(members)
        out = [self.leaders[i] for i in alike]
        leader = alike[0] if alike else len(self.leaders)
        if not alike:
            self.sets.add(members)
            self.leaders.append(key)
            self.group.append(leader)
        for i in alike[1:]:
            self.group[self._find(i)] = self._find(leader)
        own = self._find(leader)
        self.led = {self._find(i) for i in self.led}
        if self.led - {own}:  # others are indexed once there is a group that needs them
            for _, earlier, _ in self.others[len(self.told.sizes) :]:
                self.told.add(np.frombuffer(earlier, "<u8").tolist())
            for place in self.told.alike(members):
                earlier, _, i = self.others[place]
                if (i := self._find(i)) != own:
                    out.append(earlier)
                    self.group[i] = own
        if alike:
            self.others.append((key, raw, leader))
            self.led.add(own)
        return out


class _Pair:
    """A bucket of two paragraphs: one comparison, no lists."""

    def __init__(self):
        self.first: tuple[int, np.ndarray] | None = None

    def add(self, key: int, raw: bytes) -> list[int]:
        members = np.frombuffer(raw, "<u8")
        if self.first is None:
            self.first = key, members
            return []
        earlier, theirs = self.first
        common = len(np.intersect1d(members, theirs, assume_unique=True))
        return [earlier] if common >= SIMILARITY * (len(members) + len(theirs) - common) else []


def similar_paragraphs(kept: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Links (src, dst) between paragraph keys whose shingle sets have Jaccard similarity >= 0.8.

    ``kept``: id, h, text. ``paragraphs``: id, h, doc (a hash of both), key, start, n, bands. Equal paragraphs meet in one
    row before anything is compared, and one text gives the shingles of each. A bucket of equal
    band keys is dealt in blocks of about BLOCK members, once for all bands that hold the same keys; each pair of blocks of a bucket is a task's
    group, so no group is larger than two blocks and no pair of members is left out. In a group
    the paragraphs come by number of copies and are compared with the leaders so far; one that is
    similar to none becomes a leader. A paragraph is also compared with the other members, except
    those that it is already linked to through leaders. So the links of a group join all of its
    similar pairs, directly or through others, though many near copies take one pass.
    """
    bands = [F.min(F.col("bands")[i]).alias(f"b{i}") for i in range(BANDS)]  # the same in all rows of a key
    distinct = materialise(paragraphs.groupBy("key").agg(F.count("*").alias("copies"), F.min("doc").alias("doc"), *bands), "dedup-paragraphs")
    banded = distinct.select("key", "copies", F.explode(F.array(*(f"b{i}" for i in range(BANDS)))).alias("band"))
    own = [F.bit_xor(F.xxhash64("key", F.lit(i))).alias(f"x{i}") for i in range(2)]
    buckets = banded.groupBy("band").agg(F.count("*").alias("members"), *own).where("members > 1")
    buckets = buckets.groupBy("members", "x0", "x1").agg(F.min("band").alias("band"))  # bands that hold the same keys are one bucket
    members = materialise(banded.join(buckets.select("band", "members"), "band"), "dedup-members")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "h", "start", "n")
    told = distinct.join(members.select("key").distinct(), "key", "left_semi").select("key", "doc")
    wanted = paragraphs.join(told, ["key", "doc"], "left_semi").groupBy("key").agg(F.min(place).alias("place"))  # one text for all copies
    wanted = wanted.select("place.id", "place.h", F.struct("key", "place.start", "place.n").alias("p"))
    wanted = wanted.groupBy("id", "h").agg(F.collect_list("p").alias("places")).select(F.col("id").alias("_id"), F.col("h").alias("_h"), "places")
    asked = materialise(wanted, "dedup-asked")
    texts = kept.join(asked, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")))
    sets = _shingle_sets(texts).groupBy("key").agg(F.first("shingles").alias("shingles"))  # rows may repeat an id and a text
    sets = materialise(sets, "dedup-sets")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("key"), blocks).cast("int")
    met = members.select("key", "copies", "band", "members", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    met = met.select("key", "copies", "band", (F.col("members") == 2).alias("pair"), F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    group = ["band", "low", "high"]
    dealt = met.join(sets, "key").repartition(*group).sortWithinPartitions(*group, F.desc("copies"), "key").select(*group, "key", "shingles", "pair")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, bucket = None, _Bucket()
        for b in batches:
            left, right = [], []
            for *own, key, raw, pair in zip(*(c.to_pylist() for c in b.columns)):
                if own != last:
                    last, bucket = own, _Pair() if pair else _Bucket()
                found = bucket.add(key, raw)
                left += found
                right += [key] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["src", "dst"])

    links = materialise(dealt.mapInArrow(run, "src long, dst long").distinct(), "dedup-links")
    release(distinct, members, asked, sets)
    return links


_CONTEXTS = "id {id}, h long, start int, left boolean, first_id {id}, keys array<long>"


def _contexts(docs: DataFrame) -> DataFrame:
    """For each place (start, left, cluster, first_id) of a text, keys of the 1, 2, ... ANCHOR - 1
    words before (``left``) or after the window there; keys are equal if window and words are.
    """

    steps = np.arange(1, ANCHOR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bounds, places = b.column(3).offsets.to_numpy(), b.column(3).values
            places = places.slice(bounds[0], bounds[-1] - bounds[0])
            bounds = bounds - bounds[0]
            starts, clusters = places.field("start").to_numpy(), places.field("cluster").to_numpy().view(np.uint64)
            lefts = places.field("left").to_numpy(zero_copy_only=False)
            sizes, keys = [], [np.zeros(0, np.int64)]
            for row, texts in _together(b.column(2)):
                hashes = _Hashes(texts)
                i, j = bounds[row], bounds[row + len(texts)]
                begin, upto = (np.repeat(x, np.diff(bounds[row : row + len(texts) + 1]))[:, None] for x in (hashes.bounds[:-1], hashes.bounds[1:]))
                start, left = starts[i:j, None] + begin, lefts[i:j, None]
                room = np.minimum(ANCHOR - 1, np.where(left, start - begin, upto - start - WINDOW))
                told = steps <= room
                at, length = np.where(left, start - steps, start + WINDOW)[told], np.broadcast_to(steps, told.shape)[told]
                with np.errstate(over="ignore"):
                    salts = _mix((clusters[i:j, None] + _BASE * (2 * steps + left).astype(np.uint64))[told])
                sizes.append(told.sum(axis=1))
                keys.append(_mix(hashes.runs(at, length) ^ salts).view(np.int64))
            ends = np.concatenate([[0], *sizes]).cumsum().astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))
            owner = pa.array(np.repeat(np.arange(b.num_rows), np.diff(bounds)))
            columns = [b.column(0).take(owner), b.column(1).take(owner), *(places.field(k) for k in ("start", "left", "first_id")), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "h", "start", "left", "first_id", "keys"])

    return docs.mapInArrow(run, _CONTEXTS.format(id=_kind(docs)))


def _sides(windows: Column) -> Column:
    """Both sides of each of a text's sorted windows, with the cluster and distance of the window
    that touches it there; without one the side is an end.
    """

    def sides(s: Column, i: Column) -> Column:
        before, after = F.get(windows, i - 1), F.get(windows, i + 1)

        def side(left: bool, other: Column, touches: Column, gap: Column) -> Column:
            place = [s["cluster"].alias("cluster"), F.lit(left).alias("left"), s["start"].alias("start"), s["first_id"].alias("first_id")]
            return F.struct(*place, F.when(touches, other["cluster"]).alias("other"), F.when(touches, gap).alias("gap"))

        return F.array(side(True, before, before["end"] >= s["start"], s["start"] - before["start"]), side(False, after, after["start"] <= s["end"], after["start"] - s["start"]))

    return F.flatten(F.transform(windows, sides))


def _extensions(kept: DataFrame, by_doc: DataFrame) -> DataFrame:
    """(id, h, more): spans beside the windows at the ends of repeats, up to where texts differ.

    ``kept``: id, h, text. ``by_doc``: id, h, spans. A word beside a window is repeated if another
    text has the same window with the same words up to there, and goes if an earlier text has.
    Keys are counted for all lengths, so no pair of texts is compared. Where another window touches
    on the same side, all texts with both windows at that distance are alike up to the other one's
    start, and no end of that window agrees with them so far (else it had the other window); so
    the first of these texts stands for them.
    """
    windows = F.filter("spans", lambda s: s["end"] - s["start"] == WINDOW)
    split = by_doc.select("id", "h", windows.alias("w"), F.filter(windows, lambda s: s["removed"]).alias("r"))
    split = materialise(split, "dedup-windows")  # else the filters run anew for each window
    open_sides = [F.filter(_sides(F.col(c)), lambda s: s["other"].isNull()) for c in ("w", "r")]  # places told twice meet below
    ends = materialise(split.select("id", "h", F.explode(F.concat(*open_sides)).alias("s")).select("id", "h", "s.*").drop("other", "gap"), "dedup-ends")
    inner = split.select("id", "h", F.explode(F.filter(_sides(F.col("w")), lambda s: s["other"].isNotNull())).alias("s")).select("id", "h", "s.*")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "h")
    first = materialise(inner.groupBy("cluster", "left", "other", "gap").agg(F.min(F.struct(order.alias("doc"), "start", "first_id")).alias("m")), "dedup-inner")
    first = first.join(ends.select("cluster", "left").distinct(), ["cluster", "left"], "left_semi")
    first = first.select("m.doc.id", "m.doc.h", "cluster", "left", "m.start", "m.first_id")
    places = ends.unionByName(first).groupBy("id", "h").agg(F.collect_set(F.struct("start", "left", "cluster", "first_id")).alias("places"))
    places = materialise(places.select(F.col("id").alias("_id"), F.col("h").alias("_h"), "places"), "dedup-beside")
    found = materialise(_contexts(kept.join(places, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))).select("id", "h", "text", "places")), "dedup-contexts")
    levels = found.select("id", "h", "start", "left", "first_id", F.posexplode("keys").alias("n", "key"))
    met = levels.groupBy("key").agg(F.min(order).alias("a"), F.max(order).alias("b")).where("a <> b").select("key", "a")
    met = materialise(met, "dedup-met")
    longest = levels.join(met, "key").groupBy("id", "h", "start", "left").agg(F.max(F.col("n") + 1).alias("all"), F.coalesce(F.max(F.when(F.col("a") != order, F.col("n") + 1)), F.lit(0)).alias("gone"), F.min("first_id").alias("first_id"))

    def span(size: str, first: str, removed: bool) -> Column:
        end = F.col("start") + WINDOW
        start = F.when(F.col("left"), F.col("start") - F.col(size)).otherwise(end)
        return F.struct(start.alias("start"), F.when(F.col("left"), F.col("start")).otherwise(end + F.col(size)).alias("end"), F.col(first).alias("first_id"), F.lit(removed).alias("removed"))

    spans = F.array(F.when(F.col("gone") > 0, span("gone", "first_id", True)), F.when(F.col("all") > F.col("gone"), span("all", "id", False)))
    return longest.select("id", "h", F.explode(spans).alias("span")).where("span is not null").groupBy("id", "h").agg(F.collect_list("span").alias("more"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that share a passage with another, with the word spans that repeat.

    Returns one row per such document: ``id``, ``h`` (hash of the text), ``class_id`` (the
    smallest id of the documents that it reaches over shared passages), ``n_words`` repeated,
    ``n_removed`` words, and ``spans`` array<struct<start, end, first_id, removed>> of word
    places: spans neither overlap nor touch unless they differ in ``removed``. The first document
    of a passage, by id (null last) and then by hash, keeps it; the others have it removed. A
    repeated run goes to its last word on both sides.

    Words are the maximal runs without the six ASCII white-space characters, A-Z lower-cased.
    Rows that agree in id and text are one document; equal texts of different ids repeat wholly.
    Passages that repeat only inside one document are left alone; null, empty and short texts
    repeat nothing; an empty table gives no rows; further columns are left out.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    found = materialise(_all_units(kept), "dedup-units")
    doc = F.xxhash64("id", "h").alias("doc")
    # one struct for each row: a row that carried its text's arrays would make long texts quadratic
    paragraphs = found.select("id", "h", doc, F.explode(F.arrays_zip("p_keys", "p_starts", "p_sizes", "bands")).alias("u"))
    paragraphs = paragraphs.select("id", "h", "doc", F.col("u.p_keys").alias("key"), F.col("u.p_starts").alias("start"), F.col("u.p_sizes").alias("n"), "u.bands")
    windows = found.select("id", "h", doc, F.explode(F.arrays_zip("w_keys", "w_starts")).alias("u"))
    windows = windows.select("id", "h", "doc", F.col("u.w_keys").alias("key"), F.col("u.w_starts").alias("start"), F.lit(WINDOW).alias("n"))
    both = windows.unionByName(paragraphs.drop("bands"))
    twice = both.groupBy("key").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a <> b").select("key")
    labels = connected_components(similar_paragraphs(kept, paragraphs))
    cluster = materialise(twice.join(labels.withColumnRenamed("node", "key"), "key", "full").select("key", F.coalesce("component", "key").alias("cluster")), "dedup-clusters")
    places = materialise(both.join(cluster, "key").select("cluster", "id", "h", "start", "n"), "dedup-places")
    release(found)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "h")
    firsts = places.groupBy("cluster").agg(F.min(order).alias("first"), F.max(order).alias("last")).where("first <> last").select("cluster", "first")
    firsts = materialise(firsts, "dedup-firsts")  # so the join below only shuffles, and a frequent passage's places can be split
    spans = places.join(firsts, "cluster").select(
        "id", "h", F.struct("start", (F.col("start") + F.col("n")).alias("end"), F.col("first.id").alias("first_id"), (~(F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.h") == F.col("h")))).alias("removed"), "cluster").alias("span")
    )
    by_doc = materialise(spans.groupBy("id", "h").agg(F.array_sort(F.collect_set("span")).alias("spans")), "dedup-spans")
    release(cluster, places, firsts)
    links = by_doc.select("id", F.explode("spans").alias("s")).select(F.col("id").alias("src"), F.col("s.first_id").alias("dst")).distinct()
    classes = connected_components(links)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bounds, told = b.column(2).offsets.tolist(), b.column(2).values
            every = list(zip(*(told.field(k).to_pylist() for k in ("start", "end", "first_id")), strict=True))
            leaves = told.field("removed").to_pylist()
            out, ends, words, removed = [], [0], [], []
            for i, j in zip(bounds, bounds[1:], strict=False):
                gone = _merged([s for s, x in zip(every[i:j], leaves[i:j], strict=True) if x])
                rest = _without(_merged([s for s, x in zip(every[i:j], leaves[i:j], strict=True) if not x]), gone)
                out += sorted([(*s, True) for s in gone] + [(*s, False) for s in rest], key=itemgetter(0))
                ends.append(len(out))
                removed.append(sum(s[1] - s[0] for s in gone))
                words.append(removed[-1] + sum(s[1] - s[0] for s in rest))
            columns = zip(*out, strict=True) if out else [[]] * 4
            types = [pa.int32(), pa.int32(), b.column(0).type, pa.bool_()]
            spans = pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], ["start", "end", "first_id", "removed"])
            spans = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), spans], names=["id", "h", "n_words", "n_removed", "spans"])

    more = _extensions(kept, by_doc).select(F.col("id").alias("_id"), F.col("h").alias("_h"), "more")
    plain = F.transform("spans", lambda s: s.dropFields("cluster"))
    by_doc = by_doc.join(more, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    by_doc = by_doc.select("id", "h", F.when(F.col("more").isNull(), plain).otherwise(F.concat(plain, "more")).alias("spans"))
    merged = by_doc.mapInArrow(merge, "id {id}, h long, n_words long, n_removed long, spans array<struct<start int, end int, first_id {id}, removed boolean>>".format(id=_kind(kept)))
    joined = merged.join(classes.withColumnRenamed("node", "id"), "id", "left")
    return joined.select("id", "h", F.coalesce("component", "id").alias("class_id"), "n_words", "n_removed", "spans")


def _merged(spans: list[tuple]) -> list[tuple]:
    """Spans (start, end, first_id) that touch as one, with the smallest first id."""
    out: list[tuple] = []
    for start, end, first in sorted(spans, key=itemgetter(0, 1)):
        if out and start <= out[-1][1]:
            before, upto, own = out[-1]
            out[-1] = before, max(upto, end), own if first is None else first if own is None else min(own, first)
        else:
            out.append((start, end, first))
    return out


def _without(spans: list[tuple], gone: list[tuple]) -> list[tuple]:
    out = []
    for start, end, first in spans:
        for low, high, _ in gone:
            if high <= start or low >= end:
                continue
            if low > start:
                out.append((start, low, first))
            start = max(start, high)
        if start < end:
            out.append((start, end, first))
    return out


_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def cut(text: str, spans: list[dict]) -> str:
    """A text without the given spans of words; what stood around a span stays apart."""
    places = [m.span() for m in _WORDS.finditer(text)]
    out, at = "", 0
    for s in spans:
        start, end = places[s["start"]][0], places[s["end"] - 1][1]
        left, rest = text[at:start], text[end:]
        gap = re.match(r"[\x20\x09-\x0D]*", rest)[0]
        white = left[len(left.rstrip(" \t\n\x0b\x0c\r")) :] + gap
        out += left.rstrip(" \t\n\x0b\x0c\r") + ("\n" if "\n" in white else " " if white else "")
        at = end + len(gap)
    return (out + text[at:]).strip(" \t\n\x0b\x0c\r")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The documents with repeated passages removed from all but their first document.

    All columns stay, whatever their names; ``length_col``, if there, is set for changed texts. A
    document of which nothing is left is dropped; others stay, changed or not.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    held = docs.toDF(*names)
    own, body = (names[docs.columns.index(x)] for x in (id_col, text_col))
    with scratch(docs.sparkSession) as keep:
        found = repeated_passages(held, own, body).where("n_removed > 0")
        found = keep(materialise(found.select("id", "h", F.filter("spans", lambda s: s["removed"]).alias("spans")), "dedup-removed"))
    text = F.coalesce(F.col(body).cast("string"), F.lit(""))
    joined = held.join(found, F.col(own).eqNullSafe(F.col("id")) & (F.xxhash64(text) == F.col("h")), "left")

    @F.pandas_udf("string")
    def cut_all(texts, spans):
        import pandas as pd

        return pd.Series([None if s is None else cut(t, list(s)) for t, s in zip(texts, spans)], dtype=object)

    gone = F.col("spans").isNotNull()  # only texts that change go to Python
    changed = joined.withColumn("new", cut_all(F.when(gone, F.col(body)), F.col("spans"))).where("spans is null or new <> ''")
    changes = {body: F.coalesce(F.col("new").cast(held.schema[body].dataType), F.col(body))}
    if length_col in docs.columns:
        length = names[docs.columns.index(length_col)]
        changes[length] = F.when(gone, F.length("new").cast(held.schema[length].dataType)).otherwise(F.col(length))
    return changed.select(*(changes.get(c, F.col(c)).alias(c) for c in names)).toDF(*docs.columns)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share a passage with another: their class, the first documents of their passages, and the words repeated and removed."""
    found = repeated_passages(table(spark, sf_dir, "documents"))
    firsts = F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["first_id"])))
    return found.select(F.col("id").alias("doc_id"), "class_id", firsts.alias("first_ids"), F.size("spans").alias("n_spans"), F.col("n_words").alias("repeated_words"), F.col("n_removed").alias("removed_words"))
