"""Exact top-k inner products by dual-tree search over cover trees."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from aeroflow.llm.frames import table
from aeroflow.storage import materialise

#: Rows of a block of data and of queries, about.
DATA_ROWS = 32768
QUERY_ROWS = 4096

#: Rows from which the top level's centres are chosen, and their number at most (one for each
#: block of rows that the table fills).
SAMPLE_ROWS = 2048
CENTRES = 32

#: Data blocks whose bounds are computed together.
SHELF = 64

LEAF_ROWS = 16

#: Children of a tree node at most.
FAN_OUT = 16

#: From this depth on, as below chains of ever nearer outliers, rows are dealt out evenly.
DEPTH = 24

#: Scores beyond 64 bits are given as the largest or smallest of these.
LEAST, MOST = -(1 << 63) + 1, (1 << 63) - 1

#: The kth score of a query with fewer than k scores.
UNKNOWN = np.iinfo(np.int64).min


@dataclass
class Node:
    """A point and the rows within ``radius`` of it; a leaf has no children."""

    centre: np.ndarray
    radius: float
    rows: np.ndarray
    at: int  # row of the centre
    children: list[Node] = field(default_factory=list)


def _distances(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    away = x - point
    return np.sqrt(np.einsum("ij,ij->i", away, away))


def cover_tree(x: np.ndarray, leaf_rows: int = LEAF_ROWS) -> Node:
    """A cover tree over the rows of ``x``, down to leaves of ``leaf_rows`` or of equal rows.

    A node's children cover its rows, each within its own radius. Their centres are further apart
    than half the node's radius, and one child keeps the node's own centre. Centres are added,
    the farthest row each time, until all rows are within half the radius of one or there are
    FAN_OUT; so in data without clusters radii shrink more slowly. From DEPTH on, rows are dealt to
    FAN_OUT children by their distance from the centre.
    """
    out: list[Node] = []
    todo: list[tuple[np.ndarray, int, int, Node | None]] = [(np.arange(len(x)), 0, 0, None)]
    while todo:
        rows, centre, depth, parent = todo.pop()
        near = _distances(x[rows], x[centre])
        node = Node(x[centre], float(near.max()), rows, centre)
        (parent.children if parent else out).append(node)
        if len(rows) <= leaf_rows or not node.radius > 0:
            continue
        if depth >= DEPTH:
            todo += [(rows[part], int(rows[part[0]]), depth + 1, node) for part in np.array_split(np.argsort(near), min(FAN_OUT, len(rows)))]
            continue
        centres, owner = [centre], np.zeros(len(rows), np.int64)
        while near.max() > node.radius / 2 and len(centres) < FAN_OUT:
            centres.append(int(rows[near.argmax()]))
            away = _distances(x[rows], x[centres[-1]])
            owner[away < near] = len(centres) - 1
            near = np.minimum(near, away)
        if len(centres) > 1:
            todo += [(rows[owner == i], c, depth + 1, node) for i, c in enumerate(centres)]
    return out[0]


@dataclass
class Tree:
    """A cover tree as arrays. Nodes are numbered by level, so a node's children are neighbours;
    rows are ordered so that each node covers neighbouring rows, from ``low`` to ``high``.
    """

    x: np.ndarray
    ids: np.ndarray
    centre: np.ndarray  # row of each node's centre
    radius: np.ndarray
    low: np.ndarray
    high: np.ndarray
    child: np.ndarray  # first child
    children: np.ndarray  # their number

    @classmethod
    def over(cls, x: np.ndarray, ids: np.ndarray, leaf_rows: int | None = None) -> Tree:
        root = cover_tree(x, LEAF_ROWS if leaf_rows is None else leaf_rows)
        nodes, low, order, stack = [root], {}, [], [root]
        while stack:  # rows in the order of the leaves
            node = stack.pop()
            low[id(node)] = sum(map(len, order))
            if node.children:
                stack += reversed(node.children)
            else:
                order.append(node.rows)
        child = []
        for node in nodes:  # grows while it is read
            child.append(len(nodes))
            nodes += node.children
        rows = np.concatenate(order)
        place = np.empty(len(rows), np.int64)
        place[rows] = np.arange(len(rows))
        lows = np.array([low[id(n)] for n in nodes])
        sizes = np.array([len(n.rows) for n in nodes])
        return cls(x[rows], ids[rows], place[[n.at for n in nodes]], np.array([n.radius for n in nodes]), lows, lows + sizes, np.array(child), np.array([len(n.children) for n in nodes]))

    def packed(self) -> bytes:
        """Bytes of the tree; components that fit are held in 16 bits."""
        small = np.abs(self.x).max(initial=0) < 1 << 15
        return pickle.dumps((self.x.astype(np.int16) if small else self.x, *(getattr(self, f) for f in list(self.__dataclass_fields__)[1:])))

    @classmethod
    def unpacked(cls, data: bytes) -> Tree:
        x, *rest = pickle.loads(data)
        return cls(x.astype(np.float64), *rest)


def _bounds(product: np.ndarray, q_norm: np.ndarray, q_radius: np.ndarray, d_norm: np.ndarray, d_radius: np.ndarray) -> np.ndarray:
    """No inner product of a row within ``q_radius`` of one centre and a row within ``d_radius`` of the other is
    larger than these, for centres of the given product and norms."""
    reach = q_norm * d_radius + d_norm * q_radius + q_radius * d_radius
    return product + reach + 0.5 + 1e-9 * (np.abs(product) + reach)  # scores are integers, distances are rounded


class Best:
    """The k best (score, id) of each query, ties to the smaller id."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.k = k
        self.scores: list[np.ndarray] = [np.zeros(0, np.int64)] * n
        self.ids: list[np.ndarray] = [np.zeros(0, np.int64)] * n
        self.kth = np.full(n, UNKNOWN) if floor is None else floor.copy()

    def add(self, row: int, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = scores >= self.kth[row]
        scores, ids = np.concatenate([self.scores[row], scores[keep]]), np.concatenate([self.ids[row], ids[keep]])
        order = np.lexsort((ids, -scores))
        _, once = np.unique(ids[order], return_index=True)  # the best score of each id
        order = order[np.sort(once)][: self.k]
        self.scores[row], self.ids[row] = scores[order], ids[order]
        if len(order) == self.k:
            self.kth[row] = max(self.kth[row], scores[order[-1]])


def _products(q: np.ndarray, d: np.ndarray, most: float) -> np.ndarray:
    """Inner products of rows of integers held as floats, none above ``most`` in size: in floats or
    64-bit integers where those are exact, else in Python's integers, cut to 64 bits.
    """
    if most < 2.0**52:
        return (q @ d.T).astype(np.int64)
    if most < 2.0**62:
        return q.astype(np.int64) @ d.astype(np.int64).T
    whole = [[[int(c) for c in row] for row in x.tolist()] for x in (q, d)]
    return np.array([[min(MOST, max(LEAST, sum(a * b for a, b in zip(x, y)))) for y in whole[1]] for x in whole[0]], np.int64).reshape(len(q), len(d))


def dual_search(queries: Tree, data: Tree, best: Best) -> int:
    """Bring ``best`` (in the order of ``queries.ids``) up to date with all data; returns the number of scores computed.

    Both trees are descended together, a step for all node pairs at once: a pair is pruned if its
    bound is below the worst kth score in the query node's group, else the larger node is
    replaced by its children. The leaf pairs that are left are scored by matrix products, for
    each query leaf from the largest bound down and in growing batches, and are pruned again as kth
    scores rise.
    """
    q_c, d_c = queries.x[queries.centre], data.x[data.centre]
    q_norm, d_norm = (np.sqrt(np.einsum("ij,ij->i", c, c)) for c in (q_c, d_c))
    edges = np.stack([queries.low, queries.high], 1).ravel()
    worst = np.minimum.reduceat(np.append(best.kth, UNKNOWN), edges)[::2]
    worst = np.where(worst > MOST // 2, UNKNOWN, worst)  # cut scores say nothing of the others
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    left: list[tuple[np.ndarray, ...]] = []
    while len(a):
        bound = np.empty(len(a))
        for i in range(0, len(a), 1 << 16):
            at, of = a[i : i + (1 << 16)], b[i : i + (1 << 16)]
            bound[i : i + (1 << 16)] = _bounds(np.einsum("ij,ij->i", q_c[at], d_c[of]), q_norm[at], queries.radius[at], d_norm[of], data.radius[of])
        keep = bound >= worst[a]
        a, b, bound = a[keep], b[keep], bound[keep]
        q_inner, d_inner = queries.children[a] > 0, data.children[b] > 0
        leaf = ~q_inner & ~d_inner
        left.append((a[leaf], b[leaf], bound[leaf]))
        split_q = q_inner & (~d_inner | (queries.radius[a] > data.radius[b]))
        parts = []
        for chosen, tree, at in ((split_q, queries, a), (~split_q & d_inner, data, b)):
            n = tree.children[at[chosen]]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            down = np.repeat(tree.child[at[chosen]], n) + step
            other = np.repeat((b if tree is queries else a)[chosen], n)
            parts.append((down, other) if tree is queries else (other, down))
        a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    a, b, bound = (np.concatenate(x) for x in zip(*left, strict=True))
    order = np.lexsort((-bound, a))
    a, b, bound = a[order], b[order], bound[order]
    most, scored = float((q_norm + queries.radius).max(initial=0) * (d_norm + data.radius).max(initial=0)), 0
    starts = np.r_[np.flatnonzero(np.diff(a, prepend=-1)), len(a)]
    for start, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        low, high = queries.low[a[start]], queries.high[a[start]]
        rows, batch = queries.x[low:high], 2
        while start < end:
            kth = best.kth[low:high].min()
            if kth <= MOST // 2:
                end = start + int(np.searchsorted(-bound[start:end], -float(kth), "right"))
            leaves = b[start : min(end, start + batch)]
            if not len(leaves):
                break
            found = np.concatenate([np.arange(x, y) for x, y in zip(data.low[leaves], data.high[leaves], strict=True)])
            scores, ids = _products(rows, data.x[found], most), data.ids[found]
            scored += scores.size
            for row in np.flatnonzero(scores.max(axis=1) >= best.kth[low:high]).tolist():
                other = ids != queries.ids[low + row]
                if other.any():
                    best.add(low + row, scores[row][other], ids[other])
            start, batch = start + len(leaves), batch * 2
    return scored


def _integers(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, dim, v) with ``v`` the components floor(256 x), integers held exactly as doubles."""
    kept = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("x")).where("id is not null and x is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, dims, out = [], [], []
            for vec_id, x in zip(b.column(0).to_pylist(), b.column(1)):
                v = np.floor(256 * np.array(x.values.to_numpy(zero_copy_only=False), np.float64))
                if np.isfinite(v).all():
                    ids.append(vec_id)
                    dims.append(len(v))
                    out.append(v.astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], names=["id", "dim", "v"])

    return kept.mapInArrow(run, "id long, dim int, v binary")


def _centres(vectors: DataFrame) -> dict[int, np.ndarray]:
    """The top level's centres for each dimension, from a sample of SAMPLE_ROWS rows at most: one for
    each DATA_ROWS rows, CENTRES at most."""
    sizes = {r.dim: r["count"] for r in vectors.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(SAMPLE_ROWS).collect()}
    sample: dict[int, list[np.ndarray]] = {}
    for row in vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).collect():
        sample.setdefault(row.dim, []).append(np.frombuffer(row.v, "<f8"))
    out = {}
    for dim, rows in sample.items():
        x = np.array(rows)
        chosen, near = [0], _distances(x, x[0])
        while len(chosen) < min(CENTRES, -(-sizes.get(dim, 1) // DATA_ROWS)) and near.max() > 0:
            chosen.append(int(near.argmax()))
            near = np.minimum(near, _distances(x, x[chosen[-1]]))
        out[dim] = x[chosen]
    return out


def _blocks(vectors: DataFrame, rows: int, label: str) -> DataFrame:
    """Blocks of about ``rows`` vectors of one cell: block, dim, centre, radius, payload and size."""
    sizes = vectors.groupBy("dim", "cell").agg(F.ceil(F.count("*") / rows).alias("chunks"))
    placed = vectors.join(sizes, ["dim", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks"))
    grouped = placed.groupBy("dim", "cell", "chunk").agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("members"))
    named = grouped.select(F.concat_ws("/", "dim", "cell", "chunk").alias("block"), "dim", F.col("members.id").alias("ids"), F.col("members.v").alias("vs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                dim, vs = b.column(1)[i].as_py(), b.column(3)[i].as_py()
                tree = Tree.over(np.frombuffer(b"".join(vs), "<f8").reshape(len(vs), dim), np.array(b.column(2)[i].as_py(), np.int64))
                told = [pa.array([tree.x[tree.centre[0]].tobytes()], pa.binary()), pa.array([float(tree.radius[0])]), pa.array([tree.packed()], pa.binary()), pa.array([len(vs)], pa.int64())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), *told], names=["block", "dim", "centre", "radius", "payload", "n"])

    return materialise(named.mapInArrow(run, "block string, dim int, centre binary, radius double, payload binary, n long"), label)


def _shelves(data: DataFrame) -> DataFrame:
    """Centres and radii of about ``SHELF`` data blocks in a row: dim, shelf, shelves (of the dim) and blocks."""
    n = data.groupBy("dim").agg(F.ceil(F.count("*") / SHELF).alias("shelves"))
    dealt = data.select("dim", F.struct("block", "centre", "radius").alias("b")).join(n, "dim")
    return materialise(dealt.groupBy("dim", F.pmod(F.xxhash64("b.block"), F.col("shelves")).alias("shelf")).agg(F.max("shelves").alias("shelves"), F.collect_list("b").alias("blocks")), "topk-shelves")


def _near(queries: DataFrame, shelves: DataFrame, most: int | None = None) -> DataFrame:
    """(q, d, bound): pairs of a query block and a data block, the ``most`` of largest bound in each shelf or all
    that reach the query block's ``worst`` (null: all). Only centres and radii meet, by shelf.
    """
    n = shelves.groupBy("dim").agg(F.max("shelves").alias("shelves"))
    asked = queries.select(F.col("block").alias("q"), "dim", F.col("centre").alias("qc"), F.col("radius").alias("qr"), "worst").join(n, "dim")
    asked = asked.withColumn("shelf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shelves") - 1))).drop("shelves")
    met = asked.join(shelves.drop("shelves"), ["dim", "shelf"]).select("q", "qc", "qr", "worst", "blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norm = lambda x: np.sqrt(np.einsum("ij,ij->i", x, x))
        for batch in batches:
            for r in batch.to_pylist():
                c, d = np.frombuffer(r["qc"])[None], np.array([np.frombuffer(x["centre"]) for x in r["blocks"]])
                bounds = _bounds(d @ c[0], norm(c), np.array([r["qr"]]), norm(d), np.array([x["radius"] for x in r["blocks"]]))
                chosen = np.argsort(-bounds, kind="stable")[:most]
                if r["worst"] is not None:
                    chosen = chosen[bounds[chosen] >= r["worst"]]
                yield pa.RecordBatch.from_pydict({"q": pa.array([r["q"]] * len(chosen), pa.string()), "d": pa.array([r["blocks"][i]["block"] for i in chosen], pa.string()), "bound": pa.array(bounds[chosen], pa.float64())})

    return met.mapInArrow(run, "q string, d string, bound double")


def _search(pairs: DataFrame, queries: DataFrame, data: DataFrame, floors: DataFrame | None, k: int, label: str) -> DataFrame:
    """Search the given pairs. A data block meets its query blocks in one task, one by one."""
    none = F.lit(None).cast("array<struct<query_id:bigint,kth:bigint>>").alias("floors")
    wanted = pairs.select(F.col("q").alias("block"), "d").join(queries.select("block", "payload"), "block")
    wanted = wanted.join(floors, "block", "left") if floors is not None else wanted.withColumn("floors", none)
    left = data.join(pairs.select(F.col("d").alias("block")).distinct(), "block", "left_semi")
    rows = left.select(F.col("block").alias("d"), F.lit("").alias("q"), "payload", none)
    rows = rows.union(wanted.select("d", F.col("block").alias("q"), "payload", "floors"))
    dealt = rows.repartition(F.col("d")).sortWithinPartitions("d", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            for row in b.to_pylist():
                tree = Tree.unpacked(row["payload"])
                if not row["q"]:
                    held = tree
                    continue
                floor = None
                if row["floors"]:
                    known = {f["query_id"]: f["kth"] for f in row["floors"]}
                    floor = np.array([known.get(i, UNKNOWN) for i in tree.ids.tolist()], np.int64)
                best = Best(len(tree.ids), k, floor)
                scored = dual_search(tree, held, best)
                counts = [len(s) for s in best.scores]
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": pa.array([row["q"]] * (sum(counts) + 1), pa.string()),
                        "query_id": pa.array([*np.repeat(tree.ids, counts).tolist(), None], pa.int64()),
                        "vec_id": pa.array([*np.concatenate([np.zeros(0, np.int64), *best.ids]).tolist(), scored], pa.int64()),
                        "score": pa.array([*np.concatenate([np.zeros(0, np.int64), *best.scores]).tolist(), len(tree.ids) * len(held.ids)], pa.int64()),
                    }
                )

    return materialise(dealt.mapInArrow(run, "block string, query_id long, vec_id long, score long"), label)


def _best(found: DataFrame, k: int) -> DataFrame:
    once = found.where("query_id IS NOT NULL").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _searched(df: DataFrame, is_query: Column, k: int, id_col: str, vec_col: str) -> DataFrame:
    """Candidates of all searches: block, query_id, vec_id, score; a row without query_id has the number
    of scores computed for a pair of blocks, and of all its scores."""
    picked = df.select(F.col(id_col), F.col(vec_col), is_query.alias("_query"))
    vectors = materialise(_integers(picked, id_col, vec_col), "topk-vectors")
    asked = picked.where("_query").select(F.col(id_col).cast("long").alias("id")).distinct()
    centres = _centres(vectors)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(1).to_numpy()
            cells = np.zeros(b.num_rows, np.int32)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                if dim in centres:
                    x = np.frombuffer(b"".join(b.column(2)[i].as_py() for i in at.tolist()), "<f8").reshape(len(at), dim)
                    cells[at] = np.array([_distances(x, c) for c in centres[dim]]).argmin(axis=0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells)], names=["id", "dim", "v", "cell"])

    placed = materialise(vectors.mapInArrow(assign, "id long, dim int, v binary, cell int"), "topk-cells")
    few = placed.dropDuplicates(["id", "v"]).withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    data = _blocks(few.drop("n"), DATA_ROWS, "topk-data")
    queries = _blocks(placed.join(asked, "id", "left_semi"), QUERY_ROWS, "topk-queries")
    shelves = _shelves(data)
    order = Window.partitionBy("q").orderBy(F.desc("bound"), "d")
    nearest = _near(queries.withColumn("worst", F.lit(None).cast("long")), shelves, 2).withColumn("n", F.row_number().over(order)).where("n <= 2")
    nearest = materialise(nearest.select("q", "d"), "topk-nearest")
    first = _search(nearest, queries, data, None, k, "topk-first")
    kth = _best(first, k).groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(F.col("n") == k)
    kth = kth.drop("n").join(first.select("block", "query_id").distinct(), "query_id")
    floors = kth.groupBy("block").agg(F.collect_list(F.struct("query_id", "kth")).alias("floors"), F.min("kth").alias("worst"), F.count("*").alias("known"))
    floors = materialise(floors.join(queries.select("block", "n"), "block"), "topk-floors")
    worst = floors.where("known >= n").select("block", "worst")  # else a query of the block lacks a kth score
    rest = _near(queries.join(worst, "block", "left"), shelves).join(nearest, ["q", "d"], "left_anti")
    second = _search(materialise(rest, "topk-pairs"), queries, data, floors.select("block", "floors"), k, "topk-second")
    return first.union(second)


def top_k(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k rows with the largest integer inner product for each query row.

    Components are floor(256 x). Vectors that are null, hold null or non-finite components (or some
    whose 256-fold is not finite) or have a null id take no part. Scores are exact; one beyond 64
    bits is given as the largest or smallest such integer, and ties. A query is compared with all rows of other ids and equal dimension;
    ids that repeat count once, with the best score. Ties go to the smaller id. With fewer than k
    candidates all are returned; an empty table gives no rows; further columns are left out.

    The upper level of the index is one set of centres for queries and data, from a bounded
    sample; each cell is cut into blocks of bounded size by a hash of the id. Of equal vectors the
    k + 1 smallest ids are indexed, as no query can use more. Each block holds a cover tree. Query
    blocks are first searched in the two data blocks of largest bound; with the kth scores known,
    only pairs of blocks whose bound reaches the worst of them are searched further.

    Returns query_id, rank int (from 1), vec_id, score long.
    """
    found = _searched(df, is_query, k, id_col, vec_col)
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def share_scored(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> float:
    """The share of all inner products of a query and an indexed row that the search computes."""
    done = _searched(df, is_query, k, id_col, vec_col).where("query_id IS NULL").agg(F.sum("vec_id").alias("a"), F.sum("score").alias("b")).first()
    pairs = df.where(is_query).count() * df.count()
    return done.a / max(pairs, 1) if done.a is not None else 0.0


def op10_cover_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows for each vector whose id is divisible by 50."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP10_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM usable q JOIN usable d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""
