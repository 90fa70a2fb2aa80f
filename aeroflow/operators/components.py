"""Connected components by rounds of randomised contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from aeroflow.storage import materialise

#: A graph of so few links (told in both directions) is finished in one task.
SMALL_LINKS = 20_000


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Label every node of an undirected graph with its component's smallest node.

    Returns one row (node, component) for each node that has an edge to another node; nulls and
    loops are ignored and repeated edges count once. Both columns of ``edges`` must have the same
    orderable type. An empty input gives an empty result.

    In each round a node joins its neighbour (or itself) of lowest random priority; links between
    joined nodes become the next round's graph. Priorities are drawn anew each round, so chains
    shrink by a constant factor as stars do, and the number of rounds grows with the logarithm of
    the longest chain. Each round is a pre-aggregated minimum per node and two joins, so a node
    with many links is no group held in memory. Once SMALL_LINKS are left, one task finishes them.
    The rounds' maps are then applied backwards.
    """
    graph = materialise(_both_ways(edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))), "cc-links")
    nodes = graph.select(F.col("a").alias("node")).distinct()
    maps: list[DataFrame] = []
    while (links := graph.count()) > 0:
        if links <= SMALL_LINKS:
            maps.append(materialise(_finished(graph), "cc-map"))
            break
        seed = len(maps)
        joined = materialise(
            graph.groupBy("a").agg(F.min(_priority("b", seed)).alias("best")).select(F.col("a").alias("node"), F.least(_priority("a", seed), F.col("best"))["n"].alias("to")),
            "cc-map",
        )
        maps.append(joined)
        left = graph.join(joined.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a")
        both = left.join(joined.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
        graph = materialise(_both_ways(both.select(F.col("ta").alias("a"), F.col("tb").alias("b"))), "cc-links")
    if not maps:
        return nodes.select("node", F.col("node").alias("component"))
    label = maps[-1].select("node", F.col("to").alias("root"))
    for earlier in reversed(maps[:-1]):
        label = earlier.join(label.select(F.col("node").alias("to"), "root"), "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    label = materialise(label, "cc-label")
    smallest = label.groupBy("root").agg(F.min("node").alias("component"))
    return label.join(smallest, "root").select("node", "component")


def _finished(links: DataFrame) -> DataFrame:
    """(node, to): the smallest node of each component of a graph of SMALL_LINKS rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        kind = None
        for b in batches:
            kind = b.column(0).type
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x, y = find(x), find(y)
                parent[max(x, y)] = min(x, y)
        if parent:
            yield pa.RecordBatch.from_arrays([pa.array(list(parent), kind), pa.array([find(x) for x in list(parent)], kind)], names=["node", "to"])

    kind = links.schema["a"].dataType.simpleString()
    return links.select("a", "b").coalesce(1).mapInArrow(run, f"node {kind}, to {kind}")


def _priority(column: str, seed: int) -> Column:
    """A node's priority in the round ``seed``, with the node itself."""
    return F.struct(F.xxhash64(F.lit(seed), F.col(column)).alias("p"), F.col(column).alias("n"))


def _both_ways(links: DataFrame) -> DataFrame:
    links = links.where(F.col("a") != F.col("b"))
    return links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
