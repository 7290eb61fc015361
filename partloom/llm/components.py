"""Connected components: tasks shrink their own links to stars, large-star and small-star steps alternate on the rest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from partloom.session import checkpointed

SLICE_LINKS = 250_000  # links that a task works on at once


def _smallest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the links `(u, v)`, and the smallest node that each can reach."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    root, (i, j) = np.arange(len(nodes)), np.split(ends, 2)
    while True:
        low, high = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
        if (low == high).all():
            return nodes, nodes[root]
        # Of the roots that a link still joins, at least every second one finds a smaller one.
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]


def _shrunk(edges: DataFrame, slice_links: int, whole: bool = False) -> DataFrame:
    """The links `(u, v)` of each task, slice by slice, as links of nodes to the smallest that they reach in it.

    With `whole` the smallest are listed with themselves too.
    """

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = []

        def stars() -> list[np.ndarray]:
            u, v = _smallest(*(np.concatenate(x) for x in zip(*waiting)))
            waiting.clear()
            used = np.ones(len(u), dtype=bool) if whole else u != v
            return [u[used], v[used]]

        def packed(ends: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ends], names=["u", "v"])

        for batch in batches:
            waiting.append([batch.column(x).to_numpy() for x in "uv"])
            if sum(len(x[0]) for x in waiting) > 2 * slice_links:
                waiting.append(stars())
                if len(waiting[0][0]) > slice_links:
                    yield packed(waiting.pop())
        if waiting:
            yield packed(stars())

    return edges.mapInArrow(shrink, "u bigint, v bigint")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on `edges(u, v)` with u > v.

    Large: every node hands its larger neighbours to its smallest one. Small: every node hands its smaller
    neighbours and itself to the smallest of them. Only minima are aggregated, on the map side first; the
    neighbours themselves are never gathered, so a node may have any number of them.
    """
    if large:
        both = edges.select(F.col("u").alias("n"), F.col("v").alias("o")).unionAll(edges.select(F.col("v").alias("n"), F.col("u").alias("o")))
        least = both.groupBy("n").agg(F.least(F.col("n"), F.min("o")).alias("m"))
        # Edge (u, v) as seen from v, whose larger neighbour is u.
        moved = edges.join(least, edges["v"] == least["n"]).select("u", F.col("m").alias("v"))
    else:
        least = edges.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        seen = edges.join(least, edges["u"] == least["n"])
        moved = seen.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
    return moved.filter(F.col("u") > F.col("v")).distinct()


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every outer node has one edge and no centre is an outer node: then the centres are the components."""
    if edges.groupBy("u").count().filter("count > 1").limit(1).count():
        return False
    return not edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1).count()


def connected_components(links: DataFrame, *, slice_links: int = SLICE_LINKS) -> DataFrame:
    """`(node, component)` for every node of `links(a, b)`; the component is its smallest node.

    Null ends, loops and repeated links are ignored. Every task first shrinks what it has, before any shuffle. If
    no more than a slice is left of all of it, that is shrunk once more and done. Else the number of rounds grows
    with the logarithm of the longest path; every round is stored in the shared folder, so a lost executor costs one task.
    """
    edges = links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").cast("bigint").alias("u"), F.least("a", "b").cast("bigint").alias("v"))
    edges = checkpointed(_shrunk(edges, slice_links), "links")
    if edges.count() <= slice_links:
        return _shrunk(edges.coalesce(1), slice_links, whole=True).select(F.col("u").alias("node"), F.col("v").alias("component"))
    edges = edges.distinct()
    while not _is_forest_of_stars(edges):
        edges = checkpointed(_star(_star(edges, True), False), "stars")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
