"""Near-duplicate vectors by cross-polytope hashing.

A vector is turned by pseudo-random rotations made of sign flips and fast Hadamard transforms; its hash is the
nearest corner of the cross-polytope. Several hashes make a bucket, and each vector goes to its few nearest
buckets of every table. Vectors that share a bucket are compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from partloom.llm.components import connected_components
from partloom.session import checkpointed

NEAREST = 4  # corners looked at per hash when buckets are ranked
BLOCK_ROWS = 1024


@dataclass(frozen=True)
class Hashing:
    dimension: int
    hashes: int  # per bucket
    tables: int
    probes: int  # buckets per vector and table
    seed: int


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of the rows; their length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        pairs = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(n, d)
        h *= 2
    return x


def buckets(vectors: np.ndarray, hashing: Hashing) -> np.ndarray:
    """Bucket codes, rows x (tables * probes); those of table t lie in columns t * probes and following."""
    n, d = vectors.shape
    width = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :d] = vectors
    norms = np.linalg.norm(padded, axis=1, keepdims=True)
    padded /= np.where(norms > 0, norms, 1)
    near = min(NEAREST, width)
    combos = np.array(list(product(range(near), repeat=hashing.hashes)))
    out = np.zeros((n, hashing.tables * hashing.probes), dtype=np.int64)
    rng = np.random.default_rng(hashing.seed)
    for table in range(hashing.tables):
        corners, gaps = [], []
        for _ in range(hashing.hashes):
            turned = padded
            for _ in range(3):
                turned = hadamard(turned * rng.choice([-1.0, 1.0], width)) / math.sqrt(width)
            size = np.abs(turned)
            top = np.argsort(-size, axis=1, kind="stable")[:, :near]
            values = np.take_along_axis(turned, top, axis=1)
            corners.append(top * 2 + (values < 0))
            gaps.append((np.abs(values[:, :1]) - np.abs(values)) ** 2)
        cost = sum(g[:, combos[:, j]] for j, g in enumerate(gaps))
        best = np.argsort(cost, axis=1, kind="stable")[:, : hashing.probes]
        code = np.full((n, hashing.probes), table, dtype=np.int64)
        for j, c in enumerate(corners):
            code = code * (2 * width) + np.take_along_axis(c, combos[best, j], axis=1)
        out[:, table * hashing.probes : (table + 1) * hashing.probes] = code
    return out


def plan_hashing(rows: int, dimension: int, threshold: float, *, recall: float = 0.998, seed: int = 11, bucket_rows: int = 64) -> Hashing:
    """As many hashes as keep buckets small, and the cheapest tables and probes that reach the recall.

    The chance that two vectors at the threshold share a bucket is measured on simulated pairs, so recall is
    the same for any number of rows.
    """
    width = 1 << max(1, (dimension - 1).bit_length())
    hashes = 1
    while rows / (2 * width) ** hashes > bucket_rows and hashes < 4:
        hashes += 1
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((1500, dimension))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal(a.shape)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-12)
    b = threshold * a + math.sqrt(1 - threshold**2) * b
    best = None
    for probes in (1, 2, 4):
        if probes > min(NEAREST, width) ** hashes:
            continue
        trial = Hashing(dimension, hashes, 6, probes, seed)
        x, y = buckets(a, trial).reshape(-1, 6, probes), buckets(b, trial).reshape(-1, 6, probes)
        shared = min(0.999, max(1e-3, float((x[..., :, None] == y[..., None, :]).any(axis=(2, 3)).mean())))
        tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - shared)))
        if best is None or tables * probes < best.tables * best.probes:
            best = Hashing(dimension, hashes, tables, probes, seed)
    return best


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of unit length, scaled by their largest entry first, so that no square over- or underflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _smallest_reachable(size: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of `size` numbers the smallest that the pairs `(x, y)` connect it to."""
    least = np.arange(size)
    while True:
        before = least.copy()
        low = np.minimum(least[x], least[y])
        np.minimum.at(least, least[x], low)
        np.minimum.at(least, least[y], low)
        least = least[least]
        if (least == before).all():
            return least


def _first_shared(a: np.ndarray, b: np.ndarray, probes: int) -> np.ndarray:
    """The smallest bucket code that both rows have, in the first table in which they share one."""
    out = np.full(len(a), -1, dtype=np.int64)
    for table in range(a.shape[1] // probes):
        x, y = a[:, table * probes : (table + 1) * probes], b[:, table * probes : (table + 1) * probes]
        common = np.where((x[:, :, None] == y[:, None, :]).any(axis=2), x, np.iinfo(np.int64).max).min(axis=1)
        out = np.where((out < 0) & (common < np.iinfo(np.int64).max), common, out)
    return out


def link_vectors(classes: DataFrame, dimension: int, threshold: float, hashing: Hashing, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links among distinct vectors `(class_id, vector, copies)`: rows `(kind, a, b)`.

    Kind 0: `b` copies linked to class `a`, to be summed up; kind 1: an edge, enough of them to connect what is
    linked. A pair that shares several buckets counts in the first only, so pairs are never written out and
    need no `distinct`. Large buckets are cut into blocks of about `block_rows` vectors, and each pair of
    blocks is a group of its own.
    """
    probes = hashing.probes

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                codes = buckets(unit(np.stack(batch["vector"].to_numpy()).astype(np.float64)), hashing)
                yield batch.assign(codes=list(codes))

    schema = f"class_id bigint, vector {classes.schema['vector'].dataType.simpleString()}, copies bigint, codes array<bigint>"
    indexed = checkpointed(classes.select("class_id", "vector", "copies").mapInPandas(hashed, schema), "vector-codes")
    # A bucket that one vector has to itself needs no comparison. Large buckets are few: at most rows / block_rows per table.
    sizes = indexed.select(F.explode("codes").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    blocks = sizes.select("bucket", F.ceil(F.col("n") / block_rows).alias("blocks"))
    placed = indexed.withColumn("bucket", F.explode("codes")).join(blocks, "bucket")
    own = F.pmod(F.xxhash64("class_id"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    dealt = placed.withColumn("own", own).withColumn("other", other).select(
        "bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "class_id", "vector", "copies", "codes"
    )

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        bucket, low, high = key
        left = group[group["own"] == low] if low != high else group
        right = group[group["own"] == high] if low != high else group
        found_a, found_b = [], []
        if len(left) and len(right):
            matrices = []
            for side in (left, right):
                matrices.append(unit(np.stack(side["vector"].to_numpy()).astype(np.float64)))
            ids = [side["class_id"].to_numpy() for side in (left, right)]
            codes = [np.stack(side["codes"].to_numpy()) for side in (left, right)]
            copies = [side["copies"].to_numpy() for side in (left, right)]
            for at in range(0, len(left), 512):
                i, j = np.nonzero(matrices[0][at : at + 512] @ matrices[1].T >= threshold)
                i = i + at
                keep = ids[0][i] < ids[1][j] if low == high else np.ones(len(i), dtype=bool)
                i, j = i[keep], j[keep]
                for cut in range(0, len(i), 20_000):
                    x, y = i[cut : cut + 20_000], j[cut : cut + 20_000]
                    mine = _first_shared(codes[0][x], codes[1][y], probes) == bucket
                    found_a.append(np.stack([ids[0][x[mine]], copies[0][x[mine]]], axis=1))
                    found_b.append(np.stack([ids[1][y[mine]], copies[1][y[mine]]], axis=1))
        a = np.concatenate(found_a) if found_a else np.zeros((0, 2), dtype=np.int64)
        b = np.concatenate(found_b) if found_b else np.zeros((0, 2), dtype=np.int64)
        nodes, where = np.unique(np.concatenate([a[:, 0], b[:, 0]]), return_inverse=True)
        degree = np.zeros(len(nodes), dtype=np.int64)
        np.add.at(degree, where, np.concatenate([b[:, 1], a[:, 1]]))
        least = _smallest_reachable(len(nodes), where[: len(a)], where[len(a) :])
        below = np.flatnonzero(least != np.arange(len(nodes)))
        tree = np.stack([nodes[least[below]], nodes[below]], axis=1).astype(np.int64)
        return pd.DataFrame(
            {
                "kind": np.concatenate([np.zeros(len(nodes), dtype=np.int32), np.ones(len(tree), dtype=np.int32)]),
                "a": np.concatenate([nodes.astype(np.int64), tree[:, 0]]),
                "b": np.concatenate([degree, tree[:, 1]]),
            }
        )

    return dealt.groupBy("bucket", "low", "high").applyInPandas(compare, "kind int, a bigint, b bigint")


def near_duplicates(vectors: DataFrame, *, threshold: float = 0.9, recall: float = 0.998) -> DataFrame:
    """One row per row of `vectors(vec_id, embedding)`: `vec_id, n_links, component_id, kept`.

    Vectors are linked if their cosine in double precision is at least `threshold`. `n_links` counts other
    vectors, exact copies included; `component_id` is the smallest id reachable, `kept` marks it. Vectors that
    are null, empty, zero, or hold a null, NaN or infinite component link with nothing, nor do vectors of
    different length with each other. Exact copies are one class from the start. A repeated row, id and
    vector alike, is the same vector and gets the same result; different vectors of one id are vectors of their own,
    linked by nothing but their cosine. Null ids link with nothing. Floats are compared as they are, all other
    numbers as doubles.
    """
    value = F.col("embedding")
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    numbers = F.transform(value, lambda x: x.cast("float" if element == "float" else "double"))
    usable = F.col("vec_id").isNotNull() & F.exists(value, lambda x: x != 0) & F.forall(
        value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.when(F.coalesce(usable, F.lit(False)), numbers).alias("vector"))
    rows = rows.withColumn("_key", F.xxhash64("vector"))
    good = rows.filter(F.col("vector").isNotNull())
    distinct = good.groupBy("_key", "vector", "vec_id").agg(F.lit(1).alias("_one"))
    classes = distinct.groupBy("_key", "vector").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    # Ids may repeat over different vectors, so classes carry a number of their own, stored with them.
    classes = checkpointed(classes.withColumn("class_id", F.monotonically_increasing_id()), "vector-classes")
    results = None
    for row in classes.groupBy(F.size("vector").alias("d")).count().orderBy("d").collect():
        same = classes.filter(F.size("vector") == row["d"])
        found = link_vectors(same, row["d"], threshold, plan_hashing(row["count"], row["d"], threshold, recall=recall))
        results = found if results is None else results.unionAll(found)
    if results is None:
        plain = rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
        return plain.withColumn("kept", F.lit(True))
    stored = checkpointed(results, "vector-links")
    degrees = stored.filter("kind = 0").groupBy(F.col("a").alias("class_id")).agg(F.sum("b").alias("_degree"))
    components = checkpointed(connected_components(stored.filter("kind = 1").select("a", "b")).withColumnRenamed("node", "class_id"), "vector-components")
    # The smallest id of a component, from one row per class.
    smallest = components.join(classes.select("class_id", "least"), "class_id").groupBy(F.col("component").alias("_c")).agg(F.min("least").alias("_least"))
    named = components.join(smallest, F.col("component") == F.col("_c")).select("class_id", "_least")
    labelled = (
        classes.join(degrees, "class_id", "left")
        .join(named, "class_id", "left")
        .select("_key", "vector", "class_id", "copies", "_degree", F.coalesce("_least", "least").alias("component"))
    )
    joined = rows.join(labelled, ["_key", "vector"], "left")
    in_class = F.col("class_id").isNotNull()
    component = F.when(in_class, F.col("component")).otherwise(F.col("vec_id"))
    links = F.when(in_class, F.col("copies") - 1 + F.coalesce("_degree", F.lit(0))).otherwise(0).cast("bigint")
    return joined.select("vec_id", links.alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id"))
    )
