"""Exact similarity self-join of documents on word n-grams (shingles) by universe partition.

Sets are put in bands by size. In a band every shingle is hashed to one of `m` segments, and two similar sets
differ in at most U shingles. If segments are asked for with `v` units each (1: equal, 2: equal but for
one shingle, 0: not at all) and the units add up to U + 1, at least one segment answers. The smaller set of a
pair is indexed with all its segments and, in the bands of small sets, with what is left of each without one
shingle. The other set picks its units by cost, the number of sets that would answer: keys that no other set
has cost nothing, so most sets find in the first count that they have no partner and are done. Candidates are
then verified on their whole sets, unless small sketches of both show already that they differ in too much.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pandas.util import hash_array
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from partloom.llm.components import connected_components
from partloom.llm.suffix_tree import LOWERED
from partloom.llm.text import set_aside
from partloom.session import checkpointed

SLICE_SHINGLES = 100_000
HELD_KEYS = 1_000_000
CROWD, CROWD_BLOCK = 16, 1024  # sets of a key from which it is crowded, and sets in a block
OFFERS = 2  # nearest sets of each block that a set of a crowd offers to first
PLACES = 256  # of a sketch, with four bits each
U64 = np.uint64


@dataclass(frozen=True)
class Join:
    """`percent`: least Jaccard similarity.

    A band has `slack + small_slack / largest size` segments per unit that is needed: the choice must be wide
    where a passage that many texts share is a large part of a set. Sets up to `small` shingles are indexed
    with their one-deletion neighbours and their empty segments, so that they never lack units.
    """

    width: int = 5
    percent: int = 75
    growth: float = 1.5
    slack: float = 1.1
    small_slack: float = 40.0
    small: int = 64
    filter_bits: int = 1 << 24  # bound of the bitmaps that tasks get

    def unit_need(self, larger: int, smaller: int) -> int:
        """Units that must be asked for: one more than the most shingles in which similar sets differ."""
        return (larger + smaller) * (100 - self.percent) // (100 + self.percent) + 1

    def bands(self, upto: int) -> list[int]:
        """Lower ends of the bands. Partners of a set lie in its own band and the one below."""
        lows = [1]
        while lows[-1] <= upto:
            lows.append(max(lows[-1] + 1, int(lows[-1] * self.growth)))
        return lows

    def segments(self, high: int) -> int:
        """Number of segments of the band whose largest set has `high` shingles."""
        need = self.unit_need(high * 100 // self.percent, high)
        return int(np.ceil(need * min(2.5, self.slack + self.small_slack / high)))


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


class Shingler:
    """Sets of hashed shingles."""

    def __init__(self, join: Join):
        self.join = join

    def shingles(self, text: str | None) -> np.ndarray:
        """Distinct shingle hashes in order; a shorter text is one shingle of all its words, none has none."""
        words = (text or "").encode().translate(LOWERED).split()
        n, width = len(words), min(self.join.width, len(words))
        if n == 0:
            return np.zeros(0, dtype=U64)
        # All words at once: most texts have many that were never seen before, so remembering them doesn't help.
        values = hash_array(np.array(words, dtype=object), categorize=False)
        with np.errstate(over="ignore"):
            out = np.full(n - width + 1, width, dtype=U64)
            for i in range(width):
                out = out * U64(0x9E3779B97F4A7C15) + values[i : n - width + 1 + i]
        out = _mixed(out)
        out.sort()
        return out[np.append(True, out[1:] != out[:-1])]


def _identity(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit numbers that stand for a set; the first is its node in the join."""
    digest = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _sketch(shingles: np.ndarray) -> np.ndarray:
    """Four bits of the sum of the shingles at each of 256 places, as 16 numbers.

    Sets differ in at least as many shingles as there are places with different bits.
    """
    sums = np.zeros(PLACES, dtype=U64)
    with np.errstate(over="ignore"):
        np.add.at(sums, (shingles >> U64(7)).astype(np.int64) % PLACES, _mixed(shingles + U64(1)))
    bits = (_mixed(sums) >> U64(60)).astype(U64).reshape(-1, 16)
    return np.bitwise_or.reduce(bits << (np.arange(16, dtype=U64) * U64(4)), axis=1).view(np.int64)


class Segmenter:
    """Roles of a set in its bands, and the keys of its segments."""

    def __init__(self, join: Join):
        self.join, self.lows = join, join.bands(64)

    def roles(self, size: int) -> list[tuple[int, int, bool, int]]:
        """`(band, segments, below, need)`: in its own band a set is indexed and asks, in the one below it asks."""
        while self.lows[-1] <= size:
            self.lows = self.join.bands(self.lows[-1] * 4)
        band = int(np.searchsorted(self.lows, size, side="right")) - 1
        out = [(band, self.join.segments(self.lows[band + 1] - 1), False, self.join.unit_need(size, size))]
        if band and -(-size * self.join.percent // 100) < self.lows[band]:
            high = self.lows[band] - 1
            out.append((band - 1, self.join.segments(high), True, self.join.unit_need(size, high)))
        return out

    def keys(self, sets: list[np.ndarray], nodes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """`key, node, meta` rows of a slice of sets, worked on together.

        `meta` is `segment << 3 | several << 2 | left << 1 | below`; `left` marks a one-deletion neighbour,
        `several` a segment that has them. A negative `meta` describes a set in a role: see `_described`.
        """
        roles = [(i, *role) for i, s in enumerate(sets) for role in self.roles(len(s))]
        lengths = np.array([len(sets[r[0]]) for r in roles])
        band, segments, need = (np.array([r[i] for r in roles], dtype=np.int64) for i in (1, 2, 4))
        below = np.array([r[3] for r in roles], dtype=np.int64)
        owner = np.array([nodes[r[0]] for r in roles], dtype=np.int64)
        small = np.array([self.lows[r[1] + 1] - 1 <= self.join.small for r in roles])
        tokens = np.concatenate([sets[r[0]] for r in roles])
        role = np.repeat(np.arange(len(roles)), lengths)
        base = np.concatenate([[0], np.cumsum(segments)])
        with np.errstate(over="ignore"):
            salt = band.astype(U64) * U64(2654435761) + U64(1)
            at = base[role] + ((_mixed(tokens + salt[role]) >> U64(11)) % segments.astype(U64)[role]).astype(np.int64)
            sums = np.zeros(base[-1], dtype=U64)
            np.add.at(sums, at, tokens)
            sizes = np.bincount(at, minlength=base[-1])
            of = np.repeat(np.arange(len(roles)), segments)
            segment = np.arange(base[-1]) - base[of]

            def key(total: np.ndarray, where: np.ndarray, size: np.ndarray) -> np.ndarray:
                place = (segment[where].astype(U64) << U64(24)) + size.astype(U64) + (band[of[where]].astype(U64) << U64(52))
                return _mixed(total ^ _mixed(place + U64(0x9E3779B97F4A7C15))).view(np.int64)

            several = (sizes > 1) & small[of]
            used = np.flatnonzero((sizes > 0) | small[of])
            gone = several[at]
            whole, left = key(sums[used], used, sizes[used]), key(sums[at[gone]] - tokens[gone], at[gone], sizes[at[gone]] - 1)
        units = np.bincount(of[used], minlength=len(roles)) + np.bincount(of[several], minlength=len(roles))
        described = -1 - (2 * (need - units + (1 << 28)) + below)
        meta = np.concatenate(
            [segment[used] << 3 | several[used] << 2 | below[of[used]], segment[at[gone]] << 3 | 6 | below[of[at[gone]]], described]
        )
        return np.concatenate([whole, left, owner]), np.concatenate([owner[of[used]], owner[of[at[gone]]], owner]), meta.astype(np.int32)


def _arrow(columns: dict[str, tuple[object, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


def _sets(docs: DataFrame, join: Join) -> DataFrame:
    """Per row: `doc_id, n, node, twin, sketch`: the size of its set, two numbers that stand for it, and its sketch."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(join)
        for batch in batches:
            rows = [(len(s), *_identity(s), _sketch(s)) for s in (shingler.shingles(text.as_py()) for text in batch.column("text"))]
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
            sketches = pa.array([r[3] for r in rows], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, sketches], names=["doc_id", "n", "node", "twin", "sketch"])

    return docs.mapInArrow(describe, "doc_id bigint, n bigint, node bigint, twin bigint, sketch array<bigint>")


def _keys(docs: DataFrame, join: Join) -> DataFrame:
    """`(key, node, meta)`: all keys of every distinct set that a task sees."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, segmenter = Shingler(join), Segmenter(join)
        seen: set[int] = set()
        sets: list[np.ndarray] = []
        nodes: list[int] = []
        size = 0

        def rows() -> pa.RecordBatch:
            key, node, meta = segmenter.keys(sets, nodes)
            return _arrow({"key": (key, pa.int64()), "node": (node, pa.int64()), "meta": (meta, pa.int32())})

        for batch in batches:
            for text in batch.column("text"):
                shingles = shingler.shingles(text.as_py())
                if not len(shingles) or (node := _identity(shingles)[0]) in seen:
                    continue
                seen.add(node)
                sets.append(shingles)
                nodes.append(node)
                size += len(shingles)
                if size > SLICE_SHINGLES:
                    yield rows()
                    sets, nodes, size = [], [], 0
        if sets:
            yield rows()

    return docs.mapInArrow(emit, "key bigint, node bigint, meta int")


def _shared_only(keys: DataFrame) -> DataFrame:
    """Rows whose key another set has too, and the descriptions.

    A task keeps the keys it has seen, like any aggregation by key. Of a key that is known to be shared it
    keeps one row, so a key of very many sets takes no more memory than one of two.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=bool)]
        waiting: list[list[np.ndarray]] = []
        size = 0

        def sifted() -> list[np.ndarray]:
            """Rows to hand on; `state` becomes what later rows are to be compared with. Its last column: handed on."""
            nonlocal state
            key, node, meta, done = (np.concatenate([state[i], *(w[i] for w in waiting)]) for i in range(4))
            order = np.lexsort((meta, node, key))
            key, node, meta, done = key[order], node[order], meta[order], done[order]
            same = key[1:] == key[:-1]
            twin = same & (node[1:] == node[:-1])
            run = np.concatenate([[0], np.cumsum(~same)]) if len(key) else np.zeros(0, dtype=np.int64)
            shared = np.zeros(run[-1] + 1 if len(key) else 0, dtype=bool)
            shared[run[done]] = True
            shared[run[1:][same & ~twin]] = True
            fresh = np.concatenate([[True], ~(twin & (meta[1:] == meta[:-1]))]) if len(key) else done
            out = shared[run] & fresh & ~done
            first = np.concatenate([[True], ~same]) if len(key) else done
            rest = (first & shared[run]) | (~shared[run] & fresh)
            state = [key[rest], node[rest], meta[rest], shared[run][rest]]
            return [key[out], node[out], meta[out]]

        def packed(parts: list[np.ndarray]) -> pa.RecordBatch:
            return _arrow({"key": (parts[0], pa.int64()), "node": (parts[1], pa.int64()), "meta": (parts[2], pa.int32())})

        for batch in batches:
            own = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "node", "meta")]
            description = own[2] < 0
            if description.any():
                yield packed([o[description] for o in own])
                own = [o[~description] for o in own]
            waiting.append([*own, np.zeros(len(own[0]), dtype=bool)])
            size += len(own[0])
            if size > max(HELD_KEYS, len(state[0])):
                yield packed(sifted())
                waiting, size = [], 0
        yield packed(sifted())

    return keys.repartition("key").mapInArrow(keep, "key bigint, node bigint, meta int")


def _described(shared: DataFrame) -> DataFrame:
    """`(node, below, more)`: how many more units a set needs in a role than it has."""
    code = -1 - F.col("meta")
    found = shared.filter("meta < 0").select("node", F.pmod(code, F.lit(2)).alias("below"), (F.shiftright(code, 1) - (1 << 28)).alias("more"))
    return found.dropDuplicates(["node", "below"])


def _chosen(shared: DataFrame, needs: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What each set asks for, `(key, node, n, left, wide)`, and the indexed rows `(key, node, n, left)`.

    A unit costs as many sets as would answer it. The second unit of a segment also asks its one-deletion
    neighbours. Units whose keys nobody shares are free and not even listed here; of the others the cheapest
    are taken until the need is met.
    """
    meta = F.col("meta")
    rows = shared.filter("meta >= 0").select(
        "key",
        "node",
        meta.bitwiseAND(1).alias("below"),
        (meta.bitwiseAND(2) > 0).alias("left"),
        (meta.bitwiseAND(4) > 0).alias("several"),
        F.shiftright(meta, 3).alias("segment"),
    )
    indexed = rows.filter("below = 0").select("key", "node", "left")
    answers = indexed.groupBy("key").agg(
        F.sum(F.when(F.col("left"), 0).otherwise(1)).alias("whole"), F.sum(F.when(F.col("left"), 1).otherwise(0)).alias("parts")
    )
    own = F.when(F.col("below") == 0, 1).otherwise(0)
    segments = (
        rows.join(answers, "key")
        .groupBy("node", "below", "segment")
        .agg(
            F.max(F.when(~F.col("left"), F.col("whole") - own).otherwise(0)).alias("first"),
            F.sum(F.when(F.col("left"), F.col("whole")).otherwise(F.col("parts"))).alias("second"),
            F.max("several").alias("several"),
        )
    )
    # The second unit never comes before the first of its segment.
    second = F.when(F.col("several"), F.greatest("first", "second")).otherwise(0)
    units = F.array(F.struct(F.lit(1).alias("unit"), F.col("first").alias("cost")), F.struct(F.lit(2).alias("unit"), second.alias("cost")))
    items = segments.select("node", "below", "segment", F.explode(F.filter(units, lambda u: u["cost"] > 0)).alias("i")).select(
        "node", "below", "segment", "i.*"
    )
    side = Window.partitionBy("node", "below")
    ranked = items.withColumn("listed", F.count(F.lit(1)).over(side)).withColumn(
        "rank", F.row_number().over(side.orderBy("cost", "unit", "segment"))
    )
    # Need, less the free units: those not listed.
    taken = ranked.join(needs, ["node", "below"]).filter(F.col("rank") <= F.col("more") + F.col("listed"))
    wanted = taken.groupBy("node", "below", "segment").agg(F.max("unit").alias("unit"))
    asked = rows.join(wanted, ["node", "below", "segment"]).filter(~F.col("left") | (F.col("unit") == 2))
    sizes = nodes.select("node", "n")
    asked = checkpointed(asked.join(sizes, "node").select("key", "node", "n", "left", (F.col("unit") == 2).alias("wide")), "asked")
    met = indexed.join(asked.select("key").distinct(), "key", "left_semi")
    return asked, checkpointed(met.join(sizes, "node").select("key", "node", "n", "left"), "indexed")


def _bitmap(values: DataFrame, place: Column, bits: int) -> np.ndarray:
    """Bits at `place`, a number below `bits`: a filter of bounded size in front of an exact join."""
    words = (
        values.select(place.alias("p"))
        .groupBy(F.expr("p div 64").alias("w"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("p", F.lit(64)).cast("int"))).alias("b"))
    )
    out = np.zeros(bits // 64, dtype=np.int64)
    for batch in words.toArrow().to_batches():
        out[batch.column("w").to_numpy()] = batch.column("b").to_numpy()
    return out


def _marked(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bitmap[places >> 6] >> (places & 63)) & 1 > 0


def _sets_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, join: Join) -> DataFrame:
    """`(node, shingles)` of the wanted nodes, made anew from one document of each; other texts are not looked at."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(join.filter_bits))
    chosen = checkpointed(nodes.join(wanted.select("node").distinct(), "node").select("node", F.col("first_id").alias("doc_id")), "wanted")
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(chosen, place, join.filter_bits))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(join)
        for batch in batches:
            use = np.flatnonzero(_marked(bitmap.value, batch.column("place").to_numpy(zero_copy_only=False)))
            sets = [shingler.shingles(batch.column("text")[int(i)].as_py()) for i in use]
            yield _arrow(
                {
                    "node": ([_identity(s)[0] for s in sets], pa.int64()),
                    "shingles": ([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                }
            )

    made = docs.select("text", place.alias("place")).mapInArrow(make, "node bigint, shingles array<bigint>")
    return made.join(chosen.select("node").distinct(), "node").groupBy("node").agg(F.first("shingles").alias("shingles"))


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, join: Join) -> DataFrame:
    """The pairs `(a, b)` whose whole sets are similar enough."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    sets = checkpointed(_sets_of(docs, nodes, ends, join), "pair-sets")
    left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_a")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("_b"))
    both = pairs.join(left, "a").join(right, "b").withColumn("_shared", F.size(F.array_intersect("_a", "_b")))
    union = F.size("_a") + F.size("_b") - F.col("_shared")
    return both.filter(F.col("_shared") * 100 >= union * join.percent).select("a", "b")


def _crowd_pairs(asked: DataFrame, indexed: DataFrame, nodes: DataFrame, labels: DataFrame, join: Join, offers: int | None) -> DataFrame:
    """Candidates `(node, other)` from keys with many sets.

    Sets that crowded keys connect are one crowd. Its sketches are compared in blocks, each pair of blocks in
    a group of its own, so a crowd may be of any size; only pairs of different labels that pass are written. With
    `offers` these are only the nearest so many of each set and block.
    """
    rows = asked.select("key", "node").unionAll(indexed.select("key", "node"))
    hubs = rows.groupBy("key").agg(F.min("node").alias("a"))
    crowd = checkpointed(connected_components(rows.join(hubs, "key").select("a", F.col("node").alias("b"))), "crowds")
    own_label = labels.withColumnRenamed("component", "label")
    members = crowd.join(nodes.select("node", "n", "sketch"), "node").join(own_label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    members = checkpointed(members, "crowd-members")
    blocks = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / CROWD_BLOCK).alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    dealt = members.join(blocks, "component").withColumn("own", own).withColumn("other", other)
    dealt = dealt.select("component", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "n", "label", "sketch")

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        _, low, high = key
        own_block = group["own"].to_numpy()
        n, node, label = (group[c].to_numpy() for c in ("n", "node", "label"))
        sketch = np.stack(group["sketch"].to_numpy()).view(U64)
        left, right = np.flatnonzero(own_block == low), np.flatnonzero(own_block == high)
        found_a, found_b = [], []
        for i in left:
            j = right[(node[right] > node[i]) if low == high else np.ones(len(right), dtype=bool)]
            j = j[(label[j] != label[i]) & (100 * np.minimum(n[j], n[i]) >= join.percent * np.maximum(n[j], n[i]))]
            x = sketch[j] ^ sketch[i]
            x = (x | x >> U64(1) | x >> U64(2) | x >> U64(3)) & U64(0x1111111111111111)
            differing = np.bitwise_count(x).sum(axis=1)
            fits = differing <= (n[j] + n[i]) * (100 - join.percent) // (100 + join.percent)
            j, differing = j[fits], differing[fits]
            if offers and len(j) > offers:
                j = j[np.argsort(differing, kind="stable")[:offers]]
            found_a.append(np.full(len(j), node[i], dtype=np.int64))
            found_b.append(node[j])
        empty = np.zeros(0, dtype=np.int64)
        return pd.DataFrame({"node": np.concatenate([empty, *found_a]), "other": np.concatenate([empty, *found_b])})

    return dealt.groupBy("component", "low", "high").applyInPandas(compare, "node bigint, other bigint")


def _close(pairs: DataFrame, nodes: DataFrame, join: Join) -> DataFrame:
    """Pairs `(a, b)` whose sketches leave open that they are similar."""
    info = nodes.select("node", "n", "sketch")
    for end in "ab":
        pairs = pairs.join(info.select(*[F.col(c).alias(t) for c, t in (("node", end), ("n", f"_n{end}"), ("sketch", f"_s{end}"))]), end)
    differing = _sketch_difference("_sa", "_sb")
    return pairs.filter(f"{differing} <= (_na + _nb) * {100 - join.percent} div {100 + join.percent}").select("a", "b")


def _sketch_difference(a: str, b: str) -> str:
    """Number of places where two sketches differ, as SQL."""
    x = [f"({a}[{i}] ^ {b}[{i}])" for i in range(PLACES // 16)]
    return " + ".join(f"bit_count(({v} | shiftright({v}, 1) | shiftright({v}, 2) | shiftright({v}, 3)) & 1229782938247303441)" for v in x)


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _leftover_pairs(docs: DataFrame, nodes: DataFrame, leftovers: DataFrame, join: Join) -> DataFrame:
    """Candidates of the few sets whose segments can't give the units they need: all that share a shingle."""
    own = checkpointed(_sets_of(docs, nodes, leftovers, join).select(F.col("node").alias("x"), F.explode("shingles").alias("shingle")), "leftovers")
    bits = join.filter_bits
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(own, F.pmod("shingle", F.lit(bits)), bits))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(join)
        for batch in batches:
            for text in batch.column("text"):
                shingles = shingler.shingles(text.as_py())
                hit = shingles.view(np.int64)[_marked(bitmap.value, shingles.view(np.int64) % bits)] if len(shingles) else []
                if len(hit):
                    yield _arrow({"shingle": (hit, pa.int64()), "y": (np.full(len(hit), _identity(shingles)[0]), pa.int64())})

    others = docs.select("text").mapInArrow(make, "shingle bigint, y bigint")
    return others.join(own, "shingle").filter("x <> y").select(*_ordered(F.col("x"), F.col("y"))).distinct()


def similar_documents(docs: DataFrame, join: Join = Join(), *, hub_rounds: int = 1) -> DataFrame:
    """One row per row of `docs(doc_id, text)`: `doc_id, n_shingles, component_id`.

    Words are lower-cased (A-Z) and cut at ASCII white space; a set has all distinct shingles of the whole
    text, a text with fewer words than a shingle is one shingle, and one without words is empty and linked
    with nothing. Documents link at `percent` or more; `component_id` is the smallest id reachable. Equal sets
    are one node from the start. Rows with a null id are described but link with nothing; rows with equal
    ids are one document with several texts. Hashes of 64 bits stand for shingles and sets.

    Links are not written out: inside a list of sets with one key, each asking set first meets one hub; only
    sets that are still in different components afterwards meet each other. In a crowd each of them first offers to
    its nearest sets only, as in Boruvka's method; what is still apart after that meets all the rest.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    named = docs.filter(F.col("doc_id").isNotNull())
    sets = checkpointed(_sets(docs, join), "sets")
    usable = sets.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    nodes = checkpointed(
        usable.groupBy("node", "twin").agg(F.min("doc_id").alias("first_id"), F.max("n").alias("n"), F.first("sketch").alias("sketch")),
        "nodes",
    )
    shared = checkpointed(_shared_only(_keys(named, join)), "shared-keys")
    needs = checkpointed(_described(shared), "needs")
    asked, indexed = _chosen(shared, needs, nodes)
    leftovers = checkpointed(needs.filter("more > 0").select("node").distinct(), "leftover-nodes")
    # Texts of one id are one document.
    links = checkpointed(_same_id(usable), "links-by-id")
    fitting = f"100 * least(n, other_n) >= {join.percent} * greatest(n, other_n)"
    labels: DataFrame | None = None
    tested: DataFrame | None = None
    for turn in range(hub_rounds + 2):
        if labels is not None:
            asked, indexed = _open_keys(asked, indexed, labels)
        open_asked, open_indexed = asked, indexed
        pairs, crowds, crowded = None, None, None
        if turn < hub_rounds:
            hub = F.min_by(F.struct("node", "n"), F.xxhash64("node", F.lit(turn))).alias("hub")
            hubs = open_indexed.groupBy("key").agg(hub).select("key", F.col("hub.node").alias("other"), F.col("hub.n").alias("other_n"))
            pairs = open_asked.join(hubs, "key").filter(f"node <> other and {fitting}").select(*_ordered(F.col("node"), F.col("other"))).distinct()
        else:
            full = open_indexed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > CROWD)
            crowded = checkpointed(full.select("key"), "crowded-keys")
            last = crowded.isEmpty() or turn > hub_rounds
            if not crowded.isEmpty():
                offers = OFFERS if turn == hub_rounds else None
                crowds = _crowd_pairs(open_asked.join(crowded, "key"), open_indexed.join(crowded, "key"), nodes, labels, join, offers)
                crowds = crowds.select(*_ordered(F.col("node"), F.col("other")))
        if turn == hub_rounds:
            few_asked, few_indexed = (x.join(crowded, "key", "left_anti") for x in (open_asked, open_indexed))
            others = few_indexed.select("key", *[F.col(c).alias(f"other{suffix}") for c, suffix in (("node", ""), ("n", "_n"), ("left", "_left"), ("label", "_label"))])
            met = few_asked.join(others, "key").filter(f"label <> other_label and (not other_left or (wide and not left)) and {fitting}")
            pairs = met.select(*_ordered(F.col("node"), F.col("other"))).distinct()
            if leftovers.limit(1).count():
                pairs = pairs.unionAll(_leftover_pairs(named, nodes, leftovers, join)).distinct()
        if pairs is not None:
            pairs = _close(pairs, nodes, join)
        if crowds is not None:
            # The sketches of crowds have been compared already.
            pairs = crowds if pairs is None else pairs.unionAll(crowds)
        if pairs is None:
            break
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        if crowds is not None:
            pairs = pairs.distinct()
        pairs = checkpointed(pairs, "pairs")
        if pairs.limit(1).count():
            links = links.unionAll(checkpointed(_verified(pairs, named, nodes, join), "verified"))
            labels = checkpointed(connected_components(links), "labels")
        elif labels is None:
            labels = checkpointed(connected_components(links), "labels")
        tested = pairs if tested is None else tested.unionAll(pairs)
        if turn >= hub_rounds and last:
            break
    known = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node"))
    least = known.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named_nodes = known.join(least, "label").select("node", "twin", "component_id")
    linked = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    out = sets.join(named_nodes, ["node", "twin"], "left")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(linked, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def _same_id(usable: DataFrame) -> DataFrame:
    several = usable.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("c")).filter("a <> c")
    return usable.join(several, "doc_id").filter("node <> a").select("a", F.col("node").alias("b"))


def _open_keys(asked: DataFrame, indexed: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the keys whose sets are not all in one component yet, with their labels, stored: they are few.

    Components only merge, so a key that is settled stays so, and the next turn looks at these alone.
    """

    def labelled(rows: DataFrame) -> DataFrame:
        return rows.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")

    asked, indexed = labelled(asked), labelled(indexed)
    both = asked.select("key", "label").unionAll(indexed.select("key", "label"))
    mixed = both.groupBy("key").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).filter("_low <> _high").select("key")
    mixed = checkpointed(mixed, "open-keys")
    return checkpointed(asked.join(mixed, "key"), "open-asked"), checkpointed(indexed.join(mixed, "key"), "open-indexed")


def one_per_group(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """`docs` without near-duplicates: of each component the document with the smallest id stays.

    Rows with a null id all stay. Of repeated rows of one id one of each set of shingles stays, the one with the
    smallest text. Columns of any name and type are kept.
    """
    docs, named_back = set_aside(docs, ["_rows", "_node", "_twin", "_first"])
    return named_back(_first_of_groups(docs, join))


def _first_of_groups(docs: DataFrame, join: Join) -> DataFrame:
    groups = similar_documents(docs, join).filter("doc_id is not null and doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows"))
    groups = checkpointed(groups, "kept")
    rest = docs.filter(F.col("doc_id").isNull())
    if not groups.filter("_rows > 1").limit(1).count():
        return docs.join(groups, "doc_id", "left_semi").unionByName(rest)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(join)
        for batch in batches:
            names = [_identity(shingler.shingles(text.as_py())) for text in batch.column("text")]
            added = {"_node": pa.array([int(n[0]) for n in names], pa.int64()), "_twin": pa.array([int(n[1]) for n in names], pa.int64())}
            yield pa.RecordBatch.from_arrays([*batch.columns, *added.values()], names=[*batch.schema.names, *added])

    schema = T.StructType([*docs.schema.fields, T.StructField("_node", T.LongType()), T.StructField("_twin", T.LongType())])
    repeated = docs.join(groups.filter("_rows > 1"), "doc_id", "left_semi").mapInArrow(name, schema)
    first = repeated.groupBy("doc_id", "_node", "_twin").agg(F.min_by(F.struct(*docs.columns), F.coalesce("text", F.lit(""))).alias("_first")).select("_first.*")
    return docs.join(groups.filter("_rows = 1"), "doc_id", "left_semi").unionByName(first).unionByName(rest)
