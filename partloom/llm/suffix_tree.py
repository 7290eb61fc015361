"""Language-model scores from a probabilistic suffix tree over tokens.

States are contexts of one to three tokens. A context is a state if its next-token distribution differs enough
from that of the context that is one token shorter. A state lists the next tokens seen at least twice after
it, smoothed with its parent; all others have the parent's probability, scaled to the rest. The root covers
every token: tokens without training counts are one unknown symbol with the mass of first occurrences
(Witten and Bell).

All counts cover all training texts, and the tree grows with them: states and entries are Spark tables. Hashes
of 64 bits stand for words and sequences of words. What reaches the driver or every task is only a cache of the
most frequent, at most one per share of all tokens, and bitmaps of fixed size.

Most sequences occur once and are of no use. The texts are read once per length, the shorter first: a sequence is
counted only if both its parts, one token shorter, have their bits in a bitmap of all that occur twice. Two sequences
at one bit cost work and change nothing, since counts go by the whole hash. What is shuffled at a time is one length,
and of a fuller bitmap only a part of it, so the disk in use follows the number of tokens.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pandas.util import hash_array
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from partloom.llm.text import LOWER, UPPER
from partloom.session import scratch_path

LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())
FLUSH_ENTRIES = 500_000
SLICE_TEXTS = 500  # worked on together
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BUCKET = 1 << 20  # sequences that are counted, or meet their values, together
PARTS = 12  # buckets are a multiple of this, so that up to four rounds take equal parts
WORD_BUCKETS = 1 << 10  # for counting words, whose number is not known before
KNOWN, ASKED, FREQUENT, STATE, ENTRY = range(5)  # what a list of a bucket of a level holds
GROUP_BITS = 12  # texts of a group, as a power of two
WORDS, VALUES, SEEN, OWN = range(4)  # what a list of a bucket holds, in the order of arrival
BLOCK_BITS = 16  # bits of a block of a bitmap, as a power of two
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LONG_WORD = 64  # bytes; a multiple of 8
LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
END = b"\xff"  # the token at the end of every text; no byte of a text in UTF-8


@dataclass(frozen=True)
class Shares:
    """What the tree holds, and what every task gets of it."""

    head: float = 2e-6  # share of all tokens from which a word or sequence has its value in every task
    least: int = 2  # occurrences of a context and next token together
    depth: int = 3  # tokens of the longest context
    filter_bits: int = 1 << 28  # bits that tell what occurs twice, and what has a value


def tokens_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case and the end; `split` of bytes cuts at the six ASCII white-space characters."""
    tokens = (text or "").encode().translate(LOWERED).split()
    tokens.append(END)
    return tokens


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is shuffled for a result is deleted as soon as that is stored or collected."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


class _Steps:
    """Tables in the shared folder that cut lineage, each deleted once nothing reads it any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def store(self, df: DataFrame, name: str) -> DataFrame:
        return self.union([df], name)

    def union(self, parts: Iterable[DataFrame], name: str) -> DataFrame:
        """Stores the rows of all parts, one part after another."""
        path = self.paths[name] = scratch_path(self.spark, name)
        for df in parts:
            # Dictionaries of hashes would only be given up again.
            plain = {f"parquet.enable.dictionary#{x}": "false" for x in ("gram", "context", "parent") if x in df.columns}
            with _shuffles_freed(self.spark):
                df.write.options(**plain).mode("append").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def free(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _batch(columns: dict[str, tuple[object, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


def vocabulary(docs: DataFrame, trained: Column) -> DataFrame:
    """`(gram, c, n)`: hash of a word, occurrences in training texts and in all texts. Counts are summed per task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = []

        def flush(rows: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
            grams, c, n = rows
            yield from _lists(_dealt(grams, WORD_BUCKETS), {"grams": grams, "c": c.astype(np.uint32), "n": n.astype(np.uint32)})

        for batch in batches:
            texts, trains = batch.column("text"), batch.column("trained").to_numpy(zero_copy_only=False)
            for low in range(0, len(texts), SLICE_TEXTS):
                ids, starts = _hashed(texts.slice(low, SLICE_TEXTS))
                own = np.repeat(trains[low : low + SLICE_TEXTS], np.diff(np.append(starts, len(ids))))
                waiting.append(_summed([(ids, own.astype(np.int64), np.ones(len(ids), dtype=np.int64))]))
                if sum(len(x[0]) for x in waiting) > 2 * FLUSH_ENTRIES:
                    waiting = [_summed(waiting)]
                    if len(waiting[0][0]) > FLUSH_ENTRIES:
                        yield from flush(waiting.pop())
        if waiting:
            yield from flush(_summed(waiting))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, lists in _buckets(batches, {"grams": np.int64, "c": np.uint32, "n": np.uint32}):
            waiting = []
            for _, grams, c, n in lists:
                waiting.append((grams, c.astype(np.int64), n.astype(np.int64)))
                if sum(len(x[0]) for x in waiting) > max(2 * FLUSH_ENTRIES, 2 * len(waiting[0][0])):
                    waiting = [_summed(waiting)]
            rows = _summed(waiting)
            for at in range(0, len(rows[0]), 50_000):
                yield _batch({k: (x[at : at + 50_000], pa.int64()) for k, x in zip(("gram", "c", "n"), rows)})

    rows = docs.select("text", F.coalesce(trained, F.lit(False)).alias("trained"))
    dealt = rows.mapInArrow(count, "bucket bigint, grams binary, c binary, n binary")
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add_up, "gram bigint, c bigint, n bigint")


def _summed(rows: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """`(gram, c, n)` with one entry per gram, in order of the hashes as unsigned numbers."""
    grams, c, n = (np.concatenate(x) for x in zip(*rows))
    order = np.argsort(grams.view(np.uint64))
    grams = grams[order]
    firsts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])[: len(grams)])
    if not len(firsts):
        return grams, c, n
    return grams[firsts], np.add.reduceat(c[order], firsts), np.add.reduceat(n[order], firsts)


def _word_hashes(whole: bytes) -> np.ndarray:
    """Hashes of the words of `whole`, in order.

    All at once, by eight bytes at a time; the few that are long one by one. None is remembered, since a worker's memory
    would fill with words that are seldom met again.
    """
    data = np.frombuffer(whole + b" " * 8, dtype=np.uint8)
    edges = np.flatnonzero(np.diff(BLANK[data], prepend=True))
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    eights = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    hashes, at = sizes.astype(np.uint64), np.arange(len(starts))
    for done in range(0, LONG_WORD, 8):
        at = at[sizes[at] > done] if done else at
        part = eights[starts[at] + done] & LOW_BYTES[np.minimum(sizes[at] - done, 8)]
        hashes[at] = _mixed(hashes[at] * MULTIPLIER + part)
    for i in at[sizes[at] > LONG_WORD]:
        hashes[i] = hash_array(np.array([whole[starts[i] : starts[i] + sizes[i]]], dtype=object), categorize=False)[0]
    return hashes.view(np.int64)


class _WordHashes:
    """Hashes of single words."""

    def __getitem__(self, word: bytes) -> int:
        return int(_word_hashes(word)[0])


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of a batch, and where each text begins."""
    whole = b" \xff ".join([*(t or b"" for t in texts.cast(pa.binary()).to_pylist()), b""])
    ids = _word_hashes(whole.translate(LOWERED))
    ends = np.flatnonzero(ids == END_HASH)
    return ids, np.append(0, ends[:-1] + 1) if len(ends) else ends


def _longer(grams: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the `n` tokens that end at each place, from those of `n - 1` tokens."""
    return _joined(np.concatenate([grams[:1], grams[:-1]]), grams, n)


def _joined(context: np.ndarray, parent: np.ndarray, n: int) -> np.ndarray:
    """Hash of the `n` tokens of which `context` are all but the last and `parent` all but the first."""
    u = np.uint64
    with np.errstate(over="ignore"):
        return _mixed(context.view(u) * MULTIPLIER + parent.view(u) + u(n)).view(np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


END_HASH = _WordHashes()[END]


def _depths(starts: np.ndarray, size: int) -> np.ndarray:
    """Places of tokens in their texts, from 0."""
    return np.arange(size) - np.repeat(starts, np.diff(np.append(starts, size)))


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(65 - bits.bit_length())).astype(np.uint32)


def _marked(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    places = _places(hashes, len(bitmap) * 8)
    return (bitmap[places >> 3] >> (places & 7).astype(np.uint8)) & 1 > 0


def _bitmap(lists: DataFrame, bits: int) -> np.ndarray:
    """Bits of the hashes in lists `grams`: a filter of bounded size in front of an exact count or join.

    Full, it lets all pass. Tasks send each place once, as two bytes in the list of its block. The lists of a block
    arrive one after another at one task, which holds the bits of one block at a time.
    """
    size = min(bits, 1 << BLOCK_BITS)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = []

        def flush() -> Iterator[pa.RecordBatch]:
            places = np.sort(np.concatenate(waiting))
            places = places[np.concatenate([[True], places[1:] != places[:-1]])]
            waiting.clear()
            yield from _lists((places >> np.uint32(BLOCK_BITS)).astype(np.int64), {"places": (places & np.uint32(size - 1)).astype(np.uint16)})

        for batch in batches:
            for grams in batch.column("grams").to_pylist():
                waiting.append(_places(np.frombuffer(grams, dtype=np.int64), bits))
                if sum(len(x) for x in waiting) > 4 * FLUSH_ENTRIES:
                    yield from flush()
        if sum(len(x) for x in waiting):
            yield from flush()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_block, met = -1, np.zeros(size, dtype=bool)

        def packed() -> pa.RecordBatch:
            return _batch({"block": ([open_block], pa.int64()), "bits": ([np.packbits(met, bitorder="little").tobytes()], pa.binary())})

        for batch in batches:
            for block, places in zip(batch.column("bucket").to_pylist(), batch.column("places").to_pylist()):
                if block != open_block:
                    if open_block >= 0:
                        yield packed()
                    open_block, met[:] = block, False
                met[np.frombuffer(places, dtype=np.uint16)] = True
        if open_block >= 0:
            yield packed()

    out = np.zeros((bits // size, size // 8), dtype=np.uint8)
    met = lists.select("grams").mapInArrow(meet, "bucket bigint, places binary").repartition("bucket").sortWithinPartitions("bucket")
    with _shuffles_freed(lists.sparkSession):
        marked = met.mapInArrow(add_up, "block bigint, bits binary").toArrow()
    for batch in marked.to_batches():
        for block, bits_of in zip(batch.column("block").to_pylist(), batch.column("bits").to_pylist()):
            out[block] = np.frombuffer(bits_of, dtype=np.uint8)
    return out.reshape(-1)


def _rounds(bitmap: np.ndarray) -> int:
    """In how many parts to shuffle what passes: the fuller the bitmap, the more does, up to all. At most four."""
    return 1 + int(3 * np.bitwise_count(bitmap).sum() / (8 * len(bitmap)))


def _dealt(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of hashes, which rise with the hash as an unsigned number."""
    return ((hashes.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _buckets(batches: Iterator[pa.RecordBatch], types: dict[str, type]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """The rows of each bucket in turn: their kind, if they have one, and their lists."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            kinds = batch.column("kind").to_pylist() if "kind" in batch.schema.names else [None] * batch.num_rows
            yield from zip(batch.column("bucket").to_pylist(), kinds, *(batch.column(x).to_pylist() for x in types))

    for bucket, own in itertools.groupby(rows(), key=lambda row: row[0]):
        yield bucket, ((kind, *(np.frombuffer(x, dtype=t) for x, t in zip(lists, types.values()))) for _, kind, *lists in own)


def _lists(keys: np.ndarray, columns: dict[str, np.ndarray], **same: int) -> Iterator[pa.RecordBatch]:
    """One row per key: the `columns` of its entries as binary lists, and the same value in each of the others."""
    if not len(keys):
        return
    if (keys[1:] < keys[:-1]).any():
        order = np.argsort(keys.astype(np.uint16) if keys.max() < 1 << 16 else keys, kind="stable")  # few keys: by their digits
        keys = keys[order]
        columns = {name: values[order] for name, values in columns.items()}
    firsts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    ends = np.append(firsts[1:], len(keys))
    for at in range(0, len(firsts), 1000):
        part = slice(at, at + 1000)
        n = len(firsts[part])
        out = {"bucket": pa.array(keys[firsts[part]], pa.int64()), **{k: pa.array(np.full(n, v), pa.int64()) for k, v in same.items()}}
        for name, values in columns.items():
            cuts = (np.append(firsts[part], ends[part][-1:]) - firsts[at]) * values[:1].nbytes
            data = np.ascontiguousarray(values[firsts[at] : ends[part][-1]])
            out[name] = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)])
        yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))


def _merged(rows: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """`(gram, context, parent, c)` with one entry per sequence, in order of the hashes as unsigned numbers."""
    grams, context, parent, c = (np.concatenate(x) for x in zip(*rows))
    order = np.argsort(grams.view(np.uint64))
    grams = grams[order]
    firsts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    kept = order[firsts]
    return grams[firsts], context[kept], parent[kept], np.add.reduceat(c[order], firsts)


def gram_counts(docs: DataFrame, trained: Column, n: int, buckets: int, frequent, marks=None, rounds: int = 1) -> Iterator[DataFrame]:
    """Lists `(context, parent, c)`: how often `n` tokens follow each other in training texts, if twice or more; one table a round.

    `context` are all tokens but the last, `parent` all but the first. Neither is rarer than the whole, so only
    sequences are counted whose context and parent have their bits in `marks`, a broadcast bitmap of all sequences
    of `n - 1` tokens that occur twice; without it all are. Each round takes its share of the buckets. Context and
    parent tell a sequence, so its own hash is made anew after the shuffle. Tasks send each sequence once, in lists by
    buckets of hashes. The lists that are returned are dealt by the parent, or by the sequence if the parent is `frequent`.
    """

    def of_round(turn: int) -> DataFrame:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            waiting = []

            def flush(rows: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
                grams, context, parent, c = rows
                yield from _lists(_dealt(grams, buckets), {"context": context, "parent": parent, "c": c})

            for batch in batches:
                texts = batch.column("text")
                for low in range(0, len(texts), SLICE_TEXTS):
                    ids, starts = _hashed(texts.slice(low, SLICE_TEXTS))
                    depths, shorter = _depths(starts, len(ids)), ids
                    for k in range(2, n):
                        shorter = _longer(shorter, k)
                    wanted = depths[1:] >= n - 1
                    if marks is not None:
                        marked = _marked(marks.value, shorter)
                        wanted &= marked[1:] & marked[:-1]
                    at = np.flatnonzero(wanted) + 1
                    context, parent = shorter[at - 1], shorter[at]
                    grams = _joined(context, parent, n)
                    if rounds > 1:
                        own = _dealt(grams, buckets) % rounds == turn
                        grams, context, parent = grams[own], context[own], parent[own]
                    waiting.append((grams, context, parent, np.ones(len(grams), dtype=np.int64)))
                    if sum(len(x[0]) for x in waiting) > 3 * FLUSH_ENTRIES:
                        waiting = [_merged(waiting)]
                        if len(waiting[0][0]) > 1.5 * FLUSH_ENTRIES:
                            yield from flush(waiting.pop())
            if sum(len(x[0]) for x in waiting):
                yield from flush(_merged(waiting))

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, out = _Values(*frequent.value), _Out(lambda rows: _lists(rows[0], dict(zip(("a", "b", "c", "d"), rows[1:])), kind=ASKED))
            for _, lists in _buckets(batches, {"context": np.int64, "parent": np.int64, "c": np.int64}):
                waiting = []
                for _, context, parent, c in lists:
                    waiting.append((_joined(context, parent, n), context, parent, c))
                    if len(waiting) > 1 and sum(len(x[0]) for x in waiting) > max(3 * FLUSH_ENTRIES, 2 * len(waiting[0][0])):
                        waiting = [_merged(waiting)]
                rows = _merged(waiting)
                grams, context, parent, c = (x[rows[3] > 1] for x in rows)
                deal = _dealt(np.where(known.find(parent)[0], grams, parent), buckets)
                yield from out.add(deal, context, parent, c, np.zeros(len(c), dtype=np.uint8))
            yield from out.flush()

        rows = docs.filter(F.coalesce(trained, F.lit(False))).select("text")
        dealt = rows.mapInArrow(count, "bucket bigint, context binary, parent binary, c binary")
        dealt = dealt.repartition("bucket").sortWithinPartitions("bucket")
        return dealt.mapInArrow(add_up, LISTS)

    return map(of_round, range(rounds))


class _Out:
    """Rows that wait until there are enough to be sent in lists."""

    def __init__(self, send):
        self.send, self.waiting = send, []

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.waiting.append(columns)
        if sum(len(x[0]) for x in self.waiting) > FLUSH_ENTRIES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.waiting:
            rows = [np.concatenate(x) for x in zip(*self.waiting)]
            self.waiting.clear()
            yield from self.send(rows)


def _sums(context: np.ndarray, c: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, ...]:
    """Contexts in order, and of each: listed sequences, their occurrences, expected mass and divergence; last, the place of each row's."""
    order = np.argsort(context)
    context, c, e = context[order], c[order], e[order]
    new = np.concatenate([[True], context[1:] != context[:-1]])[: len(context)]
    firsts = np.flatnonzero(new)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    if not len(firsts):
        return context, c, c, e, e, place
    k, add = np.diff(np.append(firsts, len(context))), np.add.reduceat
    return context[firsts], k, add(c, firsts), add(e, firsts), add(c * np.log(c / e), firsts), place


def _states(k, listed, mass, g, total, penalty: float) -> tuple[np.ndarray, ...]:
    """Of contexts: whether they are states, their weight, total and factor."""
    total = np.maximum(total, listed)
    rest, left, weight = total - listed, np.maximum(1e-12, 1 - mass), k + 1.0
    gain = g - listed * np.log(np.maximum(total, 1).astype(np.float64))
    gain = gain + np.where(rest > 0, rest * np.log(np.where(rest > 0, rest / np.maximum(total, 1) / left, 1.0)), 0.0)
    own = (listed + weight * mass) / (total + weight)
    return gain > penalty * k, weight, total, np.log10(np.maximum(1e-12, 1 - own) / left)


def _entries(c, e, state, weight, total, factor) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of sequences by their longest state, and their values, which are none without a state."""
    p = np.where(state, (c + weight * e) / (total + weight), e)
    return p, np.where(state, np.log10(p / e) - factor, np.nan)


LISTS = "bucket bigint, kind bigint, a binary, b binary, c binary, d binary"
LEVEL = "bucket bigint, kind bigint, grams binary, c binary, p binary, value binary"


def _level(steps: _Steps, counts: DataFrame, shorter: DataFrame, frequent, penalty: float, buckets: int, n: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The level of `n` tokens: lists of states of `n - 1` tokens and of sequences of `n`, and the frequent states with their factors.

    `counts` and `shorter`, the level before, are lists by buckets; `frequent` has `gram, (c, p)` of the frequent ones of it.
    The lists of sequences meet those of their parents, and then those of their contexts. What has a frequent parent or
    context stays in buckets of its own hash, so no bucket is hot: sums of frequent contexts come from all buckets.
    As no part of a sequence is rarer than the whole, each context and parent is there.
    """
    known = shorter.filter(F.col("kind") == ENTRY)
    nothing = F.lit(b"")

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = _Values(*frequent.value)
        out = [_Out(lambda rows, kind=kind: _lists(rows[0], dict(zip("abcd", rows[1:])), kind=kind)) for kind in (ASKED, FREQUENT)]
        for _, lists in _buckets(batches, {"a": np.int64, "b": np.int64, "c": np.int64, "d": np.float64}):
            offers, values = [], None
            for kind, a, b, c, d in lists:
                if kind == KNOWN:
                    offers.append((a, d))
                    continue
                values = values or _Values(*(np.concatenate(x) for x in zip(*offers))) if offers else values
                e = np.zeros(len(a))
                hit, own = often.find(b)
                e[hit] = own[:, 1]
                if values:
                    rest = np.flatnonzero(~hit)
                    hit, own = values.find(b[rest])
                    e[rest[hit]] = own
                grams = _joined(a, b, n)
                many = often.find(a)[0]
                for of, which in zip(out, (~many, many)):
                    yield from of.add(_dealt((grams if of is out[1] else a)[which], buckets), grams[which], a[which], c[which], e[which])
        for of in out:
            yield from of.flush()

    parents = known.select("bucket", F.lit(KNOWN).cast("bigint").alias("kind"), F.col("grams").alias("a"), nothing.alias("b"), nothing.alias("c"), F.col("p").alias("d"))
    both = parents.unionByName(counts.withColumn("d", nothing)).repartition("bucket").sortWithinPartitions("bucket", "kind")
    expected = steps.store(both.mapInArrow(expect, LISTS), "expected")

    def partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            columns = _sums(*rows)[:5]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield _batch({k: (x, t) for k, x, t in zip(("gram", "k", "listed", "mass", "g"), columns, types)})

        out = _Out(summed)
        for _, lists in _buckets(batches, {"b": np.int64, "c": np.int64, "d": np.float64}):
            for _, context, c, e in lists:
                yield from out.add(context, c, e)
        yield from out.flush()

    sums = expected.filter(F.col("kind") == FREQUENT).mapInArrow(partly, "gram bigint, k bigint, listed bigint, mass double, g double")
    with _shuffles_freed(steps.spark):
        sums = sums.groupBy("gram").agg(*(F.sum(x).alias(x) for x in ("k", "listed", "mass", "g"))).toArrow()
    grams, k, listed, mass, g = (sums.column(x).to_numpy() for x in ("gram", "k", "listed", "mass", "g"))
    of_grams, of_values = frequent.value
    totals = _Values(of_grams, of_values[:, 0]).find(grams)[1]
    state, weight, total, factor = _states(k, listed, mass, g, totals, penalty)
    kept = np.column_stack([weight, total, factor])[state]
    many = steps.spark.sparkContext.broadcast((grams[state], kept))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = _Values(*many.value)
        out = [_Out(lambda rows, kind=kind: _lists(rows[0], dict(zip(("grams", "c", "p", "value"), rows[1:])), kind=kind)) for kind in (STATE, ENTRY)]
        for _, lists in _buckets(batches, {"a": np.int64, "b": np.int64, "c": np.int64, "d": np.float64}):
            totals, own = [], []
            for kind, a, b, c, d in lists:
                if kind == KNOWN:
                    totals.append((a, c))
                elif kind == ASKED:
                    own.append((a, b, c, d))
                else:
                    hit, found = often.find(b)
                    weight, total, factor = np.ones((3, len(a)))
                    weight[hit], total[hit], factor[hit] = found.T
                    yield from out[1].add(_dealt(a, buckets), a, c, *_entries(c, d, hit, weight, total, factor))
            if own:
                grams, context, c, e = (np.concatenate(x) for x in zip(*own))
                contexts, k, listed, mass, g, place = _sums(context, c, e)
                total = _Values(*(np.concatenate(x) for x in zip(*totals))).find(contexts)[1]
                state, weight, total, factor = _states(k, listed, mass, g, total, penalty)
                none = np.zeros(int(state.sum()))
                yield from out[0].add(_dealt(contexts[state], buckets), contexts[state], total[state], none, factor[state])
                yield from out[1].add(_dealt(grams, buckets), grams, c, *_entries(c, e, *(x[place] for x in (state, weight, total, factor))))
        for of in out:
            yield from of.flush()

    contexts = known.select("bucket", F.lit(KNOWN).cast("bigint").alias("kind"), F.col("grams").alias("a"), nothing.alias("b"), "c", nothing.alias("d"))
    both = contexts.unionByName(expected).repartition("bucket").sortWithinPartitions("bucket", "kind")
    level = steps.store(both.mapInArrow(settle, LEVEL), f"level-{n}")
    steps.free("expected")
    many.destroy()
    return level, grams[state], factor[state]


def _found(table: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(codes), dtype=bool), np.zeros(len(codes), dtype=np.int64)
    place = np.minimum(np.searchsorted(table, codes), len(table) - 1)
    return table[place] == codes, place


class _Values:
    """Sums of the values of each hash, by a hash table."""

    def __init__(self, grams: np.ndarray, values: np.ndarray):
        order = np.argsort(grams)
        grams = grams[order]
        firsts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])[: len(grams)])
        self.values = np.add.reduceat(values[order], firsts) if len(firsts) else values
        self.places = pd.Index(grams[firsts])

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are there, and the values of those."""
        place = self.places.get_indexer(grams)
        hit = place >= 0
        return hit, self.values[place[hit]]


@dataclass(frozen=True)
class Tree:
    """The tree: a table of words `(gram, c, n)`, and lists `(grams, entries)` of states and listed sequences by buckets, a table a level.

    The value of a state is log10 of what it leaves to tokens that it does not list; that of a listed sequence is log10 of
    what its probability is above the product of its parent's and the factor. The frequent ones are kept apart.
    """

    words: DataFrame
    levels: dict[int, DataFrame]
    states: dict[int, tuple[np.ndarray, np.ndarray]]  # of one token less than the level
    frequent: dict[int, tuple[np.ndarray, np.ndarray]]  # listed sequences
    tokens: int  # in training texts
    kinds: int
    often: int  # occurrences from which words and sequences have their values in every task
    buckets: int
    steps: _Steps  # which has the tables

    def of_words(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known or not, log10 probability by frequency, and at the root, of words with `c` training occurrences."""
        return _of_words(c, self.tokens, self.kinds)


def _of_words(c: np.ndarray, tokens: int, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    known = c > 0
    base = np.log10((c + 0.5) / (tokens + 0.5 * (kinds + 1)))
    root = np.full(len(c), math.log10(kinds / (tokens + kinds)) if kinds else 0.0)
    root[known] = np.log10(c[known] / float(tokens + kinds))
    return known, base, root


def build(docs: DataFrame, trained: Column, shares: Shares = Shares()) -> Tree:
    spark = docs.sparkSession
    steps = _Steps(spark)
    words = steps.store(vocabulary(docs, trained), "words")
    totals = words.agg(F.sum("c"), F.sum((F.col("c") > 0).cast("bigint")), F.sum("n")).first()
    tokens, kinds, all_tokens = (int(x or 0) for x in totals)
    often = max(1, math.ceil(shares.head * all_tokens))
    buckets = PARTS * (1 + tokens // (PARTS * BUCKET))
    mass = float(max(1, tokens + kinds))

    def listed_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, c = (batch.column(x).to_numpy() for x in ("gram", "c"))
            yield from _lists(_dealt(grams, buckets), {"grams": grams, "c": c, "p": c / mass, "value": np.zeros(len(c))}, kind=ENTRY)

    def frequent_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, lists in _buckets(batches, {"grams": np.int64, "c": np.int64, "p": np.float64, "value": np.float64}):
            for _, grams, c, p, value in lists:
                own = c >= often
                types = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
                yield _batch({k: (x[own], t) for k, x, t in zip(("gram", "c", "p", "value"), (grams, c, p, value), types)})

    def seldom_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What scoring needs of a level: next to the frequent ones, that is what has a value."""
        for bucket, lists in _buckets(batches, {"grams": np.int64, "c": np.int64, "value": np.float64}):
            for kind, grams, c, value in lists:
                own = ~np.isnan(value) & ((c < often) | (kind == STATE))
                yield from _lists(np.full(int(own.sum()), bucket), {"grams": grams[own], "entries": value[own]}, kind=kind)

    # At most 1 / shares.head of each length.
    found = words.filter((F.col("c") > 1) & (F.col("n") >= often)).select("gram", "c").toArrow()
    c = found.column("c").to_numpy()
    hot = found.column("gram").to_numpy(), np.column_stack([c, c / mass])
    level = words.filter(F.col("c") > 1).select("gram", "c").mapInArrow(listed_words, LEVEL)
    levels, states, frequent, marks, rounds = {}, {}, {}, None, 1
    for n in range(2, shares.depth + 2):
        known = spark.sparkContext.broadcast(hot)
        counts = steps.union(gram_counts(docs, trained, n, buckets, known, marks, rounds), "grams")
        if marks:
            marks.destroy()
        level, *states[n] = _level(steps, counts, level, known, 0.5 * math.log(max(tokens, 2)), buckets, n)
        known.destroy()
        steps.free("grams", *([f"level-{n - 1}"] if n > 2 else []))
        levels[n] = steps.store(level.mapInArrow(seldom_values, "bucket bigint, kind bigint, grams binary, entries binary"), f"values-{n}")
        entries = level.filter(F.col("kind") == ENTRY)
        found = entries.mapInArrow(frequent_of, "gram bigint, c bigint, p double, value double").toArrow()
        grams, c, p, value = (found.column(x).to_numpy() for x in ("gram", "c", "p", "value"))
        hot = grams, np.column_stack([c, p])
        frequent[n] = grams[~np.isnan(value)], value[~np.isnan(value)]
        if n <= shares.depth:
            bitmap = _bitmap(entries, shares.filter_bits)
            marks, rounds = spark.sparkContext.broadcast(bitmap), _rounds(bitmap)
    steps.free(f"level-{shares.depth + 1}")
    return Tree(words, levels, states, frequent, tokens, kinds, often, buckets, steps)


def values(docs: DataFrame, trained: Column, shares: Shares = Shares()) -> tuple[DataFrame, int, int]:
    """The tree as one table `(gram, value, factor)`, a row per sequence, the training tokens, and the words that they are.

    `value` is the log10 probability of a word at the root, or what that of a listed sequence is above the product of
    its parent's and the factor; `factor` is log10 of what a state leaves to tokens that it does not list.
    """
    tree = build(docs, trained, shares)

    def rows_of(kind: int):
        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, lists in _buckets(batches, {"grams": np.int64, "entries": np.float64}):
                for _, grams, value in lists:
                    none = np.zeros(len(value))
                    both = (none, value) if kind == STATE else (value, none)
                    yield _batch({"gram": (grams, pa.int64()), "value": (both[0], pa.float64()), "factor": (both[1], pa.float64())})

        return unpack

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            root = _of_words(batch.column("c").to_numpy(), tokens, kinds)[2]
            yield _batch({"gram": (batch.column("gram"), pa.int64()), "value": (root, pa.float64()), "factor": (np.zeros(len(root)), pa.float64())})

    layout, tokens, kinds = "gram bigint, value double, factor double", tree.tokens, tree.kinds
    rows = tree.words.select("gram", "c").mapInArrow(roots, layout)
    for level in tree.levels.values():
        for kind in (STATE, ENTRY):
            rows = rows.unionByName(level.filter(F.col("kind") == kind).mapInArrow(rows_of(kind), layout))
    for grams, factor in tree.states.values():
        rows = rows.unionByName(docs.sparkSession.createDataFrame([(g, 0.0, f) for g, f in zip(grams.tolist(), factor.tolist())], layout))
    for grams, value in tree.frequent.values():
        rows = rows.unionByName(docs.sparkSession.createDataFrame([(g, v, 0.0) for g, v in zip(grams.tolist(), value.tolist())], layout))
    return rows.groupBy("gram").agg(F.sum("value").alias("value"), F.sum("factor").alias("factor")), tokens, kinds


def score_documents(docs: DataFrame, trained: Column, shares: Shares = Shares()) -> DataFrame:
    """One row per row of `docs(doc_id, text)`, with a model learned from the rows where `trained` holds.

    Returns `doc_id, n_tokens, n_known, train_tokens, base_score, score`. A null text is empty: it has one
    token, the end. Repeated rows are texts of their own, each counted and scored. `base_score` sums
    `log10((c + 0.5) / (N + 0.5 * (V + 1)))`; without training rows all counts are zero and every token is
    the unknown symbol, with probability 1 under the tree.

    The score of a text is a sum over its words and sequences of words: the root probability of each word, the
    factor of each sequence that is a state, and for each that a state lists what its probability is above
    the product of the parent's and the factor. Values of frequent ones go to every task; all others are met
    in a shuffle, in as many buckets of hashes as their number asks for. None of them is frequent, so no bucket is
    hot. The buckets are met in two rounds, or more if the bitmap of what has a value is filled; the sums of a round are
    stored. In the first round each text sends a row of its own. Rows are told by partition and place, which each
    round has to read alike; so texts that come from a shuffle, which may order them anew, are stored before.
    """
    spark = docs.sparkSession
    tree = build(docs, trained, shares)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        docs = tree.steps.store(docs, "texts")
    words = tree.words.filter(F.col("n") >= tree.often).select("gram", "c").toArrow()
    # A word has its own values and those of the state that it is.
    grams, factor = tree.states[2]
    word_values = np.zeros((words.num_rows + len(grams), 3))
    word_values[: words.num_rows] = np.column_stack(tree.of_words(words.column("c").to_numpy()))
    word_values[words.num_rows :, 2] = factor
    word_grams = np.concatenate([words.column("gram").to_numpy(), grams])
    states = [own for n, own in tree.states.items() if n > 2]
    grams, value = (np.concatenate(x) for x in zip(*tree.frequent.values(), *states))
    cache = spark.sparkContext.broadcast((word_grams, word_values, grams, value))
    longer = reduce(DataFrame.unionByName, (level if n > 2 else level.filter(F.col("kind") == ENTRY) for n, level in tree.levels.items()))
    filled = _bitmap(longer, shares.filter_bits)
    places = _places(grams, shares.filter_bits)
    np.bitwise_or.at(filled, places >> 3, (1 << (places & 7)).astype(np.uint8))
    bitmap, rounds = spark.sparkContext.broadcast(filled), max(2, _rounds(filled))
    seldom = tree.words.filter(F.col("n") < tree.often)
    valued = reduce(DataFrame.unionByName, tree.levels.values()).withColumns({"kind": F.lit(VALUES).cast("bigint"), "part": F.lit(0).cast("bigint")})
    tokens, kinds, buckets = tree.tokens, tree.kinds, tree.buckets
    layout = "bucket bigint, kind bigint, part bigint, grams binary, entries binary"

    def offer_words(turn: int):
        def offered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                grams, c = (batch.column(x).to_numpy() for x in ("gram", "c"))
                deal = _dealt(grams, buckets)
                own = deal % rounds == turn
                yield from _lists(deal[own], {"grams": grams[own], "entries": c[own]}, kind=WORDS, part=0)

        return offered

    def sender(turn: int):
        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, number, waiting = TaskContext.get().partitionId(), 0, []
            frequent = [_Values(*cache.value[:2]), _Values(*cache.value[2:])]

            def flush() -> Iterator[pa.RecordBatch]:
                rows, grams = (np.concatenate(x) for x in zip(*waiting))
                waiting.clear()
                yield from _lists(_dealt(grams, buckets), {"grams": grams, "entries": rows}, kind=SEEN, part=part)

            for batch in batches:
                for low in range(0, batch.num_rows, SLICE_TEXTS):
                    piece = batch.slice(low, SLICE_TEXTS)
                    ids, starts = _hashed(piece.column("text"))
                    size, depths, grams = len(ids), _depths(starts, len(ids)), ids
                    rows = number + np.arange(len(starts))
                    lengths = np.diff(np.append(starts, size))
                    row_of = np.repeat(rows.astype(np.uint32), lengths)
                    sums = np.zeros((3, size))
                    for n in range(1, shares.depth + 2):
                        if n > 1:
                            grams = _longer(grams, n)
                            at = np.flatnonzero((depths >= n - 1) & _marked(bitmap.value, grams))
                        else:
                            at = np.arange(size)
                        hit, own = frequent[n > 1].find(grams[at])
                        if turn == 0 and n > 1:
                            sums[2][at[hit]] += own
                        elif turn == 0:
                            sums[:, at[hit]] = own.T
                        at = at[~hit]
                        if rounds > 1:
                            at = at[_dealt(grams[at], buckets) % rounds == turn]
                        waiting.append((row_of[at], grams[at]))
                    if turn == 0:
                        known, base, value = (np.add.reduceat(x, starts) for x in sums)
                        named = piece.column("doc_id")
                        doc_ids = named.fill_null(0).to_numpy(zero_copy_only=False)
                        valid = named.is_valid().to_numpy(zero_copy_only=False)
                        own = np.column_stack([known.astype(np.int64), base.view(np.int64), value.view(np.int64), doc_ids, valid, lengths])
                        deal = np.full(len(rows), (part + number // SLICE_TEXTS) % buckets)
                        yield from _lists(deal, {"grams": rows, "entries": own.astype(np.int64)}, kind=OWN, part=part)
                    number += len(rows)
                    if sum(len(x) for x, _ in waiting) > 2 * FLUSH_ENTRIES:
                        yield from flush()
            if sum(len(x) for x, _ in waiting):
                yield from flush()

        return send

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lists of sums by groups of texts."""

        def summed(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            rows, sums = columns
            order = np.argsort(rows)
            rows = rows[order]
            firsts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])[: len(rows)])
            if len(firsts):
                yield from grouped(rows[firsts], np.add.reduceat(sums[order], firsts, axis=0), SEEN)

        def grouped(rows: np.ndarray, sums: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
            yield from _lists(rows >> GROUP_BITS, {"rows": (rows & ((1 << GROUP_BITS) - 1)).astype(np.uint16), "entries": sums}, kind=kind)

        out, offers, listed, open_bucket = _Out(summed), [], None, -1
        for batch in batches:
            for bucket, kind, part, grams, entries in zip(*(batch.column(x).to_pylist() for x in ("bucket", "kind", "part", "grams", "entries"))):
                if bucket != open_bucket:
                    open_bucket, offers, listed = bucket, [], None
                grams = np.frombuffer(grams, dtype=np.int64)
                if kind == WORDS:
                    offers.append((grams, np.column_stack(_of_words(np.frombuffer(entries, dtype=np.int64), tokens, kinds))))
                elif kind == VALUES:
                    value = np.frombuffer(entries, dtype=np.float64)
                    offers.append((grams, np.column_stack([np.zeros(len(grams)), np.zeros(len(grams)), value])))
                elif kind == SEEN and (offers or listed):
                    if listed is None:
                        listed = _Values(*(np.concatenate(x) for x in zip(*offers)))
                        offers = []
                    hit, own = listed.find(grams)
                    yield from out.add((part << 40) + np.frombuffer(entries, dtype=np.uint32)[hit].astype(np.int64), own)
                elif kind == OWN:
                    yield from grouped((part << 40) + grams, np.frombuffer(entries, dtype=np.int64).reshape(-1, 6), OWN)
        yield from out.flush()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per text of each group."""
        for _, lists in _buckets(batches, {"rows": np.uint16, "entries": np.int64}):
            sums, own = np.zeros((1 << GROUP_BITS, 3)), np.zeros((1 << GROUP_BITS, 3), dtype=np.int64)
            for kind, rows, entries in lists:
                if kind == OWN:
                    entries = entries.reshape(-1, 6)
                    own[rows] = entries[:, 3:]
                    sums[rows, 0] += entries[:, 0]
                    sums[rows, 1:] += entries[:, 1:3].copy().view(np.float64)
                else:
                    sums[rows] += entries.view(np.float64).reshape(-1, 3)
            there = np.flatnonzero(own[:, 2])  # every text has a token
            doc_id, valid, n_tokens = own[there].T
            known, base, value = sums[there].T
            yield _batch({
                "doc_id": (pa.array(doc_id, mask=valid == 0), pa.int64()), "n_tokens": (n_tokens, pa.int64()), "n_known": (np.rint(known).astype(np.int64), pa.int64()),
                "train_tokens": (np.full(len(there), tokens), pa.int64()), "base_score": (base, pa.float64()), "score": (value, pa.float64()),
            })

    def of_round(turn: int) -> DataFrame:
        rows = docs.mapInArrow(sender(turn), layout)
        both = seldom.select("gram", "c").mapInArrow(offer_words(turn), layout).unionByName(rows)
        both = both.unionByName(valued.filter(F.col("bucket") % rounds == turn))
        dealt = both.repartition("bucket").sortWithinPartitions("bucket", "kind")
        return dealt.mapInArrow(meet, "bucket bigint, kind bigint, rows binary, entries binary")

    sums = tree.steps.union(map(of_round, range(rounds)), "sums")
    tree.steps.free(*(x for x in list(tree.steps.paths) if x != "sums"))
    return sums.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        gather, "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    )
