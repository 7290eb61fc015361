"""Quality classifier: a linear support vector machine on n-gram indicators scaled by naive Bayes ratios.

A text is the set of its n-grams over two streams, words and shapes of words, each hashed to one of `buckets`
places. An indicator counts as the log ratio of how much of either class's n-grams it is; texts are scaled to unit
length. The hinge loss is fitted by dual coordinate descent, one row at a time; margins become probabilities by a
logistic curve fitted on rows that neither the ratios nor the machine have seen.
"""

from __future__ import annotations

import hashlib
import math
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from partloom.llm.text import LOWER, UPPER
from partloom.session import checkpointed

MEMO_WORDS = 200_000
SLICE_WORDS = 100_000
U64 = np.uint64
LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())


@dataclass(frozen=True)
class Settings:
    """Bounds of what is learned from, in rows of each class: `labelled` documents are looked up, `sample` of them fit
    the machine, a quarter of that the curve; the ratios come from all that are not for the curve."""

    buckets: int = 1 << 18
    word_grams: int = 2
    shape_grams: int = 3
    labelled: int = 20_000
    sample: int = 3000
    cost: float = 1.0
    epochs: int = 30
    curve_share: int = 5  # one row in so many is kept for the curve


@dataclass(frozen=True)
class Classifier:
    """Margin of a text: `weights` of its buckets, over the length of their `ratios`, plus `bias`; then `slope * margin + offset`."""

    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    settings: Settings


# ---- n-grams


def shape(word: str) -> str:
    """Letters as A or a, digits as 0, all else as it is; runs of one kind as one or, of other characters, up to two."""
    core = word.rstrip(string.punctuation)
    if core.isalpha():
        lead = "a" if core.islower() else "A" if core.isupper() else "Aa" if core[:1].isupper() and core[1:].islower() else None
        if lead:
            tail = word[len(core) :]
            return lead + tail if len(tail) < 3 else lead + _runs(tail)
    return _runs(word)


def _runs(word: str) -> str:
    out: list[str] = []
    for c in word:
        kind = ("A" if c.isupper() else "a") if c.isalpha() else "0" if c.isdigit() else c
        if out[-1:] == [kind] and (kind in "Aa0" or out[-2:] == [kind, kind]):
            continue
        out.append(kind)
    return "".join(out)


def _hash(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little")


class _Memo:
    """Numbers of words and the hashes of the words and their shapes, remembered as long as there is room."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.hashes: list[tuple[int, int]] = []
        self.shapes: dict[str, int] = {}

    def numbered(self, tokens: list[bytes]) -> list[int]:
        numbers, out = self.numbers, []
        for t in tokens:
            k = numbers.get(t)
            if k is None:
                k = numbers[t] = len(self.hashes)
                form = shape(t.decode())
                if form not in self.shapes:
                    self.shapes[form] = _hash(b"s" + form.encode())
                self.hashes.append((_hash(b"w" + t.translate(LOWERED)), self.shapes[form]))
            out.append(k)
        return out


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


AGAIN = U64(_hash(b"s="))  # shape of a word that follows itself


def features(texts: list[list[bytes]], settings: Settings, memo: _Memo) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each text of words, distinct and in order, and where each text begins."""
    flat: list[int] = []
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    if len(memo.hashes) > MEMO_WORDS:
        memo.clear()
    for i, text in enumerate(texts):
        flat += memo.numbered(text)
        starts[i + 1] = len(flat)
    ids = np.array(flat, dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    depth = np.arange(len(ids)) - starts[owner]
    table = np.array(memo.hashes, dtype=U64).reshape(-1, 2)
    word, form = table[ids, 0], table[ids, 1].copy()
    same = np.concatenate([[False], ids[1:] == ids[:-1]])[: len(ids)] & (depth > 0)
    form[same] = AGAIN
    codes = []
    with np.errstate(over="ignore"):
        for stream, longest in ((word, settings.word_grams), (form, settings.shape_grams)):
            gram = stream
            for n in range(1, longest + 1):
                if n > 1:
                    before = np.concatenate([gram[:1], gram[:-1]])
                    gram = _mixed(before * U64(0x9E3779B97F4A7C15) + stream + U64(n))
                at = np.flatnonzero(depth >= n - 1)
                codes.append(owner[at] * settings.buckets + (gram[at] % U64(settings.buckets)).astype(np.int64))
    found = np.unique(np.concatenate(codes)) if codes else np.zeros(0, dtype=np.int64)
    ends = np.searchsorted(found, np.arange(len(texts) + 1) * settings.buckets)
    return found % settings.buckets, ends


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Words of the texts of a batch, in parts of about `SLICE_WORDS` words, with the number of their first row."""
    low, held, size = 0, [], 0
    for at, text in enumerate(batch.column("text")):
        # Bytes are split at the six ASCII white-space characters.
        held.append((text.as_py() or "").encode().split())
        size += len(held[-1])
        if size >= SLICE_WORDS:
            yield low, held
            low, held, size = at + 1, [], 0
    if held:
        yield low, held


# ---- training


def indicators(rows: DataFrame, settings: Settings) -> DataFrame:
    """`rows(doc_id, label, pick, text)` with the distinct `buckets` of each text in place of the text."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo()
        for batch in batches:
            for low, texts in _slices(batch):
                found, ends = features(texts, settings, memo)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found, pa.int32()))
                kept = [batch.column(c).slice(low, len(texts)) for c in ("doc_id", "label", "pick")]
                yield pa.RecordBatch.from_arrays([*kept, lists], names=["doc_id", "label", "pick", "buckets"])

    return rows.select("doc_id", "label", "pick", "text").mapInArrow(listed, "doc_id bigint, label int, pick bigint, buckets array<int>")


def class_counts(rows: DataFrame, settings: Settings) -> np.ndarray:
    """Texts of class 0 and class 1 that hold each bucket, over all of `rows(label, buckets)`; two rows of fixed length."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, settings.buckets), dtype=np.int64)
        for batch in batches:
            labels, lists = batch.column("label").to_numpy(), batch.column("buckets")
            found, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            for c in (0, 1):
                total[c] += np.bincount(found[np.repeat(labels == c, sizes)], minlength=settings.buckets)
        at = np.flatnonzero(total.any(axis=0))
        for low in range(0, len(at), 50_000):
            part = at[low : low + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[0, part]), pa.array(total[1, part])], names=["bucket", "n0", "n1"])

    counted = rows.select("label", "buckets").mapInArrow(count, "bucket bigint, n0 bigint, n1 bigint")
    summed = counted.groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    out = np.zeros((2, settings.buckets))
    for batch in summed.toArrow().to_batches():  # one row a bucket at most
        at = batch.column("bucket").to_numpy()
        out[0, at], out[1, at] = batch.column("n0").to_numpy(), batch.column("n1").to_numpy()
    return out


def _sampled(rows: DataFrame, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Buckets and labels of at most `size` rows of each class, the first by a hash of the text."""
    lists, labels = [], []
    for c in (0, 1):
        taken = rows.filter(F.col("label") == c).orderBy("pick", "doc_id").limit(size).select("buckets").toArrow()
        lists += [np.array(x, dtype=np.int64) for batch in taken.to_batches() for x in batch.column("buckets").to_numpy(zero_copy_only=False)]
        labels += [c] * taken.num_rows
    return lists, np.array(labels, dtype=np.int64)


def dual_descent(lists: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, settings: Settings) -> tuple[np.ndarray, float]:
    """Weights of the scaled, unit-length indicators and the bias, by dual coordinate descent on the hinge loss.

    Rows of a class cost in inverse proportion to its number, so that both weigh the same.
    """
    sides = np.where(labels == 1, 1.0, -1.0)
    share = np.bincount(labels, minlength=2) / len(labels)
    limits = settings.cost * 0.5 / share[labels]
    scaled = []
    for found in lists:
        value = ratios[found]
        length = np.sqrt((value * value).sum())
        scaled.append(value / length if length > 0 else value)
    diagonal = np.array([(v * v).sum() + 1.0 for v in scaled])  # 1 for the bias
    weights, bias, duals = np.zeros(len(ratios)), 0.0, np.zeros(len(lists))
    rng = np.random.default_rng(0)
    for _ in range(settings.epochs):
        largest = 0.0
        for i in rng.permutation(len(lists)):
            gradient = sides[i] * (weights[lists[i]] @ scaled[i] + bias) - 1.0
            new = min(max(duals[i] - gradient / diagonal[i], 0.0), limits[i])
            step = (new - duals[i]) * sides[i]
            if step:
                weights[lists[i]] += step * scaled[i]  # buckets of a text are distinct
                bias += step
                largest = max(largest, abs(step))
                duals[i] = new
        if largest < 1e-3:
            break
    return weights, bias


def logistic_curve(margins: np.ndarray, labels: np.ndarray, row_weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability of class 1, by Newton steps on smoothed targets (Platt)."""
    positive, negative = row_weights[labels == 1].sum(), row_weights[labels == 0].sum()
    target = np.where(labels == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    at = np.array([0.0, math.log((positive + 1) / (negative + 1))])

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float((row_weights * (np.logaddexp(0, z) - target * z)).sum())

    now = loss(at)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -500, 500)))
        gradient = x.T @ (row_weights * (p - target))
        hessian = (x * (row_weights * p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2)
        step, rate = np.linalg.solve(hessian, gradient), 1.0
        while rate > 1e-6 and loss(at - rate * step) > now:
            rate /= 2
        at, before, now = at - rate * step, now, loss(at - rate * step)
        if before - now < 1e-9 * max(1.0, abs(now)):
            break
    return float(at[0]), float(at[1])


def _margins(lists: list[np.ndarray], ratios: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    lengths = [np.sqrt((ratios[b] ** 2).sum()) for b in lists]
    return np.array([(weights[b] @ ratios[b] / n if n > 0 else 0.0) + bias for b, n in zip(lists, lengths)])


def train(labelled: DataFrame, settings: Settings = Settings()) -> Classifier:
    """Classifier from `labelled(doc_id, text, label)`; rows whose label is neither 0 nor 1 are ignored.

    Ratios count all rows but those for the curve. Each text is read once; its buckets are stored. Without both classes the score is the smoothed share of class 1.
    """
    pick = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = labelled.filter(F.col("label").isin(0, 1)).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("label").cast("int").alias("label"), "text", pick.alias("pick"))
    rows = checkpointed(indicators(rows, settings), "svm-rows")
    for_curve = F.pmod(F.col("pick"), F.lit(settings.curve_share)) == 0
    totals = {(r["c"], r["label"]): r["n"] for r in rows.groupBy(for_curve.alias("c"), "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    whole = [sum(totals.get((c, k), 0) for c in (False, True)) for k in (0, 1)]
    zeros = np.zeros(settings.buckets)
    prior = math.log((whole[1] + 1) / (whole[0] + 1))
    if min(totals.get((False, 0), 0), totals.get((False, 1), 0)) == 0:
        return Classifier(zeros, zeros, 0.0, 0.0, prior, settings)
    counts = class_counts(rows.filter(~for_curve), settings) + 1.0
    ratios = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    ratios[(counts == 1.0).all(axis=0)] = 0.0  # never seen
    lists, labels = _sampled(rows.filter(~for_curve), settings.sample)
    weights, bias = dual_descent(lists, labels, ratios, settings)
    held, held_labels = _sampled(rows.filter(for_curve), max(1, settings.sample // 4))
    if len(set(held_labels.tolist())) < 2:
        held, held_labels = lists, labels
    # Each class counts as often as it occurs, whatever was sampled of it.
    weigh = np.array(whole)[held_labels] / np.bincount(held_labels, minlength=2)[held_labels]
    weigh *= len(held) / weigh.sum()
    slope, offset = logistic_curve(_margins(held, ratios, weights, bias), held_labels, weigh)
    if slope <= 0:
        slope, offset = 0.0, prior
    return Classifier(ratios, weights * ratios, bias, slope, offset, settings)


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """`docs(doc_id, text)` with `score`, the probability of class 1; the text is the only input.

    Null and blank texts hold no n-grams and have the margin of the bias. Repeated rows are scored each; columns
    other than these two are ignored. The model sent to tasks has two numbers a bucket.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.ratios**2, model.weights))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo()
        squares, weights = sent.value
        for batch in batches:
            for low, texts in _slices(batch):
                found, ends = features(texts, model.settings, memo)
                owner = np.repeat(np.arange(len(texts)), np.diff(ends))
                # Added up text by text, so a score doesn't depend on how the rows are dealt.
                sums = [np.bincount(owner, weights=v[found], minlength=len(texts)) for v in (squares, weights)]
                length = np.sqrt(np.maximum(sums[0], 0))
                margin = np.where(length > 0, sums[1] / np.where(length > 0, length, 1.0), 0.0) + model.bias
                z = np.clip(model.slope * margin + model.offset, -500, 500)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, len(texts)), pa.array(1 / (1 + np.exp(-z)))], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(scored, "doc_id bigint, score double")


def training_rows(docs: DataFrame, labels: DataFrame, label: str, settings: Settings = Settings()) -> DataFrame:
    """`(doc_id, text, label)` of labelled documents; several labels of a document count as their rounded mean.

    At most `settings.labelled` ids of each class are looked up, the first by a hash. With that bound they go to every
    task, so no text is shuffled.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    known = checkpointed(known, "svm-labels")
    taken = [known.filter(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.labelled) for c in (0, 1)]
    return docs.select("doc_id", "text").join(F.broadcast(taken[0].unionAll(taken[1])), "doc_id")
