"""Whitening of embeddings by spectrum slicing.

Spark adds up the exact sums and products of all vectors in whole numbers; what reaches the driver is one
covariance of the size of a vector squared. There its leading eigenvalues are counted off: the number of positive
pivots of LDL^T of the shifted matrix tells how many eigenvalues lie above a shift, so bisection isolates the k-th,
Rayleigh quotient iteration finds it with its vector, and counts on both sides of it certify that it is the k-th.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from partloom.session import checkpointed

SCALE, OFFSET = 64, 1_000_000
LIMIT = float(1 << 40)  # of an entry: beyond it 64 times the entry has no exact double
COMPONENTS = 32
LEAST_SHARE = 1e-12  # of the trace; eigenvalues up to it are taken for zero
EPS = np.finfo(np.float64).eps


@dataclass(frozen=True)
class Whitening:
    """Eigenvalues fall, `components` holds one unit vector a row; `sums` and `n` are exact."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float


# ---- eigenpairs of one matrix


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of the matrix after Householder reflections, which keep its eigenvalues."""
    a = np.array(matrix, dtype=np.float64)
    d = len(a)
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        norm = np.linalg.norm(x)
        if norm == 0:
            continue
        x[0] += norm if x[0] >= 0 else -norm
        x /= np.linalg.norm(x)
        block = a[k + 1 :, k + 1 :]
        p = block @ x
        p -= x * (x @ p)
        block -= 2 * (np.outer(x, p) + np.outer(p, x))
        a[k + 1 :, k] -= 2 * x * (x @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
    return np.diag(a).copy(), np.diag(a, -1).copy()


def count_above(diagonal: np.ndarray, beside: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie above each shift: positive pivots of LDL^T of the shifted tridiagonal matrix."""
    tiny = EPS * max(1e-300, float(np.abs(diagonal).max(initial=0.0) + np.abs(beside).max(initial=0.0)))
    above = np.zeros(len(shifts), dtype=np.int64)
    pivot = np.ones(len(shifts))
    for k in range(len(diagonal)):
        pivot = diagonal[k] - shifts - (beside[k - 1] ** 2 / pivot if k else 0.0)
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        above += pivot > 0
    return above


def leading_pairs(matrix: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The `k` largest eigenvalues above `least`, falling, and their unit vectors by rows.

    Equal eigenvalues are one interval that bisection can't part; their vectors are any orthonormal ones.
    """
    d = len(matrix)
    diagonal, beside = tridiagonal(matrix)
    radius = np.abs(np.concatenate([[0.0], beside])) + np.abs(np.concatenate([beside, [0.0]]))
    norm = float(np.max(np.abs(diagonal) + radius))
    floor = 8 * EPS * d * norm

    def above(*shifts: float) -> list[int]:
        return count_above(diagonal, beside, np.array(shifts)).tolist()

    k = min(k, above(max(least, floor))[0])
    values, vectors = np.zeros(k), np.zeros((k, d))
    low, high = np.full(k, float(np.min(diagonal - radius)) - floor), np.full(k, float(np.max(diagonal + radius)) + floor)
    wanted = np.arange(1, k + 1)

    def halve() -> None:
        middle = (low + high) / 2
        enough = count_above(diagonal, beside, middle) >= wanted
        low[enough], high[~enough] = middle[enough], middle[~enough]

    for _ in range(12):
        halve()
    rng = np.random.default_rng(0)
    for i in range(k):
        while True:
            n_low, n_high = above(low[i], high[i])
            stuck = high[i] - low[i] <= floor
            if stuck or (n_low == i + 1 and n_high == i):
                pair = _rayleigh(matrix, (low[i] + high[i]) / 2, values[:i], vectors[:i], floor, rng)
                if stuck and pair is None:
                    raise ArithmeticError(f"no vector for eigenvalue {i + 1}")
                # The counts certify the number; a pair that drifted to a neighbour waits for a narrower interval.
                if stuck or pair is not None and low[i] < pair[0] <= high[i]:
                    n_below, n_over = above(pair[0] - floor, pair[0] + floor)
                    if stuck or n_below >= i + 1 and n_over <= i:
                        values[i], vectors[i] = pair
                        break
            halve()
    signs = np.sign(vectors[np.arange(k), np.abs(vectors).argmax(axis=1)]) if k else np.zeros(0)
    return values, vectors * signs[:, None]


def _rayleigh(matrix, shift, known_values, known, floor, rng) -> tuple[float, np.ndarray] | None:
    """Rayleigh quotient iteration from a shift, kept orthogonal to the known vectors of close eigenvalues."""
    d = len(matrix)
    near = known[np.abs(known_values - shift) <= 1e-3 * max(abs(shift), floor)] if len(known) else known
    x = rng.standard_normal(d)
    best = None
    for turn in range(40):
        x -= near.T @ (near @ x)
        x /= np.linalg.norm(x)
        quotient = float(x @ matrix @ x)
        residual = float(np.linalg.norm(matrix @ x - quotient * x))
        if best is not None and residual >= 0.5 * best[0]:
            break  # as good as rounding allows
        if turn > 2 and residual <= floor:
            best = (residual, quotient, x.copy())
        at = shift if turn < 2 else quotient
        try:
            x = np.linalg.solve(matrix - at * np.eye(d), x)
        except np.linalg.LinAlgError:
            x = np.linalg.solve(matrix - (at + floor) * np.eye(d), x)
        if not np.isfinite(x).all():
            break
    return None if best is None else best[1:]


# ---- passes over the vectors


def fixed_point(vectors: DataFrame) -> DataFrame:
    """`(vec_id, x)`, stored: `floor(64 * c) + 1000000` of every entry of the usable vectors, as long numbers.

    Null and empty vectors go, those with a null, NaN or infinite entry or one beyond 2^40, and those of another
    length than most have (the longer, if two lengths are equally frequent). Ids may be null or repeat.
    """
    value = F.col("embedding")
    fine = F.forall(value, lambda c: F.coalesce(F.abs(c.cast("double")) <= LIMIT, F.lit(False)))
    x = F.transform(value, lambda c: F.floor(c.cast("double") * SCALE).cast("bigint") + OFFSET)
    usable = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.when(F.coalesce(fine & (F.size(value) > 0), F.lit(False)), x).alias("x"))
    stored = checkpointed(usable.filter(F.col("x").isNotNull()), "whiten-fixed")
    most = stored.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return stored if most is None else stored.filter(F.size("x") == most["d"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _totals(stored: DataFrame, read: Callable[[np.ndarray], np.ndarray], kind: str) -> dict[tuple[int, int], object]:
    """Sums of equal cells of the small matrices that `read` makes of the batches: one row per task and cell."""
    number = "decimal(38,0)" if kind == "exact" else "double"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = read(_matrix(batch.column("x")))
                total = part if total is None else total + part
        if total is not None:
            i, j = np.nonzero(np.arange(total.shape[1])[None, :] >= np.arange(total.shape[0])[:, None])
            cells = [Decimal(int(v)) for v in total[i, j]] if kind == "exact" else total[i, j].astype(np.float64)
            kinds = pa.decimal128(38, 0) if kind == "exact" else pa.float64()
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(cells, kinds)], names=["i", "j", "s"])

    added = stored.select("x").mapInArrow(sums, f"i int, j int, s {number}").groupBy("i", "j").agg(F.sum("s").cast(number).alias("s"))
    return {(r["i"], r["j"]): r["s"] for r in added.collect()}


def _exact_products(y: np.ndarray) -> np.ndarray:
    """Sums of products of whole numbers, exact: doubles hold them as long as they stay below 2^53."""
    most = int(np.abs(y).max(initial=0))
    if most >= 1 << 26:
        whole = y.astype(object)
        return whole.T @ whole
    rows = max(1, (1 << 52) // max(1, most * most))
    parts = [y[at : at + rows].astype(np.float64) for at in range(0, len(y), rows)]
    return sum((p.T @ p).astype(np.int64).astype(object) for p in parts)


def fit(stored: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Leading components of all vectors of `fixed_point`; None without vectors.

    Products are taken of the vectors less their rounded mean and corrected for the rest of the mean, all in whole
    numbers of any size, so the covariance has one rounding only.
    """
    first = _totals(stored, lambda x: np.concatenate([x.sum(axis=0), [len(x)]])[None, :].astype(object), "exact")
    if not first:
        return None
    d = max(j for _, j in first)
    n, sums = int(first[0, d]), [int(first[0, j]) for j in range(d)]
    centre = [round(s / n) if n else 0 for s in sums]
    about = np.array(centre, dtype=np.int64)
    products = _totals(stored, lambda x: _exact_products(x - about), "exact")
    rest = [s - n * c for s, c in zip(sums, centre)]
    v = np.zeros((d, d))
    for (i, j), s in products.items():
        v[i, j] = v[j, i] = (n * int(s) - rest[i] * rest[j]) / (n * n)
    trace = float(np.trace(v))
    values, rows = leading_pairs(v, components, LEAST_SHARE * trace) if trace > 0 else (np.zeros(0), np.zeros((0, d)))
    return Whitening(n, tuple(sums), rows, values, trace)


def _whitened(model: Whitening, x: np.ndarray) -> np.ndarray:
    whole = x.astype(object) * model.n if model.n * int(np.abs(x).max(initial=0)) >= 1 << 62 else x * model.n
    centred = (whole - np.array(model.sums, dtype=whole.dtype)).astype(np.float64) / model.n
    return centred @ (model.components / np.sqrt(model.eigenvalues)[:, None]).T


def identity_error(stored: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened vectors less the identity."""
    k = len(model.eigenvalues)

    def products(x: np.ndarray) -> np.ndarray:
        w = np.hstack([_whitened(model, x), np.ones((len(x), 1))])
        return w.T @ w

    cells = _totals(stored, products, "double")
    error = 0.0
    for i in range(k):
        for j in range(i, k):
            covariance = cells[i, j] / model.n - cells[i, k] * cells[j, k] / model.n**2
            error = max(error, abs(covariance - (i == j)))
    return error


def whiten(stored: DataFrame, model: Whitening) -> DataFrame:
    """`(vec_id, deviation, whitened)` per vector: exact sum of `(n * x - S)^2` and the components in order."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.array(model.sums, dtype=object)
        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                part = batch.slice(low, 2000)
                x = _matrix(part.column("x"))
                apart = max(1, int(np.abs(x - np.array([s // model.n for s in model.sums])).max(initial=0)) + 1) * model.n
                if model.n * int(np.abs(x).max(initial=0)) < 1 << 62 and apart * apart * x.shape[1] < 1 << 62:
                    deviation = ((x * model.n - sums.astype(np.int64)) ** 2).sum(axis=1).tolist()
                else:
                    deviation = ((x.astype(object) * model.n - sums) ** 2).sum(axis=1).tolist()
                w = _whitened(model, x)
                offsets = pa.array(np.arange(len(x) + 1) * w.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id"),
                        pa.array([Decimal(v) if v < 10**38 else None for v in deviation], pa.decimal128(38, 0)),
                        pa.ListArray.from_arrays(offsets, pa.array(w.ravel(), pa.float64())),
                    ],
                    names=["vec_id", "deviation", "whitened"],
                )

    return stored.mapInArrow(rows, "vec_id bigint, deviation decimal(38,0), whitened array<double>")


def whitened_components(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector of `vectors(vec_id, embedding)` and component, other columns ignored.

    Returns `vec_id, component, n, deviation, whitened, explained, identity_error`. All usable vectors (see
    `fixed_point`) are fitted, repeated ones as often as they are there. `deviation` is exact, as long as it
    fits a long, else null. Components beyond the rank of the covariance (eigenvalues up to 10^-12 of the trace)
    have no unit variance and no rows; without usable vectors, or if all are equal, there are none at all.
    """
    stored = fixed_point(vectors)
    model = fit(stored, components)
    if model is None or not len(model.eigenvalues):
        model = Whitening(1, (), np.zeros((0, 0)), np.zeros(0), 1.0)
        stored, error = stored.limit(0), 0.0
    else:
        error = identity_error(stored, model)
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues]).cast("array<double>")
    spread = whiten(stored, model).select("vec_id", "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    return spread.select(
        "vec_id",
        (F.col("_at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("bigint").alias("n"),
        F.col("deviation").try_cast("bigint").alias("deviation"),
        "whitened",
        F.get(explained, F.col("_at")).alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )
