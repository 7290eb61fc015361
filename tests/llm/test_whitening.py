"""Whitening against a library's eigenvectors, exact sums against whole numbers, and odd rows."""

import math

import numpy as np
import pytest

from partloom.llm import whitening

VECTORS = "vec_id bigint, embedding array<float>"


def brute(vectors, k):
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    deviation = [sum((n * r[j] - sums[j]) ** 2 for j in range(d)) for r in x]
    centred = np.array([[(n * r[j] - sums[j]) / n for j in range(d)] for r in x])
    values, rows = np.linalg.eigh(centred.T @ centred / n)
    values, rows = values[::-1][:k], rows.T[::-1][:k]
    return deviation, centred @ rows.T / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def test_whitened_vectors_against_a_library(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.standard_normal((400, 40)) * np.linspace(2, 0.2, 40) @ rng.standard_normal((40, 40))).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(vectors)], VECTORS + ", x string").repartition(6)
    got = whitening.whitened_components(frame).collect()
    deviation, white, explained = brute(vectors, 32)
    assert len(got) == 400 * 32 and {r["component"] for r in got} == set(range(1, 33))
    table = np.zeros((400, 32))
    for r in got:
        table[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["n"] == 400 and r["deviation"] == deviation[r["vec_id"]] and r["identity_error"] < 1e-9
        assert math.isclose(r["explained"], explained[r["component"] - 1], rel_tol=1e-9)
    signs = np.sign((table * white).sum(axis=0))
    assert np.abs(table - white * signs).max() < 1e-6
    assert np.abs(np.cov(table.T, bias=True) - np.eye(32)).max() < 1e-9


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1, 0.5], [3, 3, 3, 1, 1, 0.1], [1, 1 - 1e-9, 1 - 2e-9, 0.5, 1e-3, 1e-5], [2] * 6, [1e9, 1, 1e-2, 1e-3, 0, 0]])
def test_counts_and_pairs_of_close_equal_and_zero_eigenvalues(values):
    rng = np.random.default_rng(6)
    q, _ = np.linalg.qr(rng.standard_normal((6, 6)))
    matrix = (q * values) @ q.T
    matrix = (matrix + matrix.T) / 2
    found, vectors = whitening.leading_pairs(matrix, 6, 1e-12 * sum(values))
    alive = [v for v in values if v > 1e-12 * sum(values)]
    assert np.allclose(found, alive, rtol=1e-9, atol=1e-14 * max(values))
    assert np.abs(vectors @ vectors.T - np.eye(len(alive))).max() < 1e-6
    assert np.abs(vectors @ matrix - found[:, None] * vectors).max() < 1e-12 * max(values)
    diagonal, beside = whitening.tridiagonal(matrix)
    shifts = np.array([0.7, 1.5, 2.5, 1e8])
    assert whitening.count_above(diagonal, beside, shifts).tolist() == [sum(v > s for v in values) for s in shifts]


def test_nulls_lengths_and_repeated_rows(spark):
    rows = [(1, [1.0, 2.0, 0.5]), (1, [1.0, 2.0, 0.5]), (None, [0.0, 1.0, 2.0]), (4, [3.0, 1.0, 1.0]), (5, None), (6, []), (7, [1.0, None, 2.0])]
    rows += [(8, [1.0, float("nan"), 2.0]), (9, [1.0, float("inf"), 2.0]), (10, [1.0, 2.0]), (11, [1e30, 1.0, 1.0])]
    got = whitening.whitened_components(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted((r["vec_id"] or -1, r["component"]) for r in got) == [(-1, 1), (-1, 2), (1, 1), (1, 1), (1, 2), (1, 2), (4, 1), (4, 2)]
    assert {r["n"] for r in got} == {4} and got[0]["identity_error"] < 1e-9
    assert whitening.whitened_components(spark.createDataFrame([], VECTORS)).count() == 0
    assert whitening.whitened_components(spark.createDataFrame(rows[:2], VECTORS)).count() == 0


def test_sums_of_any_size_are_exact():
    y = np.array([[1 << 40, -(1 << 39)], [3, 1 << 41]], dtype=np.int64)
    whole = y.astype(object)
    assert (whitening._exact_products(y) == whole.T @ whole).all()
    small = np.random.default_rng(7).integers(-5000, 5000, (3000, 4))
    assert (whitening._exact_products(small) == small.astype(object).T @ small.astype(object)).all()
