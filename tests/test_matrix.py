"""Matrices of blocks against numpy."""

import random

import numpy as np
import pytest

from wayfold.operators import matrix


def dense(entries, shape):
    out = np.zeros(shape)
    for i, j, v in entries:
        out[i, j] += v
    return out


def whole(df, shape, side):
    return dense([tuple(r) for r in matrix.entries(df, side).collect()], shape)


def test_products(spark):
    r = random.Random(1)
    made = lambda n, m: [(r.randrange(n), r.randrange(m), r.uniform(-1, 1)) for _ in range(120)]
    a, b, side = made(23, 17), made(17, 30), 8
    frame = lambda e: matrix.blocks(spark.createDataFrame([*e, (None, 1, 1.0), (1, None, 1.0), (1, 1, None)], "i long, j long, value double").repartition(3), side)
    da, db = dense(a, (23, 17)), dense(b, (17, 30))
    assert np.allclose(whole(frame(a), (23, 17), side), da)
    assert np.allclose(whole(matrix.transpose(frame(a), side), (17, 23), side), da.T)
    assert np.allclose(whole(matrix.multiply(frame(a), frame(b), side), (23, 30), side), da @ db)
    assert np.allclose(whole(matrix.gram(frame(a), side), (17, 17), side), da.T @ da)
    assert matrix.multiply(frame(a), frame([]), side).count() == 0


@pytest.mark.parametrize("rank", [2, 12])
def test_singular_values(spark, rank):
    rng = np.random.default_rng(rank)
    a = rng.normal(size=(40, rank)) @ np.diag(2.0 ** -np.arange(rank)) @ rng.normal(size=(rank, 21))
    entries = [(int(i), int(j), float(a[i, j])) for i in range(40) for j in range(21)]
    found = matrix.singular_values(matrix.blocks(spark.createDataFrame(entries, "i long, j long, value double"), 8), 3, side=8)
    want = np.linalg.svd(a, compute_uv=False)[:3]
    assert found == pytest.approx(want, rel=1e-5, abs=1e-6 * want[0])
