"""SVD geometry: the whole rank, parts of the matrix that are linked by nothing, and repeated values."""

import numpy as np
import pytest

from kairograph.operators import models, spectral
from kairograph.plans import registry

DATA = "/root/testdata/sf0.001"


def expected(log, k):
    """Cosines between destinations by a dense factorisation, and the singular values."""
    pairs = {(r.src, r.dst) for r in log.collect()}
    names = {s: i for i, s in enumerate(sorted({s for s, _ in pairs}))}
    dense = np.zeros((len(names), 1 + max(d for _, d in pairs)))
    for s, d in pairs:
        dense[names[s], d] = 1
    _, values, vectors = np.linalg.svd(dense, full_matrices=False)
    vecs = vectors[:k].T * np.sqrt(values[:k])
    norms = np.linalg.norm(vecs, axis=1, keepdims=True)
    vecs = np.where(norms > 1e-9, vecs / np.where(norms > 0, norms, 1), 0)
    return vecs @ vecs.T, values


def given(frame):
    rows = frame.orderBy("id").collect()
    assert [r.id for r in rows] == list(range(len(rows)))
    return np.array([r.vec for r in rows])


def test_the_registered_query_has_128_vectors(spark):
    vecs = given(registry.QUERIES["svd_geometry"](spark, DATA))
    cosines, values = expected(registry.Inputs(spark, DATA, "orders").train, 128)
    assert vecs.shape == (len(cosines), 128) and values[127] - values[128] > 1e-6
    assert np.abs(vecs @ vecs.T - cosines).max() < 1e-6


def test_parts_are_solved_apart_and_again_where_they_hold_more(spark):
    """A dense part holds all leading values but less than its share of the entries; 1,500 pairs are parts of their own, and some ids are no one's."""
    draw = np.random.default_rng(3)
    dense = [(s, d) for s in range(40) for d in range(40) if draw.random() < 0.5]
    pairs = [(1000 + i, 50 + i) for i in range(1500)]
    log = spark.createDataFrame([(s, d, 0.0) for s, d in dense + dense[:9] + pairs], "src long, dst long, time double").repartition(7)
    k = 30
    assert 4 + 2 * k * len(dense) // (len(dense) + len(pairs)) < k  # the first round's share does not do
    for n in (5, k):
        cosines, values = expected(log, n)
        assert values[n - 1] - values[n] > 1e-6
        vecs = given(models.svd_geometry(log, n))
        assert vecs.shape == (1550, n) and np.abs(vecs @ vecs.T - cosines).max() < 1e-6


@pytest.mark.parametrize("k", [2, 4, 6])
def test_copies_have_the_same_values(spark, k):
    draw = np.random.default_rng(5)
    one = [(s, d) for s in range(20) for d in range(15) if draw.random() < 0.4]
    log = spark.createDataFrame([(s + 100 * c, d + 20 * c, 0.0) for c in range(2) for s, d in one], "src long, dst long, time double")
    cosines, values = expected(log, k)
    assert abs(values[k - 1] - values[k - 2]) < 1e-9 < values[k - 1] - values[k]
    vecs = given(models.svd_geometry(log, k))
    assert np.abs(vecs @ vecs.T - cosines).max() < 1e-6


def test_no_rows_and_ids_without_a_column(spark):
    kind = "src long, dst long, time double"
    assert models.svd_geometry(spark.createDataFrame([], kind)).collect() == []
    assert [r.id for r in models.svd_geometry(spark.createDataFrame([(1, 2, 0.0), (None, 1, 0.0), (3, None, 0.0)], kind)).orderBy("id").collect()] == [0, 1, 2]
    with pytest.raises(ValueError):
        models.svd_geometry(spark.createDataFrame([(1, -2, 0.0)], kind))


def test_repeated_values_are_all_found():
    values = np.concatenate([[9.0] * 5, [8.0] * 4, np.linspace(7, 0, 391)])
    turn = np.linalg.qr(np.random.default_rng(1).standard_normal((400, 400)))[0]
    whole = (turn * values) @ turn.T
    found, vectors = spectral.leading(lambda x: whole @ x, 400, 9, 40)
    assert np.allclose(found, values[:9], atol=1e-8) and np.allclose(vectors @ vectors.T, np.eye(9), atol=1e-9)
    assert np.allclose(vectors.T @ vectors, turn[:, :9] @ turn[:, :9].T, atol=1e-6)
