"""Spectral clustering against a dense computation of the same graph."""

import numpy as np
import pytest

from sievekit.operators import cluster, spectral

M = 8


def points(n=120):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4, 6))[np.arange(n) % 4] * 3 + rng.normal(size=(n, 6))
    return np.floor(x * 256) / 256


def dense(x, m=M):
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    c = np.abs(unit @ unit.T)
    w = np.zeros_like(c)
    for i in range(len(x)):
        order = [j for j in np.lexsort((np.arange(len(x)), np.round(1 - c[i], 9))) if j != i][:m]
        w[i, order] = c[i, order]
    return np.maximum(w, w.T)


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(list(enumerate(points().tolist())), "sample_id long, vec array<double>").cache()


def test_graph_and_degrees(df):
    w = dense(points())
    got = {r.sample_id: r.degree for r in spectral.degrees(spectral.neighbour_graph(df, M)).collect()}
    assert [got[i] for i in range(len(w))] == pytest.approx(w.sum(1).tolist(), abs=1e-6)


def test_eigenvectors_equal_the_dense_ones(df):
    w = dense(points())
    d = w.sum(1)
    values, vectors = np.linalg.eigh(w / np.sqrt(d[:, None] * d))
    frame, got = spectral.eigenvectors(df, 4, M, tol=1e-8)
    assert got == pytest.approx(values[::-1][:4].tolist(), abs=1e-4)
    q = np.array([r.vec for r in frame.orderBy("sample_id").collect()])
    assert np.allclose(q.T @ q, np.eye(4), atol=1e-6)
    assert values[-4] - values[-5] > 0.01  # the space of the four is well apart from the next
    assert np.linalg.svd(vectors[:, -4:].T @ q)[1] == pytest.approx([1] * 4, abs=1e-3)


def test_clusters_are_those_of_the_points(df):
    rows = cluster.spectral(df, 4, 4, M).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.cluster_id, []).append(r.sample_id % 4)
    assert len(rows) == 120 and sum(max(map(g.count, set(g))) for g in groups.values()) >= 110
    marks = cluster.spectral(df, 4, 4, landmarks=30).collect()
    assert len(marks) == 120


def test_few_rows(spark, df):
    assert spectral.eigenvectors(df.limit(0), 3)[1] == []
    frame, values = spectral.eigenvectors(df.filter("sample_id < 2"), 3, iterations=5)
    assert frame.count() == 2 and len(values) == 2
