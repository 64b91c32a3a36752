"""Pairs of rows met in tiles: the same as all pairs at any cut, and no pair written on the way."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievekit import queries as Q
from sievekit.functions.arrays import NUMPY_METRICS
from sievekit.operators import blocks, cluster, distance, select
from sievekit.sources.tables import cut

SHAPE = "sample_id long, label int, vec array<double>"


@pytest.fixture
def rows():
    rng = np.random.default_rng(8)
    x = np.floor(rng.normal(size=(70, 5)) * 256) / 256
    x[9], x[11] = x[3], 0
    ids = rng.permutation(1000)[:70]
    ids[60] = ids[20]  # an id that repeats
    return [(int(i), int(n % 3), v) for n, (i, v) in enumerate(zip(ids, x.tolist(), strict=True))]


@pytest.fixture
def written(monkeypatch):
    """Blocks of a few rows, stripes of one block; takes the columns of all frames that are written."""
    seen, pack = [], blocks.pack
    monkeypatch.setattr(blocks, "STRIPE_BYTES", 1)
    monkeypatch.setattr(blocks, "pack", lambda df, columns, by=None, rows=9: pack(df, columns, by, rows))
    monkeypatch.setattr(blocks, "cut", lambda df, batch=None: seen.append(df.columns) or cut(df, batch))
    return seen


def pairs(df):
    return np.array(sorted(tuple(r) for r in df.collect())).reshape(-1, 3)


def expected(rows, metric, halves, value=lambda d: d):
    x = np.array([v for _, _, v in rows])
    far = value(NUMPY_METRICS[metric](x, x))
    return np.array(sorted((a, b, far[i, j]) for i, (a, _, _) in enumerate(rows) for j, (b, _, _) in enumerate(rows) if not halves or a < b))


def test_all_pairs_are_not_written(spark, rows, written):
    got = pairs(distance.all_pairs_l2(spark.createDataFrame(rows, SHAPE)))
    assert got == pytest.approx(expected(rows, "l2", True), abs=2e-9)
    assert written and not any("id_a" in columns for columns in written)


def test_gram_is_not_written(spark, rows, written):
    df = spark.createDataFrame(rows, SHAPE)
    assert pairs(distance.gram(df)) == pytest.approx(expected(rows, "mean_dot", False), abs=2e-9)
    assert written and not any("id_a" in columns for columns in written)
    other = df.filter("sample_id % 2 = 0")
    assert distance.gram(df, other).count() == 70 * other.count()
    assert distance.gram(df.limit(0)).collect() == [] and distance.gram(df, other.limit(0)).collect() == []


def test_affinity_is_not_written(spark, rows, written):
    got = pairs(distance.affinity(spark.createDataFrame(rows, SHAPE), 0.5))
    assert got == pytest.approx(expected(rows, "abs_cos", True, lambda d: (1 - d) / 0.5), abs=4e-9)
    assert written and not any("id_a" in columns for columns in written)


def forbidden(*_, **__):
    raise AssertionError("a frame of pairs")


def test_greedy_similarity_forms_no_pairs(spark, rows, written, monkeypatch):
    for module in (cluster, distance):
        monkeypatch.setattr(module, "pairs", forbidden, raising=False)
    rows = [r for n, r in enumerate(rows) if n != 60]
    got = [r.sample_id for r in cluster.greedy_similarity(spark.createDataFrame(rows, SHAPE), 4).orderBy("step").collect()]
    ids, x = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
    total, want = np.zeros(5), []
    for _ in range(4):
        mean = np.round(np.abs(np.round((x + total) @ x.T / 5, 9)).mean(1), 9)
        mean[np.isin(ids, want)] = -1
        want.append(int(min(ids[mean == mean.max()])))
        total = total + x[ids == want[-1]][0]
    assert got == want


def test_coreset_counts_form_no_pairs(spark, rows, monkeypatch):
    rows = [r for n, r in enumerate(rows) if n != 60]
    df = spark.createDataFrame([*rows, (2001, 0, None)], SHAPE)
    picks = df.filter("sample_id % 4 = 0")
    sims = distance.pairs(df, picks.select(F.col("sample_id").alias("pick"), "vec"), "abs_cos", "pick").withColumn("sim", -F.col("dist"))
    want = sorted(tuple(r) for r in select.coreset_gamma(sims).collect())
    for module in (select, distance):
        monkeypatch.setattr(module, "pairs", forbidden, raising=False)
    got = sorted(tuple(r) for r in select.coreset_counts(df, picks).collect())
    assert got == want and sum(n for _, n in got) == 70
    assert Q.l24_coreset_gamma(spark, "/root/testdata/sf0.001").count() == 20


@pytest.mark.parametrize("metric", ["l2", "abs_cos"])
def test_silhouette_writes_no_sums(spark, rows, written, metric):
    rows = [(i, y, v) for n, (i, y, v) in enumerate(rows) if n != 60]
    df = spark.createDataFrame(rows, SHAPE)
    got = {r.sample_id: r.score for r in cluster.silhouette(df, df.withColumn("cluster_id", F.col("label")), metric).collect()}
    y, x = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    far = NUMPY_METRICS[metric](x, x)
    for n, (i, _, _) in enumerate(rows):
        own = (y == y[n]) & (np.arange(len(x)) != n)
        a, b = far[n][own].mean(), min(far[n][y == c].mean() for c in set(y) - {y[n]})
        assert got[i] == pytest.approx((b - a) / max(a, b), abs=1e-7)
    assert not any("theirs" in columns for columns in written)


def test_class_similarity_is_not_written(spark, rows, written):
    rows = [*rows, (5000, 7, [1.0] * 5)]  # alone in its class
    df = spark.createDataFrame([*rows, (5001, None, [1.0] * 5)], SHAPE)
    frame = distance.class_similarity(df)
    got = np.array(sorted(tuple(r) for r in frame.collect()))
    assert written and not any("id_a" in columns for columns in written)
    assert "Window" not in frame._jdf.queryExecution().toString()
    d = [(y, min(i, j), max(i, j), sum((p - q) ** 2 for p, q in zip(v, w))) for n, (i, y, v) in enumerate(rows) for j, z, w in rows[n + 1 :] if y == z and i != j]
    top = {y: max(r[3] for r in d if r[0] == y) for y, *_ in d}
    assert got == pytest.approx(np.array(sorted((y, i, j, top[y] - s) for y, i, j, s in d)), abs=2e-9)


def test_label_kernel_shuffles_lists(spark, rows):
    df = spark.createDataFrame([*rows, (5000, 7, [1.0] * 5), (5001, None, [1.0] * 5)], SHAPE)
    frame = distance.label_kernel(df, rows=9)
    want = sorted((min(i, j), max(i, j)) for n, (i, y, _) in enumerate(rows) for j, z, _ in rows[n + 1 :] if y == z and i != j)
    assert sorted(tuple(r) for r in frame.collect()) == want
    assert sorted(tuple(r) for r in distance.label_kernel(df).collect()) == want
