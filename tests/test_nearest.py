"""Exact nearest rows against all pairs, and what the triangle inequality saves."""

import numpy as np
import pytest

from sievekit.functions.arrays import NUMPY_METRICS
from sievekit.operators import distance, nearest

SHAPE = "sample_id long, vec array<double>"


def frame(spark, x, first=0):
    return spark.createDataFrame([(i + first, v) for i, v in enumerate(x.tolist())], SHAPE)


def clustered(rng, n, width=4, groups=12):
    centers = rng.normal(size=(groups, width)) * 40
    return np.floor((centers[rng.integers(0, groups, n)] + rng.normal(size=(n, width))) * 256) / 256


@pytest.mark.parametrize("metric", nearest.GEOMETRIES)
@pytest.mark.parametrize("k", [1, 4])
def test_equals_all_pairs(spark, metric, k):
    rng = np.random.default_rng(3)
    x, y = clustered(rng, 150), clustered(np.random.default_rng(4), 333)
    y[5], x[0], x[1], y[7] = y[6], y[5], 0, 0  # a tie, a row of the set, and zeros on both sides
    got = {}
    for r in nearest.nearest(frame(spark, x), frame(spark, y, 1000), k, metric, pivots=18, rows=20).collect():
        got.setdefault(r.sample_id, []).append((r.dist, r.near_id))
    far = NUMPY_METRICS[metric](x, y) * (-1 if metric == "mean_dot" else 1)
    for i, row in enumerate(far):
        want = sorted((d, j + 1000) for j, d in enumerate(row))[:k]
        assert [j for _, j in sorted(got[i])] == [j for _, j in want]
        assert [d for d, _ in sorted(got[i])] == pytest.approx([d for d, _ in want], abs=2e-8)


def test_blocks_are_ruled_out(spark):
    """Groups far apart: few products are made of all that there are."""
    rng = np.random.default_rng(5)
    x, y, work = clustered(rng, 400), clustered(np.random.default_rng(5), 900), {}
    got = nearest.nearest(frame(spark, x), frame(spark, y), 1, "l2", work=work).collect()
    assert len(got) == 400 and work["all"] == 360_000 and work["pairs"] < 0.25 * work["all"]


def test_few_rows_and_none(spark):
    one = frame(spark, np.ones((1, 3)))
    assert [tuple(r) for r in nearest.nearest(one, one, 5, "abs_cos").collect()] == [(0, 0, 0.0)]
    assert nearest.nearest(one, one.limit(0)).collect() == [] and nearest.nearest(one.limit(0), one).collect() == []


def test_assign_beyond_the_limit_of_a_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x, y = clustered(rng, 80), clustered(rng, 60)
    centers = frame(spark, y).withColumnRenamed("sample_id", "cluster_id")
    rows = frame(spark, x).selectExpr("*", "'a' AS dist", "1 AS __best")
    for metric in ("l2", "abs_cos", "cross"):
        small = sorted(tuple(r) for r in distance.assign(rows, centers, metric).select("sample_id", "cluster_id", "dist", "__best").collect())
        with monkeypatch.context() as m:
            m.setattr(distance, "SMALL", 25)
            large = sorted(tuple(r) for r in distance.assign(rows, centers, metric).select("sample_id", "cluster_id", "dist", "__best").collect())
        assert small == large and len(small) == 80


def test_ragged_vectors_are_an_error(spark):
    rows = spark.createDataFrame([(1, [1.0]), (2, [2.0, 3.0, 4.0])], SHAPE)
    with pytest.raises(Exception, match="several widths"):
        distance.gram(rows).collect()
    with pytest.raises(Exception, match="several widths"):
        distance.assign(rows, rows.limit(1).withColumnRenamed("sample_id", "cluster_id")).collect()


def test_rows_are_not_copied_for_each_cell(spark, monkeypatch):
    """Where nothing can be ruled out, a row is written once for all cells that stay open to it."""
    rng, most, pack = np.random.default_rng(9), [], nearest.blocks.pack
    x = rng.normal(size=(300, 24))
    monkeypatch.setattr(nearest.blocks, "pack", lambda df, *a, **b: most.append(df.count()) or pack(df, *a, **b))
    got = nearest.nearest(frame(spark, x), frame(spark, x), 3, "abs_cos", rows=40).collect()
    far = NUMPY_METRICS["abs_cos"](x, x)
    assert {(r.sample_id, r.near_id) for r in got} == {(i, int(j)) for i in range(300) for j in np.lexsort((np.arange(300), far[i]))[:3]}
    assert max(most) == 300
