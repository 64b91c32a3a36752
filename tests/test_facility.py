"""Lazy greedy facility location against the plain greedy."""

import random

import numpy as np
import pytest

from sievekit.operators import blocks, facility
from sievekit.sources.tables import cut


def classes(ties=False):
    rng = random.Random(5)
    rows = []
    for label, n in ((0, 230), (1, 61), (2, 7), (3, 1)):
        for i in range(n):
            v = [rng.randrange(-64, 65) / 16 for _ in range(3)] if not ties else [float(rng.randrange(3)), float(rng.randrange(2)), 0.0]
            rows.append((label, 1000 * label + i, v))
    return rows


def plain(rows, goals):
    out = []
    for label, budget in goals.items():
        own = sorted((i, v) for y, i, v in rows if y == label)
        out += [(label, own[at][0], step, gain) for step, (at, gain) in enumerate(facility.greedy(np.array([v for _, v in own]), budget), 1)]
    return out


@pytest.mark.parametrize("ties", [False, True])
@pytest.mark.parametrize("pool", [1024, 5])
def test_lazy_is_the_plain_greedy(spark, ties, pool):
    rows, goals, measured = classes(ties), {0: 40, 1: 10, 2: 9, 3: 2}, {}
    df = cut(spark.createDataFrame(rows, "label int, sample_id long, vec array<double>"))
    got = facility.lazy(df, goals, rows=20, pool=pool, measured=measured).collect()
    assert [tuple(r) for r in got] == [(y, i, s, pytest.approx(g, abs=1e-6)) for y, i, s, g in plain(rows, goals)]
    # the plain greedy measures every row that is left for each pick
    assert ties or measured[0] < 0.5 * sum(230 - k for k in range(1, 40))


def test_diameter_skips_blocks(spark):
    """Far groups of rows: only the blocks that can hold the widest pair meet, and the result is that of all pairs."""
    rng = random.Random(6)
    rows = [(0, i, [rng.random(), rng.random() + (100.0 if i % 50 == 0 else 0.0)]) for i in range(400)]
    packed = blocks.pack(spark.createDataFrame(rows, "label int, sample_id long, vec array<double>"), {"sample_id": "i8"}, ["label"], 10)
    x = np.array([v for _, _, v in rows])
    want = ((x[:, None] - x[None]) ** 2).sum(2).max()
    assert facility._diameters(packed, facility._sums(packed))[0] == pytest.approx(want)


def test_one_row_and_equal_rows(spark):
    rows = [(0, i, [1.0, 2.0]) for i in range(30)] + [(1, 99, [0.0, 0.0])]
    df = cut(spark.createDataFrame(rows, "label int, sample_id long, vec array<double>"))
    got = facility.lazy(df, {0: 3, 1: 5}, rows=4).collect()
    assert [(r.label, r.sample_id, r.gain) for r in got] == [(0, 0, 0.0), (0, 1, 0.0), (0, 2, 0.0), (1, 99, 0.0)]


def test_all_are_measured_where_bounds_settle_nothing(spark, monkeypatch):
    """After the first pick its bounds say nothing of the gains that are left: a class is measured at once, not some candidates a job."""
    monkeypatch.setattr(facility, "RENEW", 3)
    monkeypatch.setattr(facility, "MEASURED", 2)
    jobs, measure = [], facility._measure
    monkeypatch.setattr(facility, "_measure", lambda *a: jobs.append(1) or measure(*a))
    rows, goals = classes(), {0: 3, 1: 3, 2: 3}
    df = cut(spark.createDataFrame(rows, "label int, sample_id long, vec array<double>"))
    got = [tuple(r) for r in facility.lazy(df, goals, rows=60).collect()]
    assert got == [(y, i, s, pytest.approx(g, abs=1e-6)) for y, i, s, g in plain(rows, goals)]
    assert len(jobs) <= 12  # 60 and more, two candidates a job


def test_supervised_ends_classes_that_cannot_be_among_the_first(spark):
    rng = random.Random(7)
    rows = [(y, 1000 * y + i, [rng.gauss(0, 1) + (9 if j == 0 and i == 0 else 0) for j in range(6)]) for y in range(4) for i in range(90)]
    df, measured = spark.createDataFrame(rows, "label int, sample_id long, vec array<double>"), {}
    want = sorted(((y, i, s, g) for y, i, s, g in plain(rows, dict.fromkeys(range(4), 3))), key=lambda r: (-r[3], r[0], r[2]))[:3]
    got = [tuple(r) for r in facility.supervised(df, 3, 40).collect()]
    assert got == [(y, i, s, pytest.approx(g, abs=1e-6)) for y, i, s, g in want]
    facility.lazy(cut(df), dict.fromkeys(range(4), 3), rows=30, measured=measured, overall=3).collect()
    assert not measured
