"""Operators that SQL can't express against plain numpy, on a small table; ties, nulls, empty tables and clashing columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievekit.functions import chance, vec
from sievekit.operators import cluster, distance, facility, metrics, ranks, represent, reweight, select, splits
from sievekit.sources import tables

STEPS = 7


def matrix():
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(90, 6)) * 1024) / 1024
    x[40] = x[7]  # a tie
    return x


@pytest.fixture(scope="module")
def small(spark):
    x = matrix()
    rows = [(i, v, i % 4, -1, float(i % 3 + 1), [float(k) for k in v[:4]]) for i, v in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, "sample_id long, vec array<double>, label int, dist int, w double, logits array<double>")
    return df.repartition(5).cache()


@pytest.fixture(scope="module")
def none(small):
    return small.limit(0)


# --- plain versions -------------------------------------------------------------------------------------------------


def cos(a, b):
    return np.round(1 - np.abs(a @ b.T) / (np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))), 9)


def seeds(x, ids, k):
    chosen = [0]
    while len(chosen) < min(k, len(ids)):
        near = cos(x[ids], x[ids[chosen]]).min(1)
        near[chosen] = -1
        chosen.append(int(np.lexsort((ids, -near))[0]))
    return ids[chosen]


def lloyd(x, centers, steps=STEPS, weights=None):
    c = centers.copy()
    w = np.ones(len(x)) if weights is None else weights
    for _ in range(steps):
        near, old = cos(x, c).argmin(1), c.copy()
        for k in set(near.tolist()):
            c[k] = (x * w[:, None])[near == k].sum(0) / w[near == k].sum()
        if np.sqrt(((c - old) ** 2).sum(1)).sum() ** 2 < 1e-4:
            break
    return c


def picks(x, ids, n):
    c = lloyd(x[ids], x[seeds(x, ids, n)])
    d = cos(x[ids], c)
    return {int(ids[np.lexsort((ids, d[:, k]))[0]]) for k in range(len(c))}


def reps(x, ids, n):
    """As picks, but clustered again with as many centres as have rows until all have."""
    k = n
    while True:
        c = lloyd(x[ids], x[seeds(x, ids, k)])
        d = cos(x[ids], c)
        used = len(set(d.argmin(1).tolist()))
        if used in (k, len(c)):
            return {int(ids[np.lexsort((ids, d[:, j]))[0]]) for j in range(len(c))}
        k = used


def cover(x, ids, chosen):
    return cos(x[ids], x[sorted(chosen)]).min(1)


def farthest(x, ids, chosen, n):
    return np.sort(ids[np.lexsort((ids, -cover(x, ids, chosen)))[:n]])


EVERY = np.arange(90)


def ids_of(df):
    return {r[0] for r in df.select("sample_id").collect()}


# --- places ---------------------------------------------------------------------------------------------------------


def test_places(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 0, 1, 1, 1, 1]), rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "sample_id long, label int, v int").repartition(6)
    order = [F.desc("v"), F.asc("sample_id")]
    want = sorted(rows, key=lambda r: (-r[2], r[0]))
    assert [r[0] for r in sorted(ranks.numbered(df, order).collect(), key=lambda r: r["index"])] == [r[0] for r in want]
    for n in (0, 1, 137, 500, 900):
        assert ids_of(ranks.first(df, order, n, few=0)) == ids_of(ranks.first(df, order, n)) == {r[0] for r in want[:n]}
    got = {r["sample_id"]: r["k"] for r in ranks.within(df, "label", order, "k").collect()}
    for label in (None, 0, 1):
        own = [r[0] for r in want if r[1] == label]
        assert [got[i] for i in own] == list(range(1, len(own) + 1))
    sums = {r["sample_id"]: r["s"] for r in ranks.running_sum(df, "label", order, "v", "s").collect()}
    for label in (None, 0, 1):
        total = 0
        for r in (r for r in want if r[1] == label):
            assert sums[r[0]] == total
            total += r[2]
    assert ranks.first(df.limit(0), order, 3, few=0).count() == 0 and ranks.within(df.limit(0), "label", order, "k").count() == 0


# --- clustering -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("m", [64, 3])
def test_farthest_first(small, m):
    got = cluster.farthest_first_runs(cluster._rows(small), {0: 25}, m=m)[0]
    assert [i for i, _ in got] == seeds(matrix(), EVERY, 25).tolist()


def test_farthest_first_runs_out_of_rows(small):
    assert cluster.farthest_first(small.filter("sample_id < 4"), 9).count() == 4


@pytest.mark.parametrize("weighted", [False, True])
def test_kmeans(small, weighted):
    x = matrix()
    first = cluster.first_seeds(small, 6)
    got = np.array([r.vec for r in cluster.kmeans(small, first, weight="w" if weighted else None, max_iter=STEPS).orderBy("cluster_id").collect()])
    assert np.allclose(got, lloyd(x, x[:6], weights=EVERY % 3 + 1.0 if weighted else None), atol=1e-9)


def test_steps_of_a_registered_metric_are_the_same(small):
    if "own_cos" not in vec.METRICS:
        vec.register("own_cos", vec.abs_cos)
    a, b = ([r.vec for r in cluster.kmeans(small, cluster.first_seeds(small, 4), m, max_iter=3).orderBy("cluster_id").collect()] for m in ("abs_cos", "own_cos"))
    assert np.allclose(a, b, atol=1e-9)
    with pytest.raises(ValueError):
        vec.register("l2", vec.l2)


def test_rounds_that_come_back_end_where_all_steps_would(small):
    """200 steps by way of the cycle and step by step."""
    x = matrix()
    rows = cluster._rows(small.filter("sample_id < 20"))
    found = cluster.kmeans_runs(rows, {0: x[:5]}, max_iter=40)[0]
    assert np.allclose(found, lloyd(x[:20], x[:5], 40), atol=1e-9)


def test_shifts_of_blocks_are_summed_apart(small):
    """The stop test with two blocks asks more than with one."""
    x, found = matrix(), []
    for widths in (None, [3, 3]):
        c = x[:4].copy()
        for steps in range(1, 60):
            new = lloyd(x, c, 1)
            parts = [(0, 6)] if widths is None else [(0, 3), (3, 6)]
            shift = sum(np.sqrt(((new - c)[:, a:b] ** 2).sum(1)).sum() for a, b in parts)
            c = new
            if shift**2 < 30:
                break
        got = np.array([r.vec for r in cluster.kmeans(small, cluster.first_seeds(small, 4), tol=30, widths=widths).orderBy("cluster_id").collect()])
        assert np.allclose(got, c, atol=1e-9)
        found.append(steps)
    assert found[0] <= found[1]


def test_best_k_runs_each_k(small):
    x = matrix()
    got = {r.k: r.score for r in cluster.best_k(small, (2, 5), max_iter=STEPS).collect()}
    for k in (2, 5):
        near = cos(x, lloyd(x, x[seeds(x, EVERY, 5)[:k]])).argmin(1)
        d2 = ((x[:, None] - x[None]) ** 2).sum(2)
        scores = []
        for i in range(90):
            own = [j for j in range(90) if near[j] == near[i] and j != i]
            others = [d2[i, near == c].mean() for c in set(near.tolist()) - {near[i]}]
            a, b = (np.mean(d2[i, own]) if own else None), min(others, default=None)
            scores.append(0 if a is None or b is None or max(a, b) == 0 else (b - a) / max(a, b))
        assert abs(got[k] - np.mean(scores)) < 1e-6


@pytest.mark.parametrize("kind", ["dot", "l2"])
def test_kernel_kmeans_by_hand(small, kind):
    """Clusters as sets of members: the mean product (or squared distance) with them, from the rows with the smallest ids."""
    x = matrix()
    member, last = np.where(EVERY < 4, EVERY, -1), None
    for _ in range(6):
        far = np.full((90, 4), np.inf)
        for c in set(member.tolist()) - {-1}:
            own = x[member == c]
            far[:, c] = 1 - np.abs((x @ own.T / 6).mean(1)) if kind == "dot" else ((x[:, None] - own[None]) ** 2).sum(2).mean(1)
        far = np.round(far, 9)
        member, mean = far.argmin(1), far.min(1).mean()
        if last is not None and abs(last - mean) < 1e-4:
            break
        last = mean
    got = {r.sample_id: r.cluster_id for r in cluster.kernel_kmeans(small, 4, max_iter=6, kind=kind).collect()}
    assert [got[i] for i in range(90)] == member.tolist()


def test_kernel_kmeans_covers_every_row(small):
    for kind in ("dot", "l2"):
        rows = cluster.kernel_kmeans(small, 5, max_iter=3, kind=kind).collect()
        assert len(rows) == 90 and {r.cluster_id for r in rows} <= set(range(5))


def test_nonempty_fixed_and_unit_seeds(spark, small):
    centers = cluster.kmeans_nonempty(small, 6, max_iter=STEPS)
    used = distance.assign(small, centers).select("cluster_id").distinct().count()
    assert used == centers.count()
    units = np.array([r.vec for r in cluster.unit_seeds(spark, 3, 6).collect()])
    assert np.allclose((units**2).sum(1), 1) and cluster.kmeans_fixed(small, 3, 2, centers=cluster.unit_seeds(spark, 3, 6)).count() == 3
    near = distance.assign(small, centers)
    assert cluster.mean_features(small, near).count() == used


def test_weighted_mean_silhouette(spark):
    scores = spark.createDataFrame([(1, 0.5), (2, -1.0)], "sample_id long, score double")
    weights = spark.createDataFrame([(1, 3.0), (2, 0.5)], "sample_id long, w double")
    assert cluster.mean_silhouette(scores).first()[0] == -0.25 and cluster.mean_silhouette(scores, weights).first()[0] == 0.5


def test_large_sets_of_centres_meet_rows_in_blocks(small, monkeypatch):
    centers = cluster.first_seeds(small, 20)
    want = {(r.sample_id, r.cluster_id, r.dist) for r in distance.assign(small, centers).collect()}
    whole = {r.sample_id: r.dist for r in distance.coverage(small, small.filter("sample_id < 20")).collect()}
    monkeypatch.setattr(distance, "SMALL", 3)
    assert {(r.sample_id, r.cluster_id, r.dist) for r in distance.assign(small, centers).collect()} == want
    assert {r.sample_id: r.dist for r in distance.coverage(small, small.filter("sample_id < 20")).collect()} == whole


# --- selection ------------------------------------------------------------------------------------------------------


def test_representatives_and_coverage_loop(small):
    x = matrix()
    first = reps(x, EVERY, 8)
    assert ids_of(select.select_representatives(small, 8, 8, max_iter=STEPS)) == first
    rest, chosen = EVERY, first
    while len(chosen) < 14:
        before = len(chosen)
        rest = farthest(x, rest, chosen, int(len(rest) * 0.25))
        if not len(rest):
            break
        chosen = chosen | reps(x, rest, 14 - len(chosen))
        if len(chosen) == before:
            break
    got = ids_of(select.select_representatives(small, 8, 8, 14, max_iter=STEPS))
    assert got == (chosen if len(chosen) <= 14 else set(sorted(chosen)[:14]))


def test_outliers(small):
    x, have = matrix(), {0, 1, 2}
    for repeat in (False, True):
        chosen = set(have)
        while True:
            before, far = len(chosen), EVERY[cover(x, EVERY, chosen) > 0.5]
            if before >= 12 or not len(far):
                break
            chosen |= picks(x, far, 12 - before)
            if not repeat or len(chosen) == before:
                break
        got = select.outlier_picks(small, small.filter("sample_id < 3"), 12, 0.5, repeat, max_iter=STEPS)
        assert ids_of(got) == chosen


def test_by_class(small):
    x = matrix()
    want = {(y, i) for y in range(4) for i in picks(x, EVERY[EVERY % 4 == y], 3)}
    assert {(r.label, r.sample_id) for r in select.select_by_class(small, 13, max_iter=STEPS).collect()} == want
    assert select.select_by_class(small, 3).count() == 0


def test_radius_cover(small):
    x = matrix()
    chosen = picks(x, EVERY, 6)
    radius = 2 / 3 * cover(x, EVERY, chosen).max()
    while len(chosen) < 11:
        before = len(chosen)
        found = np.array(sorted(picks(x, farthest(x, EVERY, chosen, 45), 12 - before)))
        chosen = chosen | {int(i) for i in found[cover(x, found, chosen) > radius]}
        if len(chosen) == before:
            break
    assert ids_of(select.radius_cover(small, 12, max_iter=STEPS)) == chosen


def test_incremental(small):
    x, have = matrix(), {0, 1, 2, 3}
    found = np.array(sorted(picks(x, farthest(x, EVERY, have, 45), 6)))
    existing = small.filter("sample_id < 4")
    assert ids_of(select.select_incremental(small, existing, 10, max_iter=STEPS)) == set(found.tolist())
    assert ids_of(select.select_incremental(small, existing, 10, 7, max_iter=STEPS)) == set(farthest(x, found, have, 3).tolist())
    assert select.select_incremental(small, existing, 4).count() == 0


def test_boundary_and_representatives(small):
    edge = ids_of(select.select_margin(small, 1))
    assert ids_of(select.select_boundary_and_rep(small, 10, 9, max_iter=STEPS)) == edge | reps(matrix(), EVERY, 9)


def test_rbc_and_gbc_are_made_of_their_parts(spark, small):
    """Rank-one vectors of two checkpoints as blocks, some columns of each, weights: the same by hand."""
    x = matrix()
    z = x[:, :4]
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    epochs = small.withColumn("epoch", F.lit(0)).unionByName(small.withColumn("epoch", F.lit(20)).withColumn("vec", vec.scale(F.col("vec"), 0.5)))
    first = (x[:, :, None] * p[:, None, :]).reshape(90, -1)
    import hashlib

    columns = [sorted(sorted(range(24), key=lambda i: (hashlib.md5(f"0:{b}:{i}".encode()).hexdigest(), i))[:10]) for b in (0, 1)]
    whole = np.concatenate([first[:, columns[0]], 0.5 * first[:, columns[1]]], axis=1)
    c = whole[seeds(whole, EVERY, 5)]
    w, norm = EVERY % 3 + 1.0, np.sqrt((whole * whole).sum(1))
    for _ in range(STEPS):
        near, old = cos(whole, c).argmin(1), c.copy()
        for k in set(near.tolist()):
            c[k] = (whole * w[:, None])[near == k].sum(0) / (w * norm)[near == k].sum()
        if sum(np.sqrt(((c - old)[:, a : a + 10] ** 2).sum(1)).sum() for a in (0, 10)) ** 2 < 1e-4:
            break
    d = cos(whole, c)
    used = len(set(d.argmin(1).tolist()))
    assert used == 5  # else fewer clusters are tried again
    want = {int(np.lexsort((EVERY, d[:, k]))[0]) for k in range(5)}
    weights = small.select("sample_id", "w")
    assert ids_of(select.select_rbc(epochs, 5, 5, columns=10, weights=weights, start=0, max_iter=STEPS)) == want
    labelled = small.withColumn("label", F.col("sample_id").cast("int") % 4)
    for full in (False, True):
        got = ids_of(select.select_gbc(labelled, 6, 6, 4, columns=5, max_iter=3, full_loss=full, total=8))
        assert 5 <= len(got) <= 8
    stacked = ids_of(select.select_gbc(labelled.withColumn("epoch", F.lit(0)), 4, 4, 4, start=0, max_iter=3))
    assert 1 <= len(stacked) <= 4


def test_gbc_by_hand(small):
    """Blocks that the user brings, and the head's own: drawn by importance, flattened, clustered, the nearest row of each centre."""
    x = matrix()
    mine = small.withColumn("blocks", F.array(F.slice("vec", 1, 3), F.slice("vec", 4, 3)))
    labelled = small.withColumn("label", F.col("sample_id").cast("int") % 4)
    p = np.exp(x[:, :4] - x[:, :4].max(1, keepdims=True))
    g = p / p.sum(1, keepdims=True) - np.eye(4)[EVERY % 4]
    head = [g, (g[:, :, None] * x[:, None, :]).reshape(90, -1)]
    for blocks, got in (([x[:, :3], x[:, 3:]], select.select_gbc(mine, 4, 4, 4, blocks="blocks", max_iter=STEPS)), (head, select.select_gbc(labelled, 4, 4, 4, max_iter=STEPS))):
        share = np.array([(b * b).sum(1).mean() / b.shape[1] for b in blocks])
        share /= share.sum()
        import hashlib

        drawn = []
        for i in range(2):
            u = int(hashlib.md5(f"0:{i}".encode()).hexdigest()[:8], 16) / (1 << 32)
            b = int(np.searchsorted(np.cumsum(share), u, "right"))
            drawn.append(blocks[b] / np.sqrt(share[b]))
        whole = np.concatenate(drawn, axis=1)
        cuts = np.cumsum([0, *(b.shape[1] for b in drawn)])
        c = whole[seeds(whole, EVERY, 4)]
        for _ in range(STEPS):
            near, old = cos(whole, c).argmin(1), c.copy()
            for k in set(near.tolist()):
                c[k] = whole[near == k].mean(0)
            if sum(np.sqrt(((c - old)[:, a:b] ** 2).sum(1)).sum() for a, b in zip(cuts, cuts[1:])) ** 2 < 1e-4:
                break
        d = cos(whole, c)
        assert len(set(d.argmin(1).tolist())) == 4
        assert ids_of(got) == {int(np.lexsort((EVERY, d[:, k]))[0]) for k in range(4)}


def test_zero_vectors_and_lone_classes(spark, small):
    """Stated values where there is nothing to divide by."""
    zero = small.limit(3).withColumn("vec", F.array(*[F.lit(0.0)] * 6)).withColumn("sample_id", F.col("sample_id") + 1000)
    rows = small.unionByName(zero)
    centers = cluster.first_seeds(small, 3)
    for metric, want in (("abs_cos", 1.0), ("neg_cos", 0.0), ("cross", 1.0), ("abs_cos_by_norm", 1.0)):
        got = {r.dist for r in distance.assign(rows, centers, metric).filter("sample_id >= 1000").collect()}
        row = rows.filter("sample_id >= 1000").join(F.broadcast(centers.withColumnRenamed("vec", "c"))).select(F.round(vec.METRICS[metric](F.col("vec"), F.col("c")), 9).alias("d"))
        assert got == {want} == {r.d for r in row.collect()}, metric
    assert distance.coverage(rows, small.limit(2)).count() == 93
    assert len(select.select_representatives(rows, 4, 4, max_iter=3).collect()) >= 1
    one = spark.createDataFrame([(1, 1, [0.5, 0.5])] * 3, "label int, predicted int, scores array<double>")
    assert metrics.quadratic_kappa(one).first()[0] is None
    assert [(r.label, r.auc) for r in metrics.roc_auc(one).orderBy("label").collect()] == [(0, None), (1, None)] and metrics.macro_auc(one).first()[0] is None
    cells = spark.createDataFrame([(1, 0.0), (1, 0.0), (2, 1.0), (2, -0.5)], "sample_id long, d double")
    assert metrics.d_value(cells).first().n == 1
    blank = spark.createDataFrame([(1, [[0.0], [0.0, 0.0]])], "sample_id long, blocks array<array<double>>")
    assert [r.prob for r in represent.block_probabilities(blank).collect()] == [0.5, 0.5] and represent.sample_blocks(blank, 2).count() == 1


def test_trajectories(spark):
    rows = [(i, e, (1.0 if i < 5 else -2.0) * (1 + 0.01 * i) * (e + 1)) for i in range(10) for e in range(3) if (i, e) != (9, 1)]
    got = select.select_by_trajectory(spark.createDataFrame(rows, "sample_id long, epoch int, delta double"), 5, 2).collect()
    assert [r.sample_id for r in got] == [8, 4]


def test_selectors_by_name(small):
    assert ids_of(select.select(small, "uncertain", 4)) == ids_of(select.select_uncertain(small, 4))
    select.SELECTORS.pop("smallest", None)
    select.register_selector("smallest", lambda df, n, start=0: df.filter(F.col("sample_id") >= start).orderBy("sample_id").limit(n))
    assert ids_of(select.select(small, "smallest", 2, start=5)) == {5, 6}
    for call in (lambda: select.select(small, "nothing", 3), lambda: select.register_selector("rbc", None)):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(TypeError):
        select.select(small, "margin", 3, unknown=1)


def test_pool_split(small):
    picked, rest = select.pool_split(small.withColumn("score", -F.col("sample_id")), 5, 30)
    assert picked.count() == 5 and rest.count() == 85 and not ids_of(picked) & ids_of(rest)


def test_a_model_of_the_users(small):
    def make():
        return lambda x: np.asarray(x)[:, :2] * 2.0

    rows = represent.predict(small, make).select("vec", "logits").collect()
    assert len(rows) == 90 and all(np.allclose(r.logits, np.array(r.vec[:2]) * 2) for r in rows)


# --- facility location ----------------------------------------------------------------------------------------------


def test_facility_location_is_the_plain_greedy_at_every_size(small):
    x, want = matrix(), []
    for y in range(4):
        ids = EVERY[EVERY % 4 == y]
        d2 = ((x[ids][:, None] - x[ids][None]) ** 2).sum(2)
        sim, best, free = d2.max() - d2, np.zeros(len(ids)), np.ones(len(ids), bool)
        for step in range(1, 4):
            gains = np.where(free, np.round(np.maximum(sim - best[:, None], 0).sum(0), 9), -1)
            at = int(gains.argmax())
            want.append((y, int(ids[at]), step, round(float(gains[at]), 5)))
            free[at], best = False, np.maximum(best, sim[:, at])
    goals = small.select("label").distinct().withColumn("budget", F.lit(3))
    for chunk in (2000, 22, 6):
        got = facility.per_class(small, goals, chunk).collect()
        assert sorted((r.label, r.sample_id, r.step, round(r.gain, 5)) for r in got) == sorted(want)
    top = facility.supervised(small, 5, 6).collect()
    assert [(r.label, r.sample_id) for r in top] == [(w[0], w[1]) for w in sorted(want, key=lambda w: (-w[3], w[0], w[2]))[:5]]


# --- corruption, weights, metrics -------------------------------------------------------------------------------------


def test_corruption_is_stored(small, tmp_path):
    want = {}
    for kind in ("uniform", "matrix", "other", "biased", "adversarial"):
        out = {r.sample_id: r.label for r in splits.corrupt(small, kind, 0.3, 4, 3, clusters=3).collect()}
        flipped = sum(out[i] != i % 4 for i in out)
        assert len(out) == 90 and 0 < flipped <= 45
        want[kind] = out
    store = f"{tmp_path}/labels"
    for kind in ("biased", "uniform"):  # the second call uses what the first has stored
        assert {r.sample_id: r.label for r in splits.corrupt(small, kind, 0.3, 4, 3, store=store).collect()} == want["biased"]
    with pytest.raises(ValueError):
        splits.corrupt(small, "none", 0.3, 4)


def test_head_training(spark, small):
    labelled = small.select("vec", "label", "w")
    x, y = matrix(), EVERY % 4
    head, speed, w = np.zeros((4, 6)), np.zeros((4, 6)), EVERY % 3 + 1.0
    for r in reweight.train_head(labelled, 4, 0.3, 4, "w", momentum=0.9).collect():
        z = x @ head.T
        p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        assert abs(r.loss + np.log(p[EVERY, y]).mean()) < 1e-9 and np.allclose(r.head, head.ravel())
        g = ((p - np.eye(4)[y]) * w[:, None]).T @ x / 90
        speed = 0.9 * speed + g
        head = head - 0.3 * (g + 0.9 * speed)
    tuned = reweight.train_head(labelled, 4, 0.1, 2, start=head.ravel().tolist(), validation=labelled.limit(10)).collect()
    assert np.allclose(tuned[0].head, head.ravel()) and tuned[1].head != tuned[0].head
    with pytest.raises(ValueError):
        reweight.train_head(labelled, 4, 0.1, 1, start=[0.0])


def test_rates_decay_at_milestones():
    assert [reweight.decayed_rate(2.0, e, (3, 5)) for e in (0, 3, 5)] == pytest.approx([2.0, 0.2, 0.02])


def test_early_stop_ties(spark):
    rows = [("a", 0, 1.0, 3.0, 0.1), ("a", 1, 2.0, 1.0, 0.2), ("a", 2, 2.0, 1.0, 0.3)]
    h = spark.createDataFrame(rows, "run string, epoch int, metric double, loss double, test_metric double")
    pick = lambda **k: metrics.early_stop(h, **k).first().epoch
    assert (pick(), pick(tie="first"), pick(rule="loss"), pick(tie="first", rule="loss")) == (2, 1, 2, 1)
    with pytest.raises(ValueError):
        metrics.early_stop(h, "other")


def test_confusion(spark):
    df = spark.createDataFrame([(0, 1), (0, 1), (1, 1)], "label int, predicted int")
    assert {tuple(r) for r in metrics.confusion(df).collect()} == {(0, 1, 2), (1, 1, 1)}


def test_csv_manifest_and_promotion(spark, small, tmp_path):
    (tmp_path / "img").mkdir()
    for name in ("a.png", "b.png"):
        (tmp_path / "img" / name).write_bytes(b"x")
    (tmp_path / "m.csv").write_text("file_name,label\na.png,1\nmissing.png,0\nb.png,3\n")
    got = tables.read_csv_manifest(spark, f"file://{tmp_path}/m.csv", f"file://{tmp_path}/img/*.png").collect()
    assert {(r.file_name, r.label) for r in got} == {("a.png", 1), ("b.png", 3)}
    for epoch in (0, 1):
        tables.save_weights(small.select("sample_id", F.lit(float(epoch)).alias("w")), f"{tmp_path}/w", epoch)
    tables.promote_weights(spark, f"{tmp_path}/w", 0, f"{tmp_path}/best")
    assert spark.read.parquet(f"{tmp_path}/best").agg(F.max("w")).first()[0] == 0.0


# --- empty tables -----------------------------------------------------------------------------------------------------


def test_empty_tables(spark, small, none):
    some = small.filter("sample_id < 3")
    centers = cluster.first_seeds(small, 3)
    made = {
        "farthest_first": cluster.farthest_first(none, 3),
        "random_seeds": cluster.random_seeds(none, 3),
        "assign": distance.assign(none, centers),
        "coverage": distance.coverage(none, some),
        "coverage of nothing": distance.coverage(some, none),
        "holdout": splits.holdout_count(none, 3),
        "by class": splits.holdout_by_class(none, 3),
        "cap": splits.cap_per_class(none),
        "long tail": splits.long_tail(none, 2.0),
        "bootstrap": splits.bootstrap(none, 3),
        "flip": splits.flip_random(none, 0.2, 4),
        "uncertain": select.select_uncertain(none, 3),
        "representatives": select.select_representatives(none, 3, 3),
        "by label": select.select_by_class(none, 3),
        "facility": facility.per_class(none, some.select("label").withColumn("budget", F.lit(2))),
        "silhouette": cluster.silhouette_by_means(none, distance.assign(none, centers)),
        "auc": metrics.roc_auc(none.select("label", F.col("logits").alias("scores"))),
        "votes": metrics.knn_vote(none, small, 3, 0.5),
        "dense": chance.dense_index(none),
    }
    assert {k: v.count() for k, v in made.items()} == dict.fromkeys(made, 0)
    assert cluster.kmeans(none, centers, max_iter=2).count() == 3 and cluster.kmeans(small, centers.limit(0)).count() == 0
    assert splits.cap_per_class(small.withColumn("_rank", F.lit(1)), 2).columns == [*small.columns, "_rank"]
