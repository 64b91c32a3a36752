"""Farthest-first seeding, weighted k-means under the metrics of functions.vec, silhouette."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.functions import chance, vec
from sievekit.functions.arrays import NUMPY_METRICS
from sievekit.functions.arrays import norms as _norms
from sievekit.operators import blocks, sums
from sievekit.operators.distance import assign, centre_array, member_dist
from sievekit.operators.represent import mean_vector
from sievekit.operators.spectral import eigenvectors
from sievekit.sources.tables import cut


#: Tasks whose candidates meet in one.
FAN = 32


def random_seeds(df: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k rows by ticket, as centres numbered in that order."""
    return _numbered(df.orderBy(*chance.order(seed)).limit(k).select("sample_id", "vec").collect(), df)


def first_seeds(df: DataFrame, k: int) -> DataFrame:
    """The k rows with the smallest ids, as centres."""
    return _numbered(df.orderBy("sample_id").limit(k).select("sample_id", "vec").collect(), df)


def _numbered(rows, df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(i, list(r["vec"])) for i, r in enumerate(rows)], "cluster_id int, vec array<double>")


def _top_candidates(rows: DataFrame, chosen: dict, metric: str, m: int) -> dict:
    """For each run the m rows farthest from its chosen ones, (near, sample_id, vec), farthest first (ties: smaller id).

    Each task passes on its own m, and FAN tasks' candidates meet in a tree, so that only m rows a run reach the driver.
    """
    shared = rows.sparkSession.sparkContext.broadcast({run: (np.array([c[0] for c in own]), np.array([c[1] for c in own])) for run, own in chosen.items()})
    measure, names = NUMPY_METRICS[metric], ["run", "near", "sample_id", "vec"]

    def best(found: dict, run, near, ids, vecs):
        order = np.lexsort((ids, -near))[:m]
        before = found.get(run, (np.zeros(0), np.zeros(0, np.int64), np.zeros((0, vecs.shape[1]))))
        near, ids, vecs = (np.concatenate([x, y[order]]) for x, y in zip(before, (near, ids, vecs), strict=True))
        order = np.lexsort((ids, -near))[:m]
        found[run] = near[order], ids[order], vecs[order]

    def out(found: dict):
        for run, (near, ids, vecs) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), run, np.int64)), pa.array(near), pa.array(ids), pa.array(list(vecs), pa.list_(pa.float64()))], names=names)

    def measured(batches):
        found: dict = {}
        for runs, ids, vecs, _ in _numpy(batches):
            for run in np.unique(runs).tolist():
                own = runs == run
                taken, centers = shared.value[run]
                free = own & ~np.isin(ids, taken)
                if free.any():
                    best(found, run, measure(vecs[free], centers).min(axis=1), ids[free], vecs[free])
        yield from out(found)

    def merged(batches):
        found: dict = {}
        for b in batches:
            runs, vecs = b.column(0).to_numpy(), np.stack(b.column(3).to_numpy(zero_copy_only=False)) if b.num_rows else None
            for run in np.unique(runs).tolist():
                own = runs == run
                best(found, run, b.column(1).to_numpy()[own], b.column(2).to_numpy()[own], vecs[own])
        yield from out(found)

    shape = "run long, near double, sample_id long, vec array<double>"
    got: dict = {}
    parts = rows.mapInArrow(measured, shape)
    tasks = rows.rdd.getNumPartitions()
    while tasks > 1:  # so many tasks' candidates meet in one, and those of such meetings again
        tasks = -(-tasks // FAN)
        parts = parts.repartition(tasks).mapInArrow(merged, shape)
    for r in parts.collect():
        got.setdefault(r["run"], []).append((-r["near"], r["sample_id"], r["vec"]))
    shared.destroy()
    return {run: sorted(own) for run, own in got.items()}


def farthest_first_runs(rows: DataFrame, k: dict, metric: str = "abs_cos", seed: int | None = None, m: int = 64) -> dict:
    """For each run its first row (smallest id, or by ticket), then the row farthest from all so far, up to k[run]: lists of (sample_id, vec).

    rows: (run, sample_id, vec, w), written. A pass brings the m farthest rows of each run to the driver, which goes on
    choosing among them as long as no row that stayed behind can be farther: distances to a growing set only shrink,
    so every row that stayed is behind the m-th of the pass. So a pass gives several seeds, the same as one by one.
    """
    order = [F.col("sample_id")] if seed is None else chance.order(seed)
    firsts = rows.groupBy("run").agg(F.min_by(F.struct("sample_id", "vec"), F.struct(*order)).alias("f")).collect()
    chosen = {r["run"]: [(r["f"]["sample_id"], r["f"]["vec"])] for r in firsts}
    open_ = {run for run in chosen if k[run] > 1}
    measure = NUMPY_METRICS[metric]
    while open_:
        pools = _top_candidates(rows.filter(F.col("run").isin(list(open_))), {run: chosen[run] for run in open_}, metric, m)
        for run in list(open_):
            pool = pools.get(run, [])
            if not pool:
                open_.discard(run)
                continue
            last = pool[-1][:2] if len(pool) == m else (0.0, 0)
            near, ids, vecs = -np.array([c[0] for c in pool]), np.array([c[1] for c in pool]), np.array([c[2] for c in pool])
            while len(chosen[run]) < k[run] and len(ids):
                at = np.lexsort((ids, -near))[0]
                if len(pool) == m and (-near[at], ids[at]) > last:
                    break
                chosen[run].append((int(ids[at]), vecs[at].tolist()))
                near = np.minimum(near, measure(vecs, vecs[at : at + 1])[:, 0])
                near, ids, vecs = (np.delete(x, at, axis=0) for x in (near, ids, vecs))
            if len(chosen[run]) >= k[run] or len(pool) < m:
                open_.discard(run)
    return chosen


def farthest_first(df: DataFrame, k: int, metric: str = "abs_cos", seed: int | None = None) -> DataFrame:
    """(cluster_id, sample_id, vec): a first row (smallest id, or by ticket), then k - 1 times the row farthest from all so far; fewer where rows are."""
    found = farthest_first_runs(_rows(df), {0: k}, metric, seed).get(0, [])
    return df.sparkSession.createDataFrame([(i, c[0], list(c[1])) for i, c in enumerate(found)], "cluster_id int, sample_id long, vec array<double>")


# --- many runs of k-means in one job a step ----------------------------------------------------------------------


def _rows(df: DataFrame, weight: str | None = None, run: str | None = None) -> DataFrame:
    """(run, sample_id, vec, w) of df, written once for all steps."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    own = F.col(run).cast("long") if run else F.lit(0).cast("long")
    return cut(df.filter(F.col("vec").isNotNull()).select(own.alias("run"), F.col("sample_id").cast("long").alias("sample_id"), "vec", w.alias("w")))


def _numpy(batches):
    """(runs, ids, vectors, weights) of each batch."""
    for b in batches:
        if b.num_rows:
            yield b.column(0).to_numpy(), b.column(1).to_numpy(), blocks.matrix(b.column(2)), b.column(3).to_numpy()


def _packed(rows: DataFrame) -> DataFrame:
    """The rows of _rows in matrices by run, which the steps read."""
    return blocks.pack(rows, {"w": "f8"}, ["run"])


def _step(packed: DataFrame, centers: dict, metric: str, weighted: bool, by_norm: bool, every: bool) -> dict:
    """{run: {place of centre: (mass, sum)}} after one assignment. every: each row takes part in each run, else in its own.

    The centres travel to every task; each task adds up its rows by centre and passes on one array a run.
    """
    shared = packed.sparkSession.sparkContext.broadcast(centers)
    measure = NUMPY_METRICS[metric]

    def local(batches):
        for batch in batches:
            for row in batch.select(["run", "n", "vec", "w"]).to_pylist():
                own = blocks.unpack(row, {"w": "f8"})
                v, w = own["vec"], own["w"]
                norm = _norms(v) if by_norm else None
                scaled = v * w[:, None]
                mass = w
                if by_norm and weighted:
                    mass = w * norm
                elif by_norm:
                    scaled = np.divide(scaled, norm[:, None], out=np.zeros_like(scaled), where=norm[:, None] != 0)
                for run in shared.value if every else [r for r in (row["run"],) if r in shared.value]:
                    near = measure(v, shared.value[run]).argmin(axis=1)
                    member = np.zeros((len(shared.value[run]), len(v)))
                    member[near, np.arange(len(v))] = 1
                    yield run, np.concatenate([member @ mass, member.sum(1), (member @ scaled).ravel()])

    numbers = sum(c.shape[0] * (c.shape[1] + 2) for c in centers.values())
    got = sums.collect(packed, local, numbers)
    shared.destroy()
    found: dict = {}
    for run, matrix in centers.items():
        k, d = matrix.shape
        x = got.get(run, np.zeros(k * (d + 2)))
        found[run] = {c: (float(x[c]), x[2 * k + c * d : 2 * k + (c + 1) * d]) for c in range(k) if x[k + c] > 0}
    return found


def kmeans_runs(rows: DataFrame, seeds: dict, metric: str = "abs_cos", weighted: bool = False, by_norm: bool = False, tol: float = 1e-4, max_iter: int = 200, frozen: int = 0, widths: list[int] | None = None, every: bool = False) -> dict:
    """{run: centres} after Lloyd steps of several runs at once, one job a step.

    rows: (run, sample_id, vec, w), written; seeds: {run: matrix}, whose first frozen centres never move. A run ends
    when the squared sum of its centres' shifts (each block of widths by itself) is below tol, or after max_iter
    steps. Means need not settle under an absolute cosine: a run that comes back to earlier centres goes round from
    there on, so only what is left of max_iter beyond whole rounds is still computed. An empty cluster keeps its centre.
    """
    now = {run: np.array(c, float) for run, c in seeds.items() if len(c)}
    left, seen = dict.fromkeys(now, max_iter), {run: {} for run in now}
    packed = _packed(rows) if now else None
    cuts = np.cumsum([0, *widths]) if widths else None
    while active := [run for run in now if left[run] > 0]:
        found = _step(packed, {run: now[run] for run in active}, metric, weighted, by_norm, every)
        for run in active:
            new = now[run].copy()
            for c, (mass, total) in found[run].items():
                if c >= frozen and mass != 0:
                    new[c] = total / mass
            moved = new - now[run]
            shift = sum(_norms(moved[:, a:b]).sum() for a, b in (zip(cuts, cuts[1:]) if cuts is not None else [(0, moved.shape[1])]))
            now[run], left[run] = new, left[run] - 1
            if shift**2 < tol:
                left[run] = 0
                continue
            key = hashlib.sha256(new.tobytes()).digest()
            if key in seen[run]:
                left[run] %= seen[run][key] - left[run]
            seen[run][key] = left[run]
    return now


def lloyd_step(df: DataFrame, centers: DataFrame, metric: str = "abs_cos", weight: str | None = None, by_norm: bool = False) -> DataFrame:
    """(cluster_id, vec) after one assignment and weighted mean; an empty cluster keeps its centre.

    by_norm: mean of the unit vectors; with weights the sum of w*x over the sum of w*|x|.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    near = assign(df, centers, metric)
    if by_norm and not weight:
        near = near.withColumn("vec", vec.scale(F.col("vec"), 1 / vec.norm(F.col("vec"))))
    mass = w * vec.norm(F.col("vec")) if by_norm and weight else w
    parts = near.select("cluster_id", F.posexplode("vec").alias("i", "x"), w.alias("w"), mass.alias("mass"))
    means = parts.groupBy("cluster_id", "i").agg((F.sum(F.col("x") * F.col("w")) / F.sum("mass")).alias("x"))
    moved = means.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("_new"))
    return centers.join(moved, "cluster_id", "left").select("cluster_id", F.coalesce("_new", "vec").alias("vec"))


def kmeans(df: DataFrame, centers: DataFrame, metric: str = "abs_cos", weight: str | None = None, by_norm: bool = False, tol: float = 1e-4, max_iter: int = 200, frozen: DataFrame | None = None, widths: list[int] | None = None) -> DataFrame:
    """Centres (cluster_id, vec) after Lloyd steps until the squared sum of shifts is below tol.

    frozen centres take part in the assignment and never move; free clusters are numbered after them. widths: of the
    blocks that vec is made of (see flatten_blocks); their shifts are summed apart. A metric that users registered is
    evaluated by lloyd_step. The k centres are the only state between steps.
    """
    shape = "cluster_id int, vec array<double>"
    order = lambda c: sorted((r["cluster_id"], r["vec"]) for r in c.select("cluster_id", "vec").collect())
    fixed, free = (order(frozen) if frozen is not None else []), order(centers)
    first = [*fixed, *((i + len(fixed), v) for i, v in free)]
    if metric in NUMPY_METRICS:
        found = kmeans_runs(_rows(df, weight), {0: [v for _, v in first]}, metric, weight is not None, by_norm, tol, max_iter, len(fixed), widths).get(0, [])
        return df.sparkSession.createDataFrame([(i, v) for (i, _), v in zip(first, np.asarray(found).tolist(), strict=True)], shape)
    df = cut(df)
    for _ in range(max_iter):
        step = lloyd_step(df, df.sparkSession.createDataFrame(first, shape), metric, weight, by_norm)
        moved = {r["cluster_id"]: r["vec"] for r in step.collect()}
        new = [*fixed, *((i, moved[i]) for i, _ in first[len(fixed) :])]
        shift = sum(sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) ** 0.5 for (_, a), (_, b) in zip(first, new, strict=True))
        first = new
        if shift**2 < tol:
            break
    return df.sparkSession.createDataFrame(first, shape)


def flatten_blocks(df: DataFrame, blocks: str = "blocks") -> tuple[DataFrame, list[int]]:
    """df with vec made of its blocks, and the blocks' widths: distances over all blocks are those of the whole vector."""
    one = df.select(F.transform(blocks, F.size).alias("w")).first()
    return df.withColumn("vec", F.flatten(blocks)), list(one["w"]) if one else []


def kmeans_nonempty(df: DataFrame, k: int, seeds=None, metric: str = "abs_cos", weight: str | None = None, by_norm: bool = False, max_iter: int = 200, widths: list[int] | None = None) -> DataFrame:
    """k-means, run again with the number of clusters that have rows until all have. seeds(df, k) gives the first centres, farthest-first ones by default."""
    seeds = seeds or (lambda d, n: farthest_first(d, n, metric))
    while True:
        centers = kmeans(df, seeds(df, k).select("cluster_id", "vec"), metric, weight, by_norm, max_iter=max_iter, widths=widths)
        used = assign(df, centers, metric).agg(F.countDistinct("cluster_id")).first()[0]
        if used in (0, k) or used == centers.count():
            return centers
        k = used


def unit_seeds(spark, k: int, width: int, seed: int = 0) -> DataFrame:
    """k reproducible random directions as centres (cluster_id, vec): normal numbers, scaled to length 1."""
    draws = np.random.default_rng(seed).standard_normal((k, width))
    return spark.createDataFrame([(i, v) for i, v in enumerate((draws / _norms(draws)[:, None]).tolist())], "cluster_id int, vec array<double>")


def silhouette(df: DataFrame, assigned: DataFrame, metric: str = "l2") -> DataFrame:
    """(sample_id, score) by all distances within df; 0 where a row has no other of its cluster, or both means are 0.

    Rows meet in tiles, each two blocks once, and a tile passes on a sum per row and cluster, so no pair leaves a task; what is shuffled is
    rows x clusters for each stripe of blocks. The arithmetic is still the square of the rows; for squared distances silhouette_by_means has none of it.
    """
    columns = {"sample_id": "i8", "cluster_id": "i8"}
    packed = blocks.pack(df.select("sample_id", "vec").join(assigned.select("sample_id", F.col("cluster_id").cast("long").alias("cluster_id")), "sample_id"), columns)
    parts = blocks.tiles(packed, None, columns, _distance_sums(metric), "sample_id long, own long, theirs long, s double, n double")
    means = parts.groupBy("sample_id", "own", "theirs").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).filter("n > 0").withColumn("m", F.col("s") / F.col("n"))
    ab = means.groupBy("sample_id").agg(F.max(F.when(F.col("own") == F.col("theirs"), F.col("m"))).alias("a"), F.min(F.when(F.col("own") != F.col("theirs"), F.col("m"))).alias("b"))
    score = F.when(F.greatest("a", "b") > 0, (F.col("b") - F.col("a")) / F.greatest("a", "b"))
    found = ab.select(F.col("sample_id").alias("__id"), F.when(F.col("a").isNotNull(), score).alias("score"))
    return df.select("sample_id").join(found, F.col("sample_id") == F.col("__id"), "left").select("sample_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def _distance_sums(metric: str):
    """The work of a tile for silhouette: for each row and cluster the sum of the distances to the cluster's rows with other ids, and their number."""
    far_of = NUMPY_METRICS[metric]

    def work(_, a, b):
        ordered = lambda side: [{c: x[c][order] for c in x} for x in side for order in [np.argsort(x["cluster_id"], kind="stable")]]
        a, b = ordered(a), b and ordered(b)
        sides = [a] if b is None else [a, b]
        held = {}
        for side, others in zip(sides, [a] if b is None else [b, a], strict=True):
            clusters = np.unique(np.concatenate([y["cluster_id"] for y in others]))
            for y in others:
                own, begin, many = np.unique(y["cluster_id"], return_index=True, return_counts=True)
                held[id(y), "cells"] = np.searchsorted(clusters, own), begin, many
            for x in side:
                held[id(x)] = clusters, np.zeros((len(x["vec"]), len(clusters))), np.zeros((len(x["vec"]), len(clusters)))
        for own, other, same in blocks.couples(a, b):
            far = far_of(own["vec"], other["vec"])
            alike = None
            if same or len(np.intersect1d(own["sample_id"], other["sample_id"])):
                alike = own["sample_id"][:, None] == other["sample_id"]
                far[alike] = 0.0
            for x, y, grid, equal in ((own, other, far, alike), (other, own, far.T, None if alike is None else alike.T))[: 1 if same else 2]:
                at, begin, many = held[id(y), "cells"]
                _, sums, counts = held[id(x)]
                sums[:, at] += np.add.reduceat(grid, begin, axis=1)
                counts[:, at] += many if equal is None else many - np.add.reduceat(equal.astype(np.int64), begin, axis=1)
        for side in sides:
            for x in side:
                clusters, sums, counts = held[id(x)]
                wide = len(clusters)
                arrays = [np.repeat(x["sample_id"], wide), np.repeat(x["cluster_id"], wide), np.tile(clusters, len(sums)), sums.ravel(), counts.ravel()]
                yield from blocks.batches(arrays, ["sample_id", "own", "theirs", "s", "n"])

    return work


def silhouette_by_means(df: DataFrame, assigned: DataFrame) -> DataFrame:
    """(sample_id, score): the silhouette under squared distance, in time linear in the rows.

    The mean squared distance to a cluster is |x|^2 - 2 x.m + q, with m the mean and q the mean squared norm of
    its members, so each row meets one summary per cluster. 0 where a row is alone in its cluster.
    """
    square = vec.dot(F.col("vec"), F.col("vec"))
    stats = assigned.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.avg(square).alias("q")).join(mean_vector(assigned, "cluster_id"), "cluster_id")
    table = stats.agg(F.array_sort(F.collect_list(F.struct("cluster_id", "n", "q", "vec"))).alias("_s"))  # a row per cluster
    rows = df.select("sample_id", "vec").join(assigned.select("sample_id", F.col("cluster_id").alias("own")), "sample_id").join(F.broadcast(table))
    far = lambda v, s: F.greatest(vec.dot(v, v) - 2 * vec.dot(v, s["vec"]) + s["q"], F.lit(0.0))
    dist = vec.bind(F.col("vec"), lambda v: F.transform("_s", lambda s: F.struct(s["cluster_id"].alias("c"), s["n"].alias("n"), far(v, s).alias("m"))))
    rows = rows.select("sample_id", "own", dist.alias("d"))
    own = F.element_at(F.filter("d", lambda e: e["c"] == F.col("own")), 1)
    other = F.array_min(F.transform(F.filter("d", lambda e: e["c"] != F.col("own")), lambda e: e["m"]))
    rows = rows.select("sample_id", F.when(own["n"] > 1, own["m"] * own["n"] / (own["n"] - 1)).alias("a"), other.alias("b"))
    score = F.when(F.greatest("a", "b") > 0, (F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return rows.select("sample_id", F.coalesce(score, F.lit(0.0)).alias("score"))


def mean_silhouette(scores: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(score): the mean of scores (sample_id, score), or the sum of weight times score over the number of rows."""
    if weights is None:
        return scores.agg(F.avg("score").alias("score"))
    both = scores.join(weights.select("sample_id", F.col("w").alias("__w")), "sample_id")
    return both.agg((F.sum(F.col("score") * F.col("__w")) / F.count(F.lit(1))).alias("score"))


def best_k(df: DataFrame, ks=range(5, 100, 5), metric: str = "abs_cos", max_iter: int = 200) -> DataFrame:
    """(k, score): the mean silhouette of a clustering for each k; the largest score names the count to take.

    All clusterings run at once, one job a step, and share their seeds: the first k of a farthest-first order are the
    order of k.
    """
    rows = _rows(df)
    seeds = [v for _, v in farthest_first_runs(rows, {0: max(ks)}, metric).get(0, [])]
    found = kmeans_runs(rows, {k: seeds[:k] for k in ks}, metric, max_iter=max_iter, every=True)
    shape, out = "cluster_id int, vec array<double>", None
    for k, centers in found.items():
        near = assign(rows.select("sample_id", "vec"), df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(centers.tolist())], shape), metric)
        one = mean_silhouette(silhouette_by_means(near, near)).select(F.lit(k).alias("k"), "score")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else df.sparkSession.createDataFrame([], "k int, score double")


def kmeans_fixed(df: DataFrame, k: int, iterations: int, metric: str = "l2", centers: DataFrame | None = None) -> DataFrame:
    """Centres after a fixed number of steps from the k rows with the smallest ids (or given ones); the centre of an empty cluster becomes 0."""
    rows = _rows(df)
    now = np.array([r["vec"] for r in (first_seeds(df, k) if centers is None else centers).orderBy("cluster_id").collect()])
    packed = _packed(rows)
    for _ in range(iterations if len(now) else 0):
        found = _step(packed, {0: now}, metric, False, False, False)[0]
        now = np.array([found[c][1] / found[c][0] if c in found else np.zeros(now.shape[1]) for c in range(len(now))])
    return df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(now.tolist())], "cluster_id int, vec array<double>")


def kernel_step(df: DataFrame, members: DataFrame, weight: str | None = None, kind: str = "dot") -> DataFrame:
    """df with cluster_id and dist: the cluster of members (cluster_id, vec) with the largest absolute mean product, or the least mean squared distance (l2)."""
    near = member_dist(df, members, weight, kind).groupBy("sample_id").agg(F.min(F.struct("dist", "cluster_id")).alias("_b"))
    return df.drop("cluster_id", "dist").join(near.select("sample_id", "_b.cluster_id", "_b.dist"), "sample_id")


def kernel_kmeans(df: DataFrame, k: int, tol: float = 1e-4, max_iter: int = 20, kind: str = "dot") -> DataFrame:
    """df with cluster_id and dist, clusters being sets of members rather than centres; ends when the mean distance moves less than tol."""
    now, last = first_seeds(df, k), None
    for _ in range(max_iter):
        now = cut(kernel_step(df, now, kind=kind))
        mean = now.agg(F.avg("dist")).first()[0]
        if mean is None or (last is not None and abs(last - mean) < tol):
            break
        last = mean
    return now


def spectral(df: DataFrame, k_eig: int, k: int, neighbours: int = 20, landmarks: int | None = None, sigma: float = 1.0, iterations: int = 10, seed: int = 0) -> DataFrame:
    """(sample_id, vec, cluster_id): k-means in the space of the normalised affinity's largest eigenvectors.

    The affinity is that of each row's nearest neighbours (operators.spectral), or, with landmarks, an approximation of
    the whole affinity by so many rows. iterations: of k-means.
    """
    placed = cut(_by_landmarks(df, k_eig, landmarks, sigma, seed)) if landmarks else eigenvectors(df, k_eig, neighbours, sigma, seed=seed)[0]
    centers = kmeans(placed, farthest_first(placed, k, "l2").select("cluster_id", "vec"), "l2", max_iter=iterations)
    return assign(placed, centers, "l2").select("sample_id", "vec", "cluster_id")


def _by_landmarks(df: DataFrame, k_eig: int, landmarks: int, sigma: float, seed: int) -> DataFrame:
    """(sample_id, vec): the eigenvectors from the affinity |cos| / sigma of all rows to a number of landmark rows, which stands for the square matrix (Nystrom).

    Degrees come from the landmarks' column sums, and only the landmarks' own square matrix, whose size is a
    parameter, is decomposed on the driver. The work is linear in the rows.
    """
    marks = random_seeds(df, landmarks, seed)
    table = centre_array(marks)
    similar = vec.bind(F.col("vec"), lambda v: F.transform("_centers", lambda c: (1 - vec.METRICS["abs_cos"](v, c["vec"])) / sigma))
    rows = cut(df.join(F.broadcast(table)).select("sample_id", similar.alias("w")))
    sums = np.array(mean_vector(rows.select(F.lit(1).alias("_k"), "w"), "_k", column="w").first()["vec"])
    share = F.array(*map(F.lit, (sums / max(sums.sum(), 1e-300)).tolist()))
    unit = rows.select("sample_id", F.transform("w", lambda x: x / F.sqrt(F.greatest(vec.dot(F.col("w"), share), F.lit(1e-12)))).alias("z"))
    cells = unit.select(F.posexplode("z").alias("i", "x"), "z").select("i", F.posexplode(F.transform("z", lambda y: y * F.col("x"))).alias("j", "p"))
    square = np.zeros((len(sums), len(sums)))
    for r in cells.groupBy("i", "j").agg(F.avg("p").alias("p")).collect():
        square[r["i"], r["j"]] = r["p"]
    values, vectors = np.linalg.eigh(square)
    top = np.argsort(values)[::-1][:k_eig]
    basis = vectors[:, top] / np.sqrt(np.maximum(values[top], 1e-12))
    basis *= np.where(basis[np.abs(basis).argmax(0), range(basis.shape[1])] < 0, -1, 1)
    axes = F.array(*(F.array(*map(F.lit, column.tolist())) for column in basis.T))
    return unit.select("sample_id", vec.bind(F.col("z"), lambda z: F.transform(axes, lambda a: vec.dot(z, a))).alias("vec"))


def mean_features(df: DataFrame, assigned: DataFrame) -> DataFrame:
    """(cluster_id, vec): the mean of the features of df over each cluster of an assignment."""
    return mean_vector(df.select("sample_id", "vec").join(assigned.select("sample_id", "cluster_id"), "sample_id"), "cluster_id")


def greedy_similarity(df: DataFrame, k: int) -> DataFrame:
    """(step, sample_id): each step adds the row that makes the mean absolute running similarity largest.

    The running similarity of row j is its product with the sum of the chosen rows, so a step compares every
    candidate's sum with every row: the square of the rows, once a step. Rows meet in tiles as matrix products and only a sum per row leaves a
    tile. Products are added up as whole numbers of 1e-9, so that their order doesn't matter. Null vectors take no part.
    """
    columns = {"sample_id": "i8"}
    rows = df.select(F.col("sample_id").cast("long").alias("sample_id"), "vec")
    packed, chosen, total = blocks.pack(rows, columns), [], None
    for _ in range(k):
        sums = blocks.tiles(packed, None, columns, _similarity_sums(total), "sample_id long, s double, n long")
        candidates = sums.filter(~F.col("sample_id").isin(chosen)) if chosen else sums
        mean = F.round(F.sum("s") / F.sum("n") / 1e9, 9)
        found = candidates.groupBy("sample_id").agg(mean.alias("m")).orderBy(F.col("m").desc(), "sample_id").first()
        if found is None:
            break
        own = np.array(rows.filter((F.col("sample_id") == found["sample_id"]) & F.col("vec").isNotNull()).first()["vec"])
        total = own if total is None else total + own
        chosen.append(found["sample_id"])
    return df.sparkSession.createDataFrame(list(enumerate(chosen, 1)), "step int, sample_id long")


def _similarity_sums(total: np.ndarray | None):
    """The work of a tile for greedy_similarity: for each row the sum, in 1e-9, of its absolute running similarities to the tile's other rows, and their number."""

    def work(_, a, b):
        width = max(a[0]["vec"].shape[1], 1)
        sides = [a] if b is None else [a, b]
        sums = {id(x): np.zeros(len(x["vec"])) for side in sides for x in side}
        more = {id(x): 0.0 if total is None else x["vec"] @ total / width for side in sides for x in side}
        for own, other, same in blocks.couples(a, b):
            product = own["vec"] @ other["vec"].T
            product /= width
            for x, y, grid in ((own, other, product),) if same else ((own, other, product), (other, own, product.T)):
                grid = grid + more[id(y)] if total is not None else grid.copy()
                np.abs(grid, out=grid)
                grid *= 1e9
                sums[id(x)] += np.rint(grid, out=grid).sum(1)
        for side, others in ((a, b or a),) if b is None else ((a, b), (b, a)):
            many = sum(len(y["vec"]) for y in others)
            for x in side:
                yield from blocks.batches([x["sample_id"], sums[id(x)], np.full(len(x["vec"]), many, np.int64)], ["sample_id", "s", "n"])

    return work
