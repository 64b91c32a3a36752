"""Subsets, splits and class balance. Rows are chosen by md5 tickets, so a seed means the same rows everywhere."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievekit.functions import chance, vec
from sievekit.operators import cluster, distance, ranks
from sievekit.sources import tables


def subset(df: DataFrame, ids: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Rows whose id is in ids, with labels of (sample_id, label) where given. Ids of labels that repeat take their smallest label, so that rows stay what they are."""
    out = df.join(ids.select("sample_id"), "sample_id", "left_semi")
    return out if labels is None else tables.overlay_labels(out, labels)


def split_train_meta(df: DataFrame, ids: DataFrame, include_meta: bool = False) -> DataFrame:
    """df with ``split``: chosen rows are meta and have the clean label; the others train, all where include_meta."""
    meta = df.join(ids.select("sample_id"), "sample_id", "left_semi").withColumn("label", F.col("clean_label"))
    train = df if include_meta else df.join(ids.select("sample_id"), "sample_id", "left_anti")
    return train.withColumn("split", F.lit("train")).unionByName(meta.withColumn("split", F.lit("meta")))


def holdout_count(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows by ticket: a top-n where they are few, else those up to the n-th ticket, found by counting."""
    return df.orderBy(*chance.order(seed)).limit(max(n, 0)) if n <= ranks.FEW else ranks.within_quota(df, F.lit(0), chance.keys(seed), {0: n}, span=chance.SPAN)


def holdout_rate(df: DataFrame, rate: float, seed: int = 0) -> DataFrame:
    return holdout_count(df, int(df.count() * rate), seed)


def _within_quota(df: DataFrame, quota: DataFrame, seed: int) -> DataFrame:
    """The first rows of each label by ticket, as many as quota (label, quota: a row per class) says."""
    return ranks.within_quota(df, F.col("label"), chance.keys(seed), {r["label"]: r["quota"] for r in quota.select("label", "quota").collect()}, span=chance.SPAN)


def holdout_by_class(df: DataFrame, n: int, seed: int = 0, equal: bool = False) -> DataFrame:
    """n rows in proportion to the classes (or int(n / classes) of each where equal), rounded down; the last class takes the remainder."""
    counts = df.groupBy("label").agg(F.count(F.lit(1)).alias("c"))
    every = Window.partitionBy()
    share = F.lit(n) / F.count(F.lit(1)).over(every) if equal else F.lit(n) * F.col("c") / F.sum("c").over(every)
    quota = counts.withColumn("quota", F.floor(share))
    last = F.col("label") == F.max("label").over(every)
    quota = quota.withColumn("quota", F.when(last, n - F.sum("quota").over(every) + F.col("quota")).otherwise(F.col("quota")))
    return _within_quota(df, quota.select("label", "quota"), seed)


def cap_per_class(df: DataFrame, n: int = 45, seed: int = 0) -> DataFrame:
    return _within_quota(df, df.select("label").distinct().withColumn("quota", F.lit(n)), seed)


def long_tail(df: DataFrame, factor: float, seed: int = 0) -> DataFrame:
    """The c-th class (from 0, in order of label) keeps int(smallest class * factor**(-c/(K-1))) rows, its own size at most."""
    counts = df.groupBy("label").agg(F.count(F.lit(1)).alias("c"))
    every = Window.partitionBy()
    place = F.row_number().over(Window.orderBy("label")) - 1
    share = F.pow(F.lit(float(factor)), -place / F.greatest(F.count(F.lit(1)).over(every) - 1, F.lit(1)))
    return _within_quota(df, counts.select("label", F.floor(F.min("c").over(every) * share).alias("quota")), seed)


def concat(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def sample_columns(df: DataFrame, c: int, width: int, seed: int = 0) -> DataFrame:
    """The same c features of every row, in their order; all where c reaches the width."""
    if c >= width:
        return df
    chosen = sorted(sorted(range(width), key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))[:c])
    return df.withColumn("vec", vec.take(F.col("vec"), chosen))


def sample_block_columns(df: DataFrame, c: int, widths: list[int], seed: int = 0) -> DataFrame:
    """As sample_columns for a column blocks: each block draws c of its own features, the same for every row."""
    parts = []
    for b, width in enumerate(widths):
        chosen = sorted(sorted(range(width), key=lambda i: (hashlib.md5(f"{seed}:{b}:{i}".encode()).hexdigest(), i))[:c]) if c < width else list(range(width))
        parts.append(vec.take(F.get("blocks", F.lit(b)), chosen))
    return df.withColumn("blocks", F.array(*parts))


def fill_random(df: DataFrame, selected: DataFrame, n: int, seed: int = 0) -> DataFrame:
    return holdout_count(df.join(selected.select("sample_id"), "sample_id", "left_anti"), n, seed)


def binarize_label(df: DataFrame, threshold: int = 2) -> DataFrame:
    return df.withColumn("label", (F.col("label") >= threshold).cast("int"))


def bootstrap(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n draws with replacement: the rows of df with ``draw`` (from 0). Each draw is a place in ticket order."""
    rows = chance.dense_index(df, seed, "__i")
    size = df.agg(F.count(F.lit(1)).alias("__n"))
    draws = df.sparkSession.range(n).withColumnRenamed("id", "draw").join(F.broadcast(size))
    draws = draws.withColumn("__i", F.floor(chance.uniform(seed + 1, "draw") * F.col("__n"))).drop("__n")
    return draws.join(rows, "__i").drop("__i")


# --- label corruption ------------------------------------------------------------------------------------------


def _chosen(df: DataFrame, rate: float, seed: int) -> DataFrame:
    """df with ``__hit``: the first int(n * rate) rows by ticket. Rows that repeat an id share its ticket, and are hit together where the last ticket is theirs."""
    return _hit(df, chance.keys(seed), int(df.count() * rate), chance.SPAN)


def _hit(df: DataFrame, keys: list, n: int, span: tuple[int, int] | None = None) -> DataFrame:
    """df with ``__hit`` where its keys are at most those of the n-th row in their order."""
    numbers = [k.cast("long").alias(f"k{i}") for i, k in enumerate(keys)]
    found = ranks.last_row(df.select(*numbers), len(keys), n, span=span)
    if found is None:
        return df.withColumn("__hit", F.lit(False))
    return df.withColumn("__hit", F.struct(*numbers) <= F.struct(*(F.lit(v).cast("long").alias(f"k{i}") for i, v in enumerate(found))))


def flip_random(df: DataFrame, rate: float, k: int, seed: int = 0, high: int | None = None) -> DataFrame:
    """Chosen rows get a uniform label below high (k - 1 by default, so the last class is never drawn)."""
    top = k - 1 if high is None else high
    new = F.floor(chance.uniform(seed + 1) * top).cast("int")
    return _chosen(df, rate, seed).withColumn("label", F.when(F.col("__hit"), new).otherwise(F.col("label"))).drop("__hit")


def flip_matrix(df: DataFrame, matrix: list[list[float]], seed: int = 0) -> DataFrame:
    """A new label from row label of the transition matrix."""
    rows = []
    for row in matrix:
        at, out = 0.0, []
        for p in row:
            at += p
            out.append(round(at, 12))
        rows.append(F.array(*map(F.lit, out)))
    cumulative = F.get(F.array(*rows), F.col("label"))
    below = F.size(F.filter(cumulative, lambda c: c <= chance.uniform(seed)))
    return df.withColumn("label", F.least(below, F.lit(len(matrix) - 1)).cast("int"))


def uniform_matrix(k: int, rate: float) -> list[list[float]]:
    return [[rate / k + (1 - rate) * (i == j) for j in range(k)] for i in range(k)]


def flip_other(df: DataFrame, rate: float, k: int, seed: int = 0) -> DataFrame:
    """Chosen rows get a uniform label that isn't their own."""
    new = F.pmod(F.col("label") + 1 + F.floor(chance.uniform(seed + 1) * (k - 1)), F.lit(k)).cast("int")
    return _chosen(df, rate, seed).withColumn("label", F.when(F.col("__hit"), new).otherwise(F.col("label"))).drop("__hit")


def flip_permute(df: DataFrame, rate: float, permutation: list[int], seed: int = 0) -> DataFrame:
    """Chosen rows get the label that one fixed permutation gives their own."""
    new = F.get(F.array(*map(F.lit, permutation)), F.col("label")).cast("int")
    return _chosen(df, rate, seed).withColumn("label", F.when(F.col("__hit"), new).otherwise(F.col("label"))).drop("__hit")


def flip_adversarial(df: DataFrame, scores: DataFrame, rate: float, k: int, seed: int = 0) -> DataFrame:
    """ceil(n * rate) rows get a uniform label below k - 1: first rows with a negative silhouette (sample_id, score), then others, each by ticket."""
    n = math.ceil(df.count() * rate)
    low = scores.groupBy("sample_id").agg(F.min("score").alias("__score")).select(F.col("sample_id").alias("__id"), "__score")
    tiered = df.join(low, F.col("sample_id") == F.col("__id"), "left").withColumn("__tier", (~(F.coalesce("__score", F.lit(0.0)) < 0)).cast("long")).drop("__id", "__score")
    new = F.floor(chance.uniform(seed + 1) * (k - 1)).cast("int")
    hit = _hit(tiered, [F.col("__tier"), *chance.keys(seed)], n)
    return hit.withColumn("label", F.when(F.col("__hit"), new).otherwise(F.col("label"))).drop("__hit", "__tier")


def corrupt(df: DataFrame, kind: str, rate: float, k: int, seed: int = 0, permutation: list[int] | None = None, clusters: int = 10, store: str | None = None) -> DataFrame:
    """df with corrupted labels: uniform, matrix, other, biased or adversarial (by the silhouettes of a clustering of vec).

    store: a folder for the labels. What it holds is used again, so that every run sees the same corruption.
    """
    saved = tables.load_splits(df.sparkSession, store)["clean_labels"] if store else None
    if saved is not None:
        return tables.overlay_labels(df, saved)
    if kind == "uniform":
        out = flip_random(df, rate, k, seed)
    elif kind == "matrix":
        out = flip_matrix(df, uniform_matrix(k, rate), seed)
    elif kind == "other":
        out = flip_other(df, rate, k, seed)
    elif kind == "biased":
        out = flip_permute(df, rate, permutation or [(i + 1) % k for i in range(k)], seed)
    elif kind == "adversarial":
        near = distance.assign(df, cluster.kmeans(df, cluster.farthest_first(df, clusters, "l2"), "l2"), "l2")
        out = flip_adversarial(df, cluster.silhouette_by_means(df, near), rate, k, seed)
    else:
        raise ValueError(f"unknown corruption {kind}")
    if store:
        tables.save_splits({"clean_labels": out.select("sample_id", "label")}, store)
        return tables.overlay_labels(df, tables.load_splits(df.sparkSession, store)["clean_labels"])
    return out
