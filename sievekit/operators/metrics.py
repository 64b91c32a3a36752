"""Evaluation: loss and accuracy, kappa, ROC-AUC, neighbours, histories."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievekit.functions import vec
from sievekit.functions.arrays import NUMPY_METRICS
from sievekit.operators import blocks, nearest, ranks
from sievekit.operators.distance import centre_array


def evaluate(df: DataFrame) -> DataFrame:
    """n, mean loss, correct and accuracy in percent, from logits and labels."""
    right = (vec.argmax(F.col("logits")) == F.col("label")).cast("long")
    out = df.agg(F.count(F.lit(1)).alias("n"), F.avg(vec.cross_entropy(F.col("logits"), F.col("label"))).alias("loss"), F.sum(right).alias("correct"))
    return out.withColumn("accuracy", 100 * F.col("correct") / F.col("n"))


def evaluate_binary(df: DataFrame, output: str = "output", threshold: float = 0.5) -> DataFrame:
    """n, mean cross-entropy, correct and accuracy in percent where the output is one probability: 1 above the threshold."""
    y, p = F.col("label").cast("double"), F.least(F.greatest(F.col(output), F.lit(1e-12)), F.lit(1 - 1e-12))
    right = ((F.col(output) > threshold).cast("int") == F.col("label")).cast("long")
    out = df.agg(F.count(F.lit(1)).alias("n"), F.avg(-y * F.log(p) - (1 - y) * F.log(1 - p)).alias("loss"), F.sum(right).alias("correct"))
    return out.withColumn("accuracy", 100 * F.col("correct") / F.col("n"))


def confusion(df: DataFrame) -> DataFrame:
    return df.groupBy("label", F.col("predicted")).agg(F.count(F.lit(1)).alias("n"))


def quadratic_kappa(df: DataFrame) -> DataFrame:
    """1 less observed over expected squared disagreement, in one pass of sums: sum over pairs of (y - p)^2 needs only the moments. Null where none is expected (one class alone)."""
    y, p = F.col("label").cast("double"), F.col("predicted").cast("double")
    s = df.agg(F.count(F.lit(1)).alias("n"), F.sum((y - p) * (y - p)).alias("d"), F.sum(y).alias("y1"), F.sum(p).alias("p1"), F.sum(y * y).alias("y2"), F.sum(p * p).alias("p2"))
    expected = (F.col("n") * (F.col("y2") + F.col("p2")) - 2 * F.col("y1") * F.col("p1")) / F.nullif(F.col("n"), F.lit(0))
    return s.select((1 - F.try_divide(F.col("d"), expected)).alias("kappa"))


def roc_auc(df: DataFrame) -> DataFrame:
    """(label, auc) one against the rest, from (label, scores array); ties count half. Null for a class without rows, or with all of them.

    Equal scores are counted together first, and the running counts go over distinct scores of a class, which are sorted
    in ranges, so that no task has a whole class.
    """
    long = df.select("label", F.posexplode("scores").alias("cls", "score"))
    counted = long.groupBy("cls", "score").agg(F.sum((F.col("label") == F.col("cls")).cast("long")).alias("pos"), F.sum((F.col("label") != F.col("cls")).cast("long")).alias("neg"))
    counted = ranks.running_sum(counted, "cls", [F.col("score")], "neg", "under")
    out = counted.groupBy("cls").agg(F.try_divide(F.sum(F.col("pos") * (F.col("under") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("auc"))
    return out.select(F.col("cls").alias("label"), "auc")


def macro_auc(df: DataFrame) -> DataFrame:
    """(auc): the plain mean over the classes that have both rows of their own and others."""
    return roc_auc(df).agg(F.avg("auc").alias("auc"))


def topk_accuracy(df: DataFrame, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """(k, accuracy in percent): the true class is among the k largest logits (ties count for it)."""
    place = 1 + F.size(F.filter("logits", lambda z: z > F.get("logits", F.col("label"))))
    counts = df.agg(F.count(F.lit(1)).alias("n"), *(F.sum((place <= k).cast("long")).alias(f"_{k}") for k in ks))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), (100 * F.col(f"_{k}") / F.col("n")).alias("accuracy")) for k in ks))).alias("r")).select("r.*")


def _nearest(test: DataFrame, train: DataFrame, k: int, metric: str) -> DataFrame:
    """(sample_id, near_id, near_label, sim) of the k training rows with the largest similarity (ties: smaller id)."""
    near = nearest.nearest(test.select("sample_id", "vec"), train.select("sample_id", "vec"), k, metric)
    of = train.select(F.col("sample_id").alias("near_id"), F.col("label").alias("near_label"))
    return near.select("sample_id", "near_id", (-F.col("dist")).alias("sim")).join(of, "near_id")


def knn_votes(test: DataFrame, train: DataFrame, k: int, sigma: float, top: int = 1) -> DataFrame:
    """(sample_id, place, predicted, votes): the top classes by votes exp(sim / sigma) of the k rows with the largest cosines."""
    votes = _nearest(test, train, k, "neg_cos").groupBy("sample_id", F.col("near_label").alias("predicted")).agg(F.round(F.sum(F.exp(F.col("sim") / sigma)), 6).alias("votes"))
    return votes.withColumn("place", F.row_number().over(Window.partitionBy("sample_id").orderBy(F.desc("votes"), "predicted"))).filter(F.col("place") <= top)


def knn_vote(test: DataFrame, train: DataFrame, k: int, sigma: float) -> DataFrame:
    """(sample_id, predicted, votes): the class with most votes."""
    return knn_votes(test, train, k, sigma).select("sample_id", "predicted", "votes")


def knn_accuracy(test: DataFrame, train: DataFrame, k: int, sigma: float, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """(k, accuracy in percent): the test row's own class is among its first k by votes."""
    placed = test.select("sample_id", "label").join(knn_votes(test, train, k, sigma, max(ks)), "sample_id", "left")
    hit = placed.groupBy("sample_id").agg(F.min(F.when(F.col("predicted") == F.col("label"), F.col("place"))).alias("place"))
    share = hit.agg(*(F.avg((F.coalesce("place", F.lit(max(ks) + 1)) <= n).cast("double")).alias(f"a{n}") for n in ks))
    return share.select(F.explode(F.array(*(F.struct(F.lit(n).alias("k"), (100 * F.col(f"a{n}")).alias("accuracy")) for n in ks))).alias("r")).select("r.*")


def best_so_far(history: DataFrame, by: str = "run") -> DataFrame:
    """history (run, epoch, metric, loss) with the best metric up to each epoch (the latest of equals) and its epoch."""
    order = Window.partitionBy(by).orderBy("epoch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return history.withColumn("_b", F.max(F.struct("metric", "epoch")).over(order)).withColumn("best_metric", F.col("_b.metric")).withColumn("best_epoch", F.col("_b.epoch")).drop("_b")


def early_stop(history: DataFrame, tie: str = "last", by: str = "run", rule: str = "metric") -> DataFrame:
    """The epoch of the best validation metric of each run, or of the least loss (the last or the first of equals), and its test metric."""
    if tie not in ("last", "first") or rule not in ("metric", "loss"):
        raise ValueError(f"unknown rule {rule} or tie {tie}")
    best, sign = (F.col("metric") if rule == "metric" else -F.col("loss")), 1 if tie == "last" else -1
    found = history.groupBy(by).agg(F.max_by(F.struct("epoch", "test_metric"), F.struct(best, sign * F.col("epoch"))).alias("b"))
    return found.select(by, "b.epoch", "b.test_metric")


def distinct_labels(df: DataFrame, split: str = "split") -> DataFrame:
    """(split, labels): how many labels each split has."""
    return df.groupBy(split).agg(F.countDistinct("label").alias("labels"))


def class_shares(df: DataFrame, split: str = "split") -> DataFrame:
    counts = df.groupBy(split, "label").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(split)))


def running_average(df: DataFrame, by: str = "run") -> DataFrame:
    order = Window.partitionBy(by).orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("average", F.sum(F.col("value") * F.col("n")).over(order) / F.sum("n").over(order))


def nn_accuracy(test: DataFrame, train: DataFrame) -> DataFrame:
    """(n, accuracy in percent): the label of the training row with the largest product (ties: smaller id) against the own."""
    hits = test.select("sample_id", "label").join(_nearest(test, train, 1, "mean_dot"), "sample_id")
    return hits.agg(F.count(F.lit(1)).alias("n"), (100 * F.avg((F.col("label") == F.col("near_label")).cast("double"))).alias("accuracy"))


def d_value(cells: DataFrame) -> DataFrame:
    """(n, least, low): of D = (1 + r) / (1 - r) with r the absolute sum over the sum of absolutes of each sample's d, its minimum and 0.1 % quantile. Samples whose d are all zero have no D."""
    r = F.try_divide(F.abs(F.sum("d")), F.sum(F.abs("d")))
    per = cells.groupBy("sample_id").agg(r.alias("r")).filter("r < 1").select(((1 + F.col("r")) / (1 - F.col("r"))).alias("v"))
    return per.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.percentile("v", F.lit(0.001)).alias("low"))


def assign_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """(n, agree): rows with the same cluster_id in two assignments, as a share."""
    both = a.select("sample_id", "cluster_id").join(b.select("sample_id", F.col("cluster_id").alias("_o")), "sample_id")
    return both.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("cluster_id") == F.col("_o")).cast("double")).alias("agree"))


def cross_view(a: DataFrame, assigned_b: DataFrame, centers_b: DataFrame, t: float) -> DataFrame:
    """(sample_id, agree, loss): rows of view a against view b's centres: whether the largest product is their b cluster, and
    the cross-entropy of the products over t with it. Cluster ids count from 0."""
    table = centre_array(centers_b)
    z = vec.bind(F.col("vec"), lambda v: F.transform("_centers", lambda c: vec.dot(v, c["vec"]) / t))
    rows = a.select("sample_id", "vec").join(assigned_b.select("sample_id", "cluster_id"), "sample_id").join(F.broadcast(table)).withColumn("logits", z)
    return rows.select("sample_id", (vec.argmax(F.col("logits")) == F.col("cluster_id")).alias("agree"), vec.cross_entropy(F.col("logits"), F.col("cluster_id")).alias("loss"))


def weighted_similarity_bound(left: DataFrame, right: DataFrame) -> DataFrame:
    """(largest, largest_abs) over pairs of (g_i . g_j) times the absolute cosine of the vectors; right is a chosen set. Null without pairs.

    Rows meet in blocks as two matrix products, and each meeting passes on its extremes alone.
    """
    first = left.select(F.size("vec").alias("w")).first()
    wide = first["w"] if first else 0
    a, b = (blocks.pack(side.select("sample_id", F.concat("vec", "g").alias("vec")), {"sample_id": "i8"}) for side in (left, right))

    def step(_, own, other):
        x, y = own["vec"], other["vec"]
        value = (x[:, wide:] @ y[:, wide:].T) * (1 - NUMPY_METRICS["abs_cos"](x[:, :wide], y[:, :wide]))
        yield from blocks.batches([np.array([value.max()]), np.array([np.abs(value).max()])], ["largest", "largest_abs"])

    met = blocks.meet(a, b, {"sample_id": "i8"}, lambda: None, step, "largest double, largest_abs double")
    return met.agg(F.max("largest").alias("largest"), F.max("largest_abs").alias("largest_abs"))
