"""Sample weights: start, step, normalise, follow; losses and corrections."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievekit.functions import chance, vec
from sievekit.operators import blocks, sums
from sievekit.sources.tables import cut

LEAST = 1e-7


def init_weights(df: DataFrame, how: str = "uniform", seed: int = 0, constant: float = 1.0, cached: DataFrame | None = None) -> DataFrame:
    """(sample_id, w): uniform, constant, or the positive part of a normal number, scaled to mean 1 (gaussian).

    cached (sample_id, w) goes before, where it has the row.
    """
    if how == "uniform":
        out = df.select("sample_id", chance.uniform(seed).alias("w"))
    elif how == "constant":
        out = df.select("sample_id", F.lit(constant).alias("w"))
    elif how == "gaussian":
        radius = F.sqrt(-2 * F.log(F.greatest(chance.uniform(seed), F.lit(2.0**-33))))
        draws = df.select("sample_id", F.greatest(radius * F.cos(2 * math.pi * chance.uniform(seed + 1)), F.lit(0.0)).alias("w"))
        mean = draws.agg(F.avg("w").alias("__m"))
        out = draws.join(F.broadcast(mean)).select("sample_id", F.when(F.col("__m") > 0, F.col("w") / F.col("__m")).otherwise(0.0).alias("w"))
    else:
        raise ValueError(f"unknown start {how}")
    if cached is None:
        return out
    return out.join(cached.select("sample_id", F.col("w").alias("__w")), "sample_id", "left").select("sample_id", F.coalesce("__w", "w").alias("w"))


def weight_deltas(snapshots: DataFrame) -> DataFrame:
    """(sample_id, epoch, delta, change): the change since the epoch before (0 at first) and its running sum."""
    order = Window.partitionBy("sample_id").orderBy("epoch")
    delta = F.coalesce(F.col("w") - F.lag("w").over(order), F.lit(0.0))
    return snapshots.withColumn("delta", delta).withColumn("change", F.sum("delta").over(order)).select("sample_id", "epoch", "delta", "change")


def normalize_weights(df: DataFrame, how: str, by: str = "batch", temperature: float = 1.0) -> DataFrame:
    """df with w normalised inside each batch: "sum" (negative to 0, over the sum, all 0 where that is at most 1e-8),
    "clip" (to [0, 1], over the number of rows), "softmax"."""
    batch, w = Window.partitionBy(by), F.col("w")
    if how == "sum":
        kept = F.greatest(w, F.lit(0.0))
        total = F.sum(kept).over(batch)
        return df.withColumn("w", F.when(total <= 1e-8, 0.0).otherwise(kept / total))
    if how == "clip":
        return df.withColumn("w", F.least(F.greatest(w, F.lit(0.0)), F.lit(1.0)) / F.count(F.lit(1)).over(batch))
    if how == "softmax":
        e = F.exp((w - F.max(w).over(batch)) / temperature)
        return df.withColumn("w", e / F.sum(e).over(batch))
    raise ValueError(f"unknown normaliser {how}")


def decayed_step(df: DataFrame, decay: float) -> DataFrame:
    return df.withColumn("w", F.greatest(F.col("w") / decay - F.col("grad"), F.lit(1e-5)))


def decayed_rate(meta_lr: float, epoch: int, milestones: tuple[int, ...] = (120,)) -> float:
    """The meta rate of an epoch: a tenth from each milestone on."""
    return meta_lr * 0.1 ** sum(epoch >= m for m in milestones)


def _mean_gradient(df: DataFrame, k: int, weight=None, name: str = "__g") -> DataFrame:
    """One row: the mean of (weight times) the head's gradient, features by classes, flattened. Each task adds up its rows' products as one matrix product a batch."""
    g = vec.ce_gradient(F.col("logits"), F.col("label"), k)
    rows = df.select(F.col("vec"), g.alias("g"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("w")).filter("vec IS NOT NULL AND g IS NOT NULL AND w IS NOT NULL")

    def add(batches):
        total, n = None, 0
        for b in batches:
            if b.num_rows:
                x, y, w = blocks.matrix(b.column(0)), blocks.matrix(b.column(1)), b.column(2).to_numpy()
                part = x.T @ (y * w[:, None])
                total, n = part if total is None else total + part, n + len(w)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["n", "x"])

    cells = rows.mapInArrow(add, "n long, x array<double>").select("n", F.posexplode("x").alias("i", "x"))
    means = cells.groupBy("i").agg((F.sum("x") / F.sum("n")).alias("x"))
    return means.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(name))


def meta_step(train: DataFrame, meta: DataFrame, k: int, lr: float, meta_lr: float, batch: int, momentum: float = 0.0, virtual: bool = True) -> DataFrame:
    """(sample_id, w): each training weight moves by the product of its gradient with the mean meta gradient.

    For a linear head on vec with logits the gradient is vec by (probabilities - one-hot). The meta gradient is taken
    after a virtual step: the head moves by lr times the weighted mean training gradient, and the meta rows' logits
    with it. With Nesterov momentum both steps count (1 + momentum) times. Both mean gradients are one small matrix
    (width by k) that travels to the rows. Weights end in [1e-7, 1].
    """
    factor = (1 + momentum) * lr
    if virtual:
        step = _mean_gradient(train, k, F.col("w"), "__step")
        row = lambda i: F.slice("__step", i * k + 1, k)
        moved = F.aggregate(F.sequence(F.lit(0), F.size("vec") - 1), F.col("logits"), lambda z, i: F.zip_with(z, row(i), lambda a, g: a - factor * F.get("vec", i) * g))
        meta = meta.join(F.broadcast(step)).select("vec", "label", moved.alias("logits"))
    product = vec.dot(vec.outer(F.col("vec"), vec.ce_gradient(F.col("logits"), F.col("label"), k)), F.col("__g"))
    moved = F.col("w") + meta_lr * (factor / batch) * product
    return train.join(F.broadcast(_mean_gradient(meta, k))).select("sample_id", F.least(F.greatest(moved, F.lit(LEAST)), F.lit(1.0)).alias("w"))


def sample_loss(df: DataFrame, kind: str, k: int, beta: float = 0.95) -> DataFrame:
    """(sample_id, loss)."""
    z, y = F.col("logits"), F.col("label")
    losses = {"ce": lambda: vec.cross_entropy(z, y), "l1": lambda: vec.l1_loss(z, y, k), "soft": lambda: vec.soft_bootstrap(z, y, beta), "hard": lambda: vec.hard_bootstrap(z, y, beta)}
    return df.select("sample_id", losses[kind]().alias("loss"))


def glc_matrix(meta: DataFrame) -> DataFrame:
    """(label, row): the mean output of the meta rows of each label."""
    cells = meta.select("label", F.posexplode("logits").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    return cells.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("row"))


def glc_loss(df: DataFrame, matrix: DataFrame) -> DataFrame:
    """(sample_id, loss): the cross-entropy of the outputs times the correction matrix (label, row), a row per class from 0."""
    table = matrix.agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "row"))), lambda s: s["row"]).alias("__c"))
    zero = F.transform(F.get("__c", F.lit(0)), lambda x: F.lit(0.0))
    product = F.aggregate(F.sequence(F.lit(0), F.size("__c") - 1), zero, lambda acc, i: F.zip_with(acc, F.get("__c", i), lambda a, c: a + F.get("logits", i) * c))
    return df.join(F.broadcast(table)).select("sample_id", vec.cross_entropy(product, F.col("label")).alias("loss"))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train_head(df: DataFrame, k: int, lr: float, epochs: int, weight: str | None = None, momentum: float = 0.0, start: list[float] | None = None, validation: DataFrame | None = None, batch: int | None = None, seed: int = 0) -> DataFrame:
    """(epoch, loss, accuracy, head): training of a softmax head on vec, from zero or from a head to fine-tune.

    A step takes all rows, or batch rows, which follow each other in an order by ticket that is another for each epoch (the last
    batch of an epoch may be smaller). Each task adds up the gradient of its rows, packed in matrices; k by d numbers come
    to the driver. Steps follow each other, so batches are worth a job each when they are large. The (weighted) gradient is
    divided by the number of rows; loss and accuracy are those before the epoch's first step, of the validation rows
    (label, vec) where there are some. momentum is Nesterov's. A head is its k rows one after the other. Rows without a vector or a label take no part.
    """
    width = df.select(F.max(F.size("vec"))).first()[0] or 0
    head = np.zeros(k * width) if start is None else np.array(start, float)
    if len(head) != k * width:
        raise ValueError(f"a head of {len(head)} numbers does not fit {k} classes of {width}")
    spark, speed, out = df.sparkSession, np.zeros(len(head)), []
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    columns = {"label": "i8", "w": "f8"}
    if batch and "sample_id" not in df.columns:
        raise ValueError("batches follow the order of sample_id, which df has not")
    own = F.col("sample_id") if "sample_id" in df.columns else F.monotonically_increasing_id()  # only deals rows to blocks
    rows = df.filter("vec IS NOT NULL AND label IS NOT NULL").select(own.alias("sample_id"), "vec", F.col("label").cast("long").alias("label"), w.alias("w"))
    rows = cut(rows) if batch else rows
    whole = blocks.pack(rows, columns)
    seen = whole if validation is None else blocks.pack(validation.filter("vec IS NOT NULL AND label IS NOT NULL").select(F.monotonically_increasing_id().alias("sample_id"), "vec", F.col("label").cast("long").alias("label"), F.lit(1.0).alias("w")), columns)

    def measured(packed: DataFrame) -> np.ndarray:
        """Rows, loss and hits summed, then the gradient, for the head as it is."""
        shared = spark.sparkContext.broadcast(head.reshape(k, width).copy())

        def of(batches):
            for b in batches:
                for row in b.select(["n", "vec", "label", "w"]).to_pylist():
                    own = blocks.unpack(row, columns)
                    z = own["vec"] @ shared.value.T
                    p, y, at = _softmax(z), own["label"], np.arange(len(z))
                    loss = -np.log(np.maximum(p[at, y], 1e-300)).sum()
                    hits = (z.argmax(axis=1) == y).sum()
                    p[at, y] -= 1
                    yield 0, np.concatenate([[len(z), loss, hits], ((p * own["w"][:, None]).T @ own["vec"]).ravel()])

        found = sums.collect(packed, of, 3 + len(head)).get(0, np.zeros(3 + len(head)))
        shared.destroy()
        return found

    for epoch in range(epochs):
        first = measured(seen)
        out.append((epoch, float(first[1] / first[0]) if first[0] else None, float(100 * first[2] / first[0]) if first[0] else 0.0, head.tolist()))
        if batch:
            placed = chance.dense_index(rows, seed + epoch, "__at").withColumn("batch", F.floor(F.col("__at") / batch)).drop("__at")
            packed = blocks.pack(placed, columns, ["batch"])
            steps = (packed.filter(F.col("batch") == b) for b in range(-(-rows.count() // batch)))
        else:
            steps = (whole,)
        for one in steps:
            found = first if one is seen else measured(one)
            if not found[0]:
                continue
            g = found[3:] / found[0]
            speed = momentum * speed + g
            head = head - lr * (g + momentum * speed)
    return spark.createDataFrame(out, "epoch int, loss double, accuracy double, head array<double>")


def train_stats(df: DataFrame) -> DataFrame:
    """(epoch, loss, accuracy in percent) from rows with epoch, logits and label."""
    right = (vec.argmax(F.col("logits")) == F.col("label")).cast("double")
    return df.groupBy("epoch").agg(F.avg(vec.cross_entropy(F.col("logits"), F.col("label"))).alias("loss"), (100 * F.avg(right)).alias("accuracy"))
