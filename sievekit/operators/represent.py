"""Representations built from vectors, logits and checkpoints, and sums over pairs of them."""

from __future__ import annotations

import hashlib

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievekit.functions import chance, vec


def mean_vector(df: DataFrame, *keys: str, column: str = "vec") -> DataFrame:
    """(keys, vec): the mean of each group; partial sums per cell come before the shuffle."""
    cells = df.select(*keys, F.posexplode(column).alias("_i", "_x")).groupBy(*keys, "_i").agg(F.avg("_x").alias("_x"))
    return cells.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias("vec"))


def batch_mean(df: DataFrame, batch: int, seed: int = 0) -> DataFrame:
    """(batch, vec): the mean of each mini-batch, batches being consecutive rows in ticket order."""
    return mean_vector(chance.dense_index(df, seed, "_p").withColumn("batch", F.floor(F.col("_p") / batch)), "batch")


def gradient(df: DataFrame, k: int, linear_layer: bool = False, full_loss: bool = False) -> DataFrame:
    """df with vec replaced by the gradient of a linear head: by the logits, and by its weights where linear_layer.

    full_loss: the loss with the logit of the own class added back, whose gradient is the probabilities. Rows
    without a label take the predicted one.
    """
    z = F.col("logits")
    known = F.coalesce(F.col("label"), vec.argmax(z))
    g0 = vec.softmax(z) if full_loss else vec.ce_gradient(z, known, k)
    return df.withColumn("vec", vec.bind(g0, lambda g: F.concat(g, vec.outer(g, F.col("vec")))) if linear_layer else g0)


def block_probabilities(df: DataFrame, blocks: str = "blocks") -> DataFrame:
    """(block, prob): mean squared norm of each block over its width, as shares of the sum; equal shares where all are zero."""
    squares = df.select(F.posexplode(blocks).alias("block", "_b")).select("block", (vec.dot(F.col("_b"), F.col("_b")) / F.size("_b")).alias("s"))
    means = squares.groupBy("block").agg(F.avg("s").alias("s"))
    whole = means.agg(F.sum("s").alias("_t"), F.count(F.lit(1)).alias("_n"))
    return means.join(F.broadcast(whole)).select("block", F.coalesce(F.try_divide("s", "_t"), 1 / F.col("_n")).alias("prob"))


def sample_blocks(df: DataFrame, m: int = 5, seed: int = 0, blocks: str = "blocks") -> DataFrame:
    """df with m blocks drawn with replacement by their importance, each over the root of its probability.

    Only the probabilities, a number per block, come to the driver.
    """
    probs = sorted((r["block"], r["prob"]) for r in block_probabilities(df, blocks).collect())
    drawn = []
    for i in range(m if probs else 0):
        u, at, last = int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:8], 16) / (1 << 32), 0.0, probs[-1]
        for block, p in probs:
            at += p
            if u < at:
                last = (block, p)
                break
        drawn.append(last)
    parts = [vec.scale(F.get(blocks, F.lit(b)), F.lit(p**-0.5 if p > 0 else 0.0)) for b, p in drawn]
    return df.withColumn(blocks, F.array(*parts)) if parts else df


def stack_checkpoints(df: DataFrame, start: int, period: int, most: int = 5) -> DataFrame:
    """(sample_id, blocks): the vectors of epochs start, start + period, ... in order; epochs that are missing are passed over."""
    wanted = df.filter(F.col("epoch").isin([start + i * period for i in range(most)]))
    return wanted.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("epoch", "vec"))), lambda s: s["vec"]).alias("blocks"))


def stack_tables(samples: DataFrame, checkpoints: list[DataFrame], most: int = 5) -> DataFrame:
    """(sample_id, blocks): the vectors (sample_id, vec, an id once) of up to five checkpoints in their order, for each of the samples that one has; a row that one misses has a block less.

    Tables that are bucketed by id in the same number (tables.save_bucketed) are merged where they lie.
    """
    out, columns = samples.select("sample_id"), []
    for i, one in enumerate(checkpoints[:most]):
        columns.append(f"__v{i}")
        out = out.join(one.select("sample_id", F.col("vec").alias(columns[-1])), "sample_id", "left")
    return out.select("sample_id", F.filter(F.array(*columns), lambda b: b.isNotNull()).alias("blocks")).filter(F.size("blocks") > 0)


def mean_passes(df: DataFrame) -> DataFrame:
    """(sample_id, probs, predicted): class probabilities averaged over stochastic passes (a row per sample and pass)."""
    probs = mean_vector(df.select("sample_id", vec.softmax(F.col("logits")).alias("vec")), "sample_id")
    return probs.select("sample_id", F.col("vec").alias("probs"), vec.argmax(F.transform("vec", lambda x: F.round(x, 9))).alias("predicted"))


def grad_product(train: DataFrame, meta: DataFrame) -> DataFrame:
    """(sample_id, product): each meta row's mean product with the training rows, which is its product with their mean."""
    mean = mean_vector(train.select(F.lit(1).alias("_k"), "vec"), "_k").select(F.col("vec").alias("_m"))
    return meta.join(F.broadcast(mean)).select("sample_id", vec.dot(F.col("vec"), F.col("_m")).alias("product"))


def predict(df: DataFrame, make_model, column: str = "vec", batch: int = 1024) -> DataFrame:
    """df with logits from a user's model: make_model() runs once a worker and gives a function from a matrix of rows to one of outputs."""
    width = df.select(F.max(F.size(column))).first()[0]
    if width is None:
        return df.withColumn("logits", F.array().cast("array<double>"))
    udf = predict_batch_udf(make_model, return_type=T.ArrayType(T.DoubleType()), batch_size=batch, input_tensor_shapes=[[width]])
    return df.withColumn("logits", udf(F.col(column)))
