"""Weights by epoch, promotion, bucketed checkpoints, mini-batch training."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievekit.functions import chance
from sievekit.operators import represent, reweight
from sievekit.sources import tables


def weights(spark, w, n=5):
    return spark.range(n).select(F.col("id").alias("sample_id"), F.lit(float(w)).alias("w"))


def test_epochs_are_overwritten_alone(spark, tmp_path):
    at, best = f"{tmp_path}/w", f"{tmp_path}/best"
    assert tables.saved_epochs(spark, at) == []
    with pytest.raises(ValueError, match="no weights"):
        tables.load_weights(spark, at)
    for epoch in (0, 2, 10):
        tables.save_weights(weights(spark, epoch), at, epoch)
    # from itself
    tables.save_weights(tables.load_weights(spark, at, 10).withColumn("w", F.col("w") + 1), at, 2)
    assert tables.saved_epochs(spark, at) == [0, 2, 10]
    got = {r.epoch: r.w for r in spark.read.parquet(at).groupBy("epoch").agg(F.max("w").alias("w"), F.count("w")).collect()}
    assert got == {0: 0.0, 2: 11.0, 10: 10.0} and tables.load_weights(spark, at).first().epoch == 10
    for epoch, want in ((0, 0.0), (2, 11.0)):
        tables.promote_weights(spark, at, epoch, best)
        assert {r.w for r in spark.read.parquet(best).collect()} == {want} and sorted(os.listdir(tmp_path)) == ["best", "w"]


def test_bucketed_checkpoints_meet_without_a_shuffle(spark, tmp_path):
    rows = {0: range(0, 40), 20: range(10, 50), 40: range(20, 30)}
    frames = []
    for epoch, ids in rows.items():
        df = spark.createDataFrame([(i, [float(i), float(epoch)]) for i in ids], "sample_id long, vec array<double>")
        tables.save_bucketed(df, f"checkpoint_{epoch}", f"{tmp_path}/{epoch}", 4)
        frames.append(spark.table(f"checkpoint_{epoch}"))
    tables.save_bucketed(spark.range(60).select(F.col("id").alias("sample_id"), F.array().cast("array<double>").alias("vec")), "checkpoint_all", f"{tmp_path}/all", 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = represent.stack_tables(spark.table("checkpoint_all"), frames)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {r.sample_id: [b[1] for b in r.blocks] for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for epoch in (*rows, "all"):
            spark.sql(f"DROP TABLE checkpoint_{epoch}")
    assert "SortMergeJoin" in plan and "Exchange" not in plan, plan
    assert got == {i: [float(e) for e, ids in rows.items() if i in ids] for i in range(50)}


@pytest.mark.parametrize("batch", [None, 7, 64])
def test_training_equals_a_plain_run(spark, batch):
    rng, k, lr, momentum = np.random.default_rng(2), 3, 0.3, 0.5
    x, y, w = rng.normal(size=(50, 4)), rng.integers(0, k, 50), rng.random(50)
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i]), float(w[i])) for i in range(50)] + [(99, None, 1, 1.0), (98, [0.0] * 4, None, 1.0)], "sample_id long, vec array<double>, label int, w double")
    got = reweight.train_head(df, k, lr, 3, "w", momentum, batch=batch, seed=4).collect()
    head, speed = np.zeros((k, 4)), np.zeros((k, 4))
    for epoch in range(3):
        z = x @ head.T
        p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        assert got[epoch].loss == pytest.approx(-np.log(p[np.arange(50), y]).mean()) and got[epoch].accuracy == pytest.approx(100 * (z.argmax(1) == y).mean())
        assert got[epoch].head == pytest.approx(head.ravel().tolist(), abs=1e-9)
        placed = {r.sample_id: r.at for r in chance.dense_index(df.filter("sample_id < 90").select("sample_id"), 4 + epoch, "at").collect()}
        order = sorted(range(50), key=placed.get)
        for own in [order[i : i + batch] for i in range(0, 50, batch)] if batch else [order]:
            z = x[own] @ head.T
            g = np.exp(z) / np.exp(z).sum(1, keepdims=True)
            g[np.arange(len(own)), y[own]] -= 1
            g = (g * w[own][:, None]).T @ x[own] / len(own)
            speed = momentum * speed + g
            head = head - lr * (g + momentum * speed)
