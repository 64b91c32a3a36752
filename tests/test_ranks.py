"""The first rows of each class by counting, against a sort."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievekit.functions import chance
from sievekit.operators import ranks, splits


def rows(kind):
    rng = random.Random(kind)
    draw = {"wide": lambda: rng.randint(-(2**63), 2**63 - 1), "plateau": lambda: rng.choice([7, 7, 7, 8, 2**62, -5]), "close": lambda: 2**61 + rng.randrange(9), "skewed": lambda: int(2 ** rng.uniform(0, 62))}[kind]
    return [(rng.choice([None, 1, 1, 1, 2]), draw(), rng.randrange(40), i) for i in range(3000)] + [(9, 5, 5, -1)]


@pytest.mark.parametrize("kind", ["wide", "plateau", "close", "skewed"])
@pytest.mark.parametrize("boundary", [0, 50, 10_000])
def test_quota_equals_a_sort(spark, kind, boundary):
    data = rows(kind)
    df = spark.createDataFrame(data, "c int, a long, b long, i long").repartition(4).cache()
    quota = {None: 100, 1: 1234, 2: 10**9, 9: 0, 77: 5}
    got = [tuple(r) for r in ranks.within_quota(df, F.col("c"), [F.col("a"), F.col("b")], quota, boundary).collect()]
    assert len(set(got)) == len(got) and set(got) <= set(data)
    for c, n in quota.items():
        own = sorted((a, b) for k, a, b, _ in data if k == c)[:n]
        assert sorted((a, b) for k, a, b, _ in got if k == c) == own


def test_holdout_by_counting_is_the_holdout_by_sorting(spark, monkeypatch):
    df = spark.range(500).withColumnRenamed("id", "sample_id").withColumn("label", F.col("sample_id") % 3)
    few = {r.sample_id for r in splits.holdout_count(df, 77, 5).collect()}
    monkeypatch.setattr(ranks, "FEW", 10)
    assert {r.sample_id for r in splits.holdout_count(df, 77, 5).collect()} == few and len(few) == 77
    nothing = df.limit(0)
    assert splits.holdout_count(nothing, 77).count() == 0 and splits.cap_per_class(nothing).count() == 0 and splits.flip_random(nothing, 0.5, 3).count() == 0


def test_repeated_ids_and_clashing_columns(spark):
    """Rows stay as many as they were, whatever repeats and whatever columns are called."""
    odd = ["_hit", "__r", "_new", "_tier", "_p", "_i", "_n", "_t", "_g", "_k", "_o", "_c", "k0", "by", "key"]
    base = spark.range(40).select((F.col("id") % 20).alias("sample_id"), (F.col("id") % 4).cast("int").alias("label"), (F.col("id") % 3).cast("int").alias("clean_label"))
    df = base.select("*", *(F.lit("x").alias(c) for c in odd))
    twice = df.select("sample_id", F.lit(3).alias("label")).limit(7)
    scores = df.select("sample_id", F.lit(-1.0).alias("score"))
    outs = {
        "flip_random": splits.flip_random(df, 0.3, 4),
        "flip_other": splits.flip_other(df, 0.3, 4),
        "flip_permute": splits.flip_permute(df, 0.3, [1, 2, 3, 0]),
        "flip_adversarial": splits.flip_adversarial(df, scores, 0.3, 4),
        "flip_matrix": splits.flip_matrix(df, splits.uniform_matrix(4, 0.2)),
        "subset": splits.subset(df, df, twice.unionByName(twice)),
        "index": chance.dense_index(df),
    }
    for name, out in outs.items():
        got = Counter(r.sample_id for r in out.collect())
        assert got == Counter({i: 2 for i in range(20)}), name
        assert set(df.columns) <= set(out.columns), name
    changed = {r.sample_id for r in outs["flip_other"].join(df.select("sample_id", F.col("label").alias("was")).distinct(), "sample_id").filter("label <> was").collect()}
    assert changed and splits.bootstrap(df, 30).count() == 30
    assert splits.cap_per_class(df, 3).groupBy("label").count().filter("count <> 3").count() == 0
