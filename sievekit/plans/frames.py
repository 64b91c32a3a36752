"""The frames that the registered queries start from, and the same frames as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.functions import vec


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, label, vec: every embedding in doubles, of lengths 1 to 2, cut to multiples of 2**-16: sums of products are exact, in any order."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), "label", vec.as_double(F.col("embedding")).alias("vec"))
    by = 1 + (F.col("sample_id") % 5) / 4
    return e.withColumn("vec", F.transform("vec", lambda x: F.floor(x * by * 65536.0) / 65536.0))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vectors with logits: ten times the products with the mean vector of each label (a row per label, 64 numbers each)."""
    v = vectors(spark, sf_dir)
    cells = v.select("label", F.posexplode("vec").alias("i", "x")).groupBy("label", "i").agg(F.round(F.avg("x"), 9).alias("x"))
    means = cells.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"))
    one = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "m"))), lambda s: s["m"]).alias("_m"))
    return v.join(F.broadcast(one)).withColumn("logits", F.transform("_m", lambda m: F.round(10 * vec.dot(F.col("vec"), m), 6))).drop("_m")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id and label (0 to 4) of every event."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("sample_id"), (F.col("user_id") % 5).cast("int").alias("label"), "value", F.dayofyear("ts").alias("day"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, label, vec: the largest of four numbers of every order's lines by number (which repeat), in multiples of 2**-10; many rows for the same work."""
    top = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.max(c).alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
    x = F.array(F.col("l_quantity"), F.col("l_extendedprice") / 1000, F.col("l_discount") * 100, F.col("l_tax") * 100)
    own = top.select((F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("sample_id"), (F.col("l_linenumber") % 5).cast("int").alias("label"), x.alias("vec"))
    return own.withColumn("vec", F.transform("vec", lambda e: F.floor(e * 1024.0) / 1024.0))


SQL_LINES = """v AS (SELECT l_orderkey * 16 + l_linenumber AS sample_id, CAST(l_linenumber % 5 AS INTEGER) AS label, list_transform([max(l_quantity), max(l_extendedprice) / 1000, max(l_discount) * 100, max(l_tax) * 100], lambda e: floor(e * 1024) / 1024) AS vec FROM lineitem GROUP BY l_orderkey, l_linenumber)"""
SQL_VECTORS = """v AS (SELECT vec_id AS sample_id, label, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * (1 + (vec_id % 5) / 4) * 65536) / 65536) AS vec FROM embeddings)"""
SQL_LOGITS = (
    SQL_VECTORS
    + """, cells AS (SELECT label, i, round(avg(vec[i]), 9) AS x FROM v, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL),
means AS (SELECT label, list(x ORDER BY i) AS m FROM cells GROUP BY label),
one AS (SELECT list(m ORDER BY label) AS ms FROM means),
z AS (SELECT sample_id, label, vec, list_transform(ms, lambda m: round(10 * list_inner_product(vec, m), 6)) AS logits FROM v, one),
p AS (SELECT *, list_transform(logits, lambda x: exp(x - list_max(logits)) / list_sum(list_transform(logits, lambda y: exp(y - list_max(logits))))) AS probs,
      list_transform(logits, lambda x: x - list_max(logits) - ln(list_sum(list_transform(logits, lambda y: exp(y - list_max(logits)))))) AS logp FROM z)"""
)
SQL_LABELLED = """l AS (SELECT event_id AS sample_id, CAST(user_id % 5 AS INTEGER) AS label, value, dayofyear(ts) AS day FROM events)"""


def sql_ticket(seed: int, col: str = "sample_id") -> str:
    return f"md5('{seed}:' || CAST({col} AS VARCHAR))"


def sql_uniform(seed: int, col: str = "sample_id") -> str:
    return f"(CAST('0x' || substr({sql_ticket(seed, col)}, 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"
