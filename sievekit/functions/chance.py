"""Reproducible chance: ranks and uniform numbers from md5, the same in any engine and any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ticket(seed: int, sample_id="sample_id") -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(sample_id).cast("string")))


def uniform(seed: int, sample_id="sample_id") -> Column:
    return F.conv(F.substring(ticket(seed, sample_id), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def order(seed: int, sample_id="sample_id") -> list[Column]:
    return [ticket(seed, sample_id), F.col(sample_id)]


#: What the first of keys lies in.
SPAN = (0, (1 << 60) - 1)


def keys(seed: int, sample_id="sample_id") -> list[Column]:
    """Whole numbers that put rows in the order of their tickets, then ids; a null id comes first."""
    part = lambda at, n: F.conv(F.substring(ticket(seed, sample_id), at, n), 16, 10).cast("long")
    return [part(1, 15), part(16, 15), part(31, 2), F.coalesce(F.col(sample_id).cast("long"), F.lit(-(1 << 63)))]


def dense_index(df: DataFrame, seed: int = 0, name: str = "index") -> DataFrame:
    """df with its place (from 0) in ticket order.

    Rows are numbered inside the 4096 groups of their ticket's first three digits; the groups' offsets are a
    running sum over those 4096 counts, so no window sees all rows.
    """
    lead = df.withColumn("__t", ticket(seed)).withColumn("__g", F.substring("__t", 1, 3))
    counts = lead.groupBy("__g").agg(F.count(F.lit(1)).alias("__c"))
    offsets = counts.select("__g", (F.sum("__c").over(Window.orderBy("__g")) - F.col("__c")).alias("__o"))
    placed = lead.withColumn("__k", F.row_number().over(Window.partitionBy("__g").orderBy("__t", "sample_id")))
    return placed.join(F.broadcast(offsets), "__g").withColumn(name, F.col("__o") + F.col("__k") - 1).drop("__t", "__g", "__k", "__o")
