"""Contiguous shards of nearly equal bytes, in DataFrame functions only.

Documents have one global order (by a hash of the text, then id, so that equal texts are neighbours). They are
dealt into cells that are ranges of this order; the cells' totals give a prefix sum, each cell adds its own,
and the order is cut where the bytes reach equal targets. Equal texts with many rows have cells of their own, as
many as they need, so that no task has all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievekit.llm.common import join_per_key, materialize


@dataclass(frozen=True)
class Params:
    """overhead: bytes that each document costs besides its text; cell_rows: rows of a cell, about; whole: a group of equal
    texts is kept in one shard if it has at most this part of a shard's bytes, however many rows that are."""

    shards: int = 24
    overhead: int = 8
    cell_rows: int = 20_000
    whole: float = 0.05


def _group(text: Column) -> Column:
    """A null text is its own group."""
    return F.xxhash64(text.isNull(), F.coalesce(text, F.lit("")))


def sized(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """uid (of the row), doc_id, size, text_crc32 and the group of each document. A null text has no bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    uid = F.col("_uid") if "_uid" in docs.columns else F.monotonically_increasing_id()
    return docs.select(uid.alias("uid"), F.col("doc_id"), (F.octet_length(text) + params.overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), _group(F.col("text")).alias("grp"))


def place(rows: DataFrame, params: Params = Params()) -> DataFrame:
    """rows (a written table of sized documents) with shard and slot."""
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).first()
    n, total = sums["n"], sums["bytes"] or 1
    cells = max(32, -(-n // params.cell_rows))
    # groups above cell_rows: at most n / cell_rows of them
    hot = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("in_group"), F.sum("size").alias("group_bytes")).filter(F.col("in_group") > params.cell_rows)
    hot = materialize(hot.select(F.col("grp").alias("of"), F.ceil(F.col("in_group") / params.cell_rows).cast("long").alias("parts"), "group_bytes"), "shard-hot")
    rows = join_per_key(rows, F.col("grp"), hot, "of", [F.col("uid")])
    rows = rows.withColumn("range", F.floor((F.col("grp") / F.lit(2.0**64) + 0.5) * cells).cast("long"))
    rows = rows.withColumn("hot", F.col("of").isNotNull().cast("int")).withColumn("of", F.coalesce("of", F.lit(0)))
    rows = rows.withColumn("part", F.coalesce(F.pmod(F.xxhash64("uid"), F.col("parts")), F.lit(0))).drop("parts")
    cell = ["range", "hot", "of", "part"]
    totals = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("cell_n"), F.sum("size").alias("cell_bytes"))
    before = Window.orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)  # over the cells, a row for each cell_rows documents
    totals = totals.select(*cell, F.coalesce(F.sum("cell_n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("cell_bytes").over(before), F.lit(0)).alias("b0"))
    totals = materialize(totals.withColumn("first_b0", F.min("b0").over(Window.partitionBy("range", "hot", "of"))), "shard-cells")
    within = Window.partitionBy(*cell).orderBy("grp", "doc_id", "size", "text_crc32", "uid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    one = Window.partitionBy(*cell, "grp")
    rows = rows.withColumn("i", F.row_number().over(within) - 1).withColumn("b", F.sum("size").over(within) - F.col("size"))
    rows = rows.withColumn("g0", F.min("b").over(one)).withColumn("g", F.sum("size").over(one))
    rows = rows.join(totals, cell)
    # where the row's group begins in the order, and its bytes; a group with cells of its own begins with the first of them
    group_at = F.when(F.col("hot") == 1, F.col("first_b0")).otherwise(F.col("b0") + F.col("g0"))
    group_bytes = F.when(F.col("hot") == 1, F.col("group_bytes")).otherwise(F.col("g"))
    middle = F.when(group_bytes <= params.whole * total / params.shards, group_at + group_bytes / 2).otherwise(F.col("b0") + F.col("b") + F.col("size") / 2)
    shard = F.least(F.floor(middle * params.shards / float(total)), F.lit(params.shards - 1)).cast("int")
    placed = materialize(rows.select("uid", "doc_id", "size", "text_crc32", "grp", shard.alias("shard"), (F.col("n0") + F.col("i")).alias("at")), "shard-rows")
    starts = placed.groupBy("shard").agg(F.min("at").alias("start"))  # a row per shard
    return placed.join(F.broadcast(starts), "shard").select("uid", "doc_id", "size", "text_crc32", "grp", "shard", (F.col("at") - F.col("start")).cast("long").alias("slot"))


def assign(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, size, text_crc32, grp, shard and slot, one row per document.

    Sizes of shards differ from the mean by less than the largest document or whole group. Shards may be empty
    where there are fewer documents than shards or one document outweighs several. slot counts from 0 in each
    shard, in the global order; rows alike in everything are interchangeable. Null ids come first among equal texts.
    """
    return place(materialize(sized(docs, params), "shard-sizes"), params).drop("uid")


def write_shards(docs: DataFrame, path: str, params: Params = Params()) -> None:
    """Write the documents as one folder per shard, each file a stretch of its slots; columns _shard and _slot are new."""
    numbered = materialize(docs.withColumn("_uid", F.monotonically_increasing_id()), "shard-documents")
    where = place(materialize(sized(numbered, params), "shard-sizes"), params).select(F.col("uid").alias("_uid"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    out = numbered.join(where, "_uid").drop("_uid")
    out.repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").parquet(path)
