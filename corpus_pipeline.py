"""A training-corpus pipeline: each stage takes the documents that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.llm import bpe, mixing, near_copies, quality_classifier, quality_rules
from sievekit.llm.common import drop, materialize, scratch, table
from sievekit.llm.queries import tokenizer_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier takes for good."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def passing_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, from hosts that do."""
    return quality_rules.keep_passing(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by SimHash with BK-trees over five-word shingles and MinHash for pairs beyond its radius, all held to similarity 0.8 (op6's query has its own contract)."""
    return near_copies.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a null or empty text has size 0 and is taken at most twice; rows alike are rounded one by one; a null source is a source."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and the token ids (packed little-endian unsigned 32-bit) of each document of the mix. A null text counts as empty: no ids."""
    coded = bpe.encode(docs.select("doc_id", "source", "text"), tokenizer_path(), ["doc_id", "source"])
    return coded.select("row.doc_id", "row.source", "n_tokens", F.col("token_ids"))


STAGES = [("quality_classifier", good_quality), ("quality_rules", passing_rules), ("simhash_dedup", one_of_each), ("mixing", mixed), ("bpe", tokens)]

#: The first stage is a trained model, so SQL can't express the rows; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet in the shared folder and read again as the next one's documents."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as used:  # what the stage wrote on its way goes, and then what it read
            docs = used.keep(materialize(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        if before is not None:
            drop(spark, before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
