"""The corpus pipeline: quality rules, near-dedup, substring dedup, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of ``documents`` (and any others that the input has).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from overhaul.llm import near_dedup, packing, quality, substring_dedup
from overhaul.llm.common import stage
from overhaul.llm.queries import table, vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose content lines hold half of their words."""
    crf = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, crf, rows=True).where("kept").select("row.*")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near duplicates; rows without a doc_id stay."""
    found = stage(near_dedup.near_duplicates(docs).select("doc_id", "kept"), "verdicts")
    gone = found.groupBy("doc_id").agg(F.max("kept").alias("kept")).where("NOT kept").select(F.col("doc_id").alias("gone_id"))
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone_id"], "left_anti")


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document; one with repeats keeps its other words, joined by one space (n_chars follows, if there)."""
    found = substring_dedup.deduplicate(docs, rows=True)
    cut = F.col("n_removed") > 0
    changed = {"text": F.when(cut, F.col("kept_text")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(cut, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return found.select(*(changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens, with their ids and a checksum of these."""
    return packing.pack(docs, vocabulary()).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality_rules", keep_quality),
    ("near_dedup", keep_one_of_each_group),
    ("substring_dedup", cut_repeated_passages),
    ("packing", pack_windows),
]

# The line model and the tokenizer cannot be expressed in SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
