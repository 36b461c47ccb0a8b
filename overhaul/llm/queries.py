"""One registered query for each operator, over its whole table, and oracle SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from overhaul.llm import (
    bpe, bpe_sql, chat, html_text, licenses, merkle, near_dedup, packing, prefix_trie, quality, search, substring_dedup, urls,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """Place of the public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), vocabulary()), vocabulary())
    return tokens.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op4_bm25_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    queries = docs.where(F.col("doc_id") % 20 == 0).select(F.col("doc_id").alias("query_id"), "text")
    return search.search(docs, queries)


def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = chat.calls_from_turns(table(spark, sf_dir, "conversations"))
    return chat.link(calls, results, chat.SCHEMAS).withColumn("errors", F.concat_ws("; ", "errors"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_pages(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset", "sequence_length")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations")).drop("id", "parent_id")


def op12_bpe_by_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    tokens = bpe_sql.decode(bpe_sql.encode(table(spark, sf_dir, "documents"), ranks, pattern), ranks, pattern)
    return tokens.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    proven = merkle.prove(merkle.with_leaves(table(spark, sf_dir, "documents")), "source", ["doc_id"])
    return proven.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest().alias("proof_sha256"), merkle.fold("held").alias("folded_root"),
    ).withColumn("verified", F.expr("folded_root = root"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_bpe_round_trip": op2_bpe_round_trip,
    "op3_html_text": op3_html_text,
    "op4_bm25_top10": op4_bm25_top10,
    "op5_line_quality": op5_line_quality,
    "op6_tool_calls": op6_tool_calls,
    "op7_near_dedup": op7_near_dedup,
    "op8_url_filter": op8_url_filter,
    "op9_license_scan": op9_license_scan,
    "op10_pack_windows": op10_pack_windows,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_bpe_by_queries": op12_bpe_by_queries,
    "op13_merkle_manifest": op13_merkle_manifest,
}
# The others cannot be expressed in SQL; tests/llm holds brute-force versions of them.
ORACLES = {
    "op1_substring_dedup": substring_dedup.ORACLE,
    "op4_bm25_top10": search.ORACLE,
    "op7_near_dedup": near_dedup.ORACLE,
    "op9_license_scan": licenses.oracle(),
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op13_merkle_manifest": merkle.ORACLE,
}
