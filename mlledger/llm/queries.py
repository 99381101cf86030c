"""One query for each operator, over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mlledger.llm import (
    block_labeller,
    bpe_tree,
    chat_snapshots,
    decontamination,
    filter_audit,
    hilbert_search,
    kdtree_search,
    license_digest,
    line_crf,
    mixing,
    odd_sketch_dedup,
    shards,
    target_resampling,
)
from mlledger.llm.common import table


def op1_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op2_kdtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(
        "vec_id", kdtree_search.whole_numbers("embedding").alias("v")
    )
    return kdtree_search.top_k(vectors, F.col("vec_id") % 100 == 0, k=10)


def op3_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return hilbert_search.nearest(vectors, F.col("vec_id") % 50 == 0, k=5)


def op4_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_snapshots.format_chats(table(spark, sf_dir, "conversations"))


def op5_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(table(spark, sf_dir, "documents"), shards=8).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_odd_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_sketch_dedup.near_duplicates(
        table(spark, sf_dir, "documents"), words=3, percent=85
    )


def op7_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_labeller.extract_main_text(table(spark, sf_dir, "pages"))


def op8_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.score_documents(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7
    )


def op9_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.encode_documents(table(spark, sf_dir, "documents"))


def op10_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest.scan_licenses(table(spark, sf_dir, "documents"))


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_resampling.resample(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    ).select("doc_id", "n_features", "weight", "score", "rank")


def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated_documents(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


QUERIES = [
    op1_entropy_mix,
    op2_kdtree_topk,
    op3_hilbert_neighbours,
    op4_chat_snapshots,
    op5_lpt_shards,
    op6_odd_sketch_dedup,
    op7_block_labeller,
    op8_line_crf,
    op9_bpe_tree,
    op10_license_digests,
    op11_target_resampling,
    op12_benchmark_decontamination,
    op13_filter_audit,
]
