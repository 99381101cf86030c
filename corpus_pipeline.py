"""From raw documents to tokens: quality filter, near-dedup, source mix, byte-level BPE.

Each stage reads what the one before kept; run() writes every stage's rows to the shared folder and
reads them back.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from mlledger.llm import bpe_tree, line_crf, mixing, odd_sketch_dedup  # noqa: E402
from mlledger.llm.common import stored, table  # noqa: E402

#: Documents that score below this go.
LEAST_QUALITY = 0.7
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines a conditional random field finds good, with all their columns. Where no
    document is labelled nothing can be learnt, and all documents stay."""
    field = line_crf.fit(docs, table(spark, sf_dir, "labels"))
    if field is None:
        return docs
    return docs.filter(line_crf.quality_score(F.col("text"), field) >= LEAST_QUALITY)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, with all its columns."""
    return odd_sketch_dedup.kept_only(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the entropy-balanced mix takes them, with all their columns."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document."""
    return bpe_tree.encode_documents(docs)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("tokens", tokens),
]

#: SQL can express neither the classifier, nor the Newton steps, nor BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
