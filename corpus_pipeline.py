"""From raw documents to packed training sequences, stage by stage.

``run`` applies STAGES to ``documents``. Each stage reads the Parquet table that the one
before it wrote to the shared scratch folder, so a lost executor costs one stage at most.
All but the last return the columns of ``documents``.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import line_alignment, mixing, packing, quality, simhash
from tidewatch.llm.common import without
from tidewatch.session import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as bad go."""
    scored = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rejected = materialize(scored.where("predicted = 0").select("_id", "_hash").distinct(), "rejected")
    return without(docs, rejected)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document holds go; texts shrink, documents stay."""
    return line_alignment.dedup_lines(docs, n_chars="n_chars" if "n_chars" in docs.columns else None)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the SimHash operator (3-word shingles, 2 bits) stays: that with the smallest id."""
    return simhash.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.apply_mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, with their token ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("source_mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Alignment, fingerprints and token ids cannot be said in SQL; tests/llm tests the stages and their operators.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
