"""The corpus pipeline: each stage works on all that its predecessor kept.

quality classifier -> toxicity -> n-gram Jaccard join -> mixing to target weights ->
byte-level BPE.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import bpe, jaccard, mixing, quality, toxicity
from ridgeline.llm.common import materialize

QUALITY_LEAST = 0.5
TOXICITY_BELOW = 0.5


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is QUALITY_LEAST or more; texts without words go."""
    return quality.scored(docs).filter(F.col("quality") >= QUALITY_LEAST).select(*docs.columns)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXICITY_BELOW."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.scored(docs, labels).filter(F.col("toxicity") < TOXICITY_BELOW).select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of documents linked by the n-gram Jaccard join, on five-word shingles at 0.8."""
    return jaccard.one_of_each(docs, width=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: documents once per epoch, the last one of a source cut to its words."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, the ids and whether their decoding gives the text again."""
    coded = bpe.round_trip(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return coded.select("doc_id", "source", "n_tokens", "ids", same.alias("decodes"))


STAGES = [
    ("quality_classifier", good_quality),
    ("toxicity", not_toxic),
    ("jaccard_near_copies", one_of_near_copies),
    ("mix_sources", mixed),
    ("bpe_encode", tokens),
]

#: SQL cannot express the trained stages; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
