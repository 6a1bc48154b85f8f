"""The corpus pipeline over ``documents``.

Documents that the quality classifier rejects go; later copies of repeated line
passages are cut out; one document of each near-duplicate component stays;
documents that contain a benchmark item go; what is left is encoded, decoded and
digested. ``STAGES`` names the stages in order; each takes ``(spark, docs,
sf_dir)`` and returns the next one's documents, all but the last with the columns
of ``documents``. Every stage has its operator's defined results for nulls, empty,
very long and repeated rows, empty tables and further columns; near-dedup keeps one
row of each component, which has no id only if no row of the component has one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.llm import bpe, decontaminate, linededup, quality, simhash
from kairograph.llm.session import table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = quality.classify(docs, table(spark, sf_dir, "labels"), kept_col="__kept", perplexity_col="__perplexity")
    return found.where("__kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(docs, counts=False)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component: the one with the smallest id (see ``simhash.keep_one``)."""
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_bpe", byte_bpe),
]

#: The first stage's model is not expressible in SQL; ``tests/llm/test_pipeline.py`` holds the run against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
