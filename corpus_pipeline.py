"""A training corpus from raw documents: filter, deduplicate, decontaminate, pack.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of ``documents``.  ``run`` writes each stage's result as
Parquet in the cluster's shared folder and hands what it reads back to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabweave.llm import decontaminate, jaccard, lines, packing, quality
from tabweave.session import scratch_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit(docs, labels))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal and similar lines the first stays; a document without any line left goes."""
    return lines.deduplicate_lines(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with similar sets of five-word shingles one stays."""
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document that is mostly benchmark goes."""
    return decontaminate.remove_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of what is left, in sequences of at most 2048."""
    return packing.pack_documents(docs, "byte_bpe_50k.json")


STAGES = [("quality_classifier", quality_classifier), ("line_dedup", line_dedup), ("jaccard_join", jaccard_join),
          ("decontamination", decontamination), ("packing", pack)]

# trained models, similarity joins and tokenizers are beyond SQL; see tests/llm/test_pipeline.py
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder of tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
