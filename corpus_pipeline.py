"""Training-data pipeline over `documents`: five operators, each over all that the one before kept.

1. quality rules: documents that the base rule or a certified cutoff rejects go;
2. near-duplicates: one document of each component stays;
3. suffix dedup: bytes of 100-byte strings that start earlier leave the texts;
4. benchmark decontamination: documents with a passage of a benchmark item go;
5. SentencePiece encoding: ids of the best segmentation.

SQL cannot express the cutoffs' exact bounds, the removal by bytes and the
segmentation, so ORACLE_SQL is None; the tests hold the stages against
brute-force versions. An empty table gives an empty result at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkvigil.llm import decontaminate, near_dedup, pieces, quality_rules, suffix_dedup
from sparkvigil.llm.store import documents, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality_rules.passing(docs, labels)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(docs, percent=80)
    return docs.join(found.where("not kept").select("doc_id"), "doc_id", "left_anti")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs, pieces.model_path(), keep_ids=True)


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("suffix dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("SentencePiece encoding", encoded),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result but the last is written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
