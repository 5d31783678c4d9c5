"""From raw documents to packed training sequences, in five stages.

Each stage works on all that its predecessor kept and is written as Parquet before the next one reads it, so a lost
executor costs one stage's tasks at most.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from studyloom.llm import decontamination, near_dedup, packing, quality, secrets
from studyloom.sources.storage import made_tables, removed, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays (shingles of five words, similarity 0.8 or more)."""
    return near_dedup.filter_documents(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return decontamination.filter_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials are replaced in the text; widely copied examples stay."""
    return secrets.redact_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces, ids and all, with their sequence and offset: sorted by these two, the ids of a sequence are ready to train on."""
    return packing.pack_documents(docs, with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: Sketches, tokens and packing are beyond SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage has written on its way goes when its result is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with made_tables() as tables:
            docs = written(stage(spark, docs, sf_dir), name)
        removed(spark, [*last, *(t for t in tables if t != docs.written_to)])
        last = [docs.written_to]
    return STAGES[-1][1](spark, docs, sf_dir)
