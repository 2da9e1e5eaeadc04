"""From raw documents to packed training sequences, in five stages over whole tables.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; what it returns is written and read
again as the next one's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsight.llm.line_runs import without_copied_lines
from keepsight.llm.near_dup import NearDup, distinct_documents
from keepsight.llm.packing import packed
from keepsight.llm.spaced_seeds import decontaminated
from keepsight.llm.storage import Scratch
from keepsight.llm.supervision import good_documents
from keepsight.sources.shared import ensure_shared

#: Words that a run of lines must have to count as a copied passage.
RUN_WORDS = 50


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the weighed votes of the rules reject go."""
    ensure_shared(spark)
    return good_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines go, and documents that nothing else is left of."""
    ensure_shared(spark)
    left = without_copied_lines(docs, RUN_WORDS)
    return left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8."""
    ensure_shared(spark)
    return distinct_documents(docs, NearDup(shingle=5, threshold=80))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    ensure_shared(spark)
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents left, in full windows of at most 1,024 ids."""
    ensure_shared(spark)
    return packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Neither the estimates of EM nor BPE ids can be said in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ensure_shared(spark)
    scratch, docs = Scratch("pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
