"""From raw documents to packed training sequences in five stages, each an operator of rankweave.llm.

A stage takes (spark, docs, sf_dir) and gets what its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankweave.llm.decontaminate import clean_documents
from rankweave.llm.jaccard import one_of_each
from rankweave.llm.packing import pack
from rankweave.llm.quality import good_documents
from rankweave.llm.shared import written
from rankweave.llm.suffix_dedup import PASSAGE, PASSAGE_GRAM, without_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on those given, doesn't reject."""
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group of linked ones."""
    return one_of_each(docs).select(COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of over 50 words that occur elsewhere; words are compared, not op2's 400 bytes."""
    return without_repeats(docs, length=PASSAGE, gram=PASSAGE_GRAM, unit="words").select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any n-gram of a benchmark item."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences."""
    return pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("decontamination", decontamination), ("packing", packing)]

#: SQL can't express the classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
