"""The corpus pipeline: raw documents to a clean, deduplicated and mixed training set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scenequarry.llm.decontamination import remove_contaminated
from scenequarry.llm.mixing import take_copies
from scenequarry.llm.near_duplicates import drop_near_duplicates
from scenequarry.llm.quality_rules import keep_good
from scenequarry.llm.secrets import redact_secrets
from scenequarry.llm.shared import store


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Each row is judged on its own, also where ids repeat or are null; null, empty and short texts go; a null language is judged by the
    cutoffs of all documents; without labels only the base rules reject; an empty table stays empty; other columns are handed on.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more.

    Texts without a word (null or empty) and rows without an id stay; rows that share an id stay or go together; of equal texts the least id stays; an
    empty table stays empty; other columns are handed on.
    """
    return drop_near_duplicates(docs, shingle=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark text.

    Each row is judged by its own text, also where ids repeat or are null; null and empty texts stay; without benchmark texts all stay; other columns are handed on.
    """
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark.

    Null texts stay null; repeated rows are each redacted; texts of any length; an empty table stays empty; other columns are handed on.
    """
    return redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Null and empty texts have no words and are never taken; a null source is one more source; repeated rows, and those without an id, are rows of their own; an
    empty table stays empty; other columns are handed on.
    """
    return take_copies(docs)


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("decontamination", decontaminate), ("secrets", secrets), ("mixing", mix)]

#: The mix draws at random from hashes, and groups of near copies are a closure over exact similarities: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = store(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
