"""The corpus pipeline: STAGES in order, each written and read again before the next.

Every stage but the last returns the columns of its input, whatever their names.
Rows are judged one by one, so null and repeated ids are rows like others. Null
and empty texts fail the quality rules, so no later stage meets them. An empty
table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gapweave.llm import decontaminate, ngram_join, packing, pii, quality
from gapweave.llm.common import stage, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject; null and empty texts are among them."""
    return quality.kept_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates, the one with the smallest id; rows without words all stay."""
    return ngram_join.first_rows(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that overlap a benchmark item; null texts overlap none, null items match nothing."""
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Redacts personal data and disclosing terms; n_chars follows the new text, a null text stays null."""
    return pii.redact(docs, measure="n_chars")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences; a row per piece, one of length 1 for a text without tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: Connected components, redaction and packing are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the table documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
