"""A training corpus from raw documents: quality rules, near duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. ``run`` writes each stage's rows as Parquet in the shared folder, reads them for the next and deletes them
once that is written.

Defined cases, in every stage: null in any column, empty and very long texts, ties, repeated rows and empty tables are
taken as the stage's operator says in its docstring; columns besides those of documents, whatever their names, stay.
A document that mixing takes twice is two documents to packing, told apart by ``document_row``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfield.llm import mixing, packing, robust_quality, secret_scan, shingle_join
from wayfield.llm.queries import SOURCE_DOMAIN, vocabulary
from wayfield.session import discard, materialize

MIX = mixing.MixPlan(
    domain_weights={"g0": 0.4, "g1": 0.3, "g2": 0.3},
    lang_weights={"en": 0.55, "de": 0.2, "fr": 0.15, "es": 0.1},
    budget_share=0.9,
    max_epochs=2,
    seed=29,
)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are robust outliers of their language and source go."""
    return robust_quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets linked at 0.75 or more stays."""
    return shingle_join.keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; n_chars follows the text."""
    masked = secret_scan.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the token budgets of domains, languages and sources, as often as their leaf has epochs."""
    return mixing.choose(docs, MIX, F.expr(SOURCE_DOMAIN))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 ids."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("source_mixing", source_mixing),
    ("packing", packing_stage),
]

#: Tokenizer output and the estimates' iterations have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
