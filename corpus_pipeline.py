"""Corpus pipeline: quality rules, near-dedup, benchmark decontamination, personal data, mixing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet in the shared folder and read as the next one's docs.

Defined cases: a document with a null or empty text has under ten words and goes in the first stage; repeated rows are copies, of which the second stage keeps one; a null id
ranks last among copies and is kept otherwise; a null source is a source of its own in the mix; texts of any length are read whole; of ties (equal least ids) the row read
first stays; further columns, whatever their names, reach the last stage unchanged; an empty table gives an empty result, and an empty benchmark removes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import decontaminate, mixing, near_dedup, pii, quality
from quillmark.llm._tables import documents, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the repetition and word rules."""
    return quality.filtered(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of the least doc_id."""
    return near_dedup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.without_documents(docs, documents(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    clean = pii.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the mix's blocks of text to a table of the shared folder, whose name begins with MIXED; words that the mix takes of each document, towards its source's target."""
    made = mixing.mixed(docs)
    written(mixing.blocks_of(docs, made), MIXED)
    return mixing.takes_of(made)


MIXED = "mixed-blocks"
STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("mixing", mixing_stage),
]
#: Consistent sampling, bootstrapped patterns and seeded permutations are beyond SQL; the tests hold run() against brute force up to the base personal data,
#: without context spans, and the mix against mixing.takes itself.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for n, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{n}")
    return docs
