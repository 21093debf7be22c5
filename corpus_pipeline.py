"""The corpus pipeline: documents through quality rules, near-dedup, repeat removal, secrets and packing.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept. All but the last
return the columns of `documents`; where a stage changes a text, n_chars follows it. A null text is
rejected by the quality rules, so later stages see none; a stage run by itself defines nulls, ties and
empty tables as its operator does.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import packing, quality, repeats, secrets, simhash
from plumbline.llm.queries import tokenizer_path
from plumbline.operators.stash import discard, keep, scratch, stash
from plumbline.sources.tables import table

#: Packing and exact repeat removal have no SQL of their own; tests hold each stage against brute force.
ORACLE_SQL = None


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars as the length of the text that a stage left."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind)).select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the others go, those without a text among them. Equal rows are judged alike."""
    return quality.quality_rules(docs, kept_only=True)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group stays: that of the smallest doc_id, a null one last, of equal ones the first written."""
    return simhash.keep_one_of_each(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeat an earlier string of 100 bytes; every document stays, a null text as it is."""
    return _counted(repeats.remove_repeats(docs))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets masked; every document stays, a null text as it is."""
    return _counted(secrets.redact_secrets(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document, with its sequence of at most 4096 tokens and its place there; a null text is its end id alone."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("suffix-array dedup", repeats_stage),
    ("secret scans", secrets_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents, each on what the one before it wrote.

    What a stage wrote on its way is removed once its result is, and its input with it.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        with scratch(spark):
            made = keep(stash(stage(spark, docs, sf_dir), f"pipeline-{k + 1}"))
        discard(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
