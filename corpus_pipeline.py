"""Corpus pipeline: quality rules, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of docs. ``run`` writes each stage's result as Parquet in the shared folder and reads it again as the
next one's docs; a stage's own tables are removed once the next one is written.

Defined cases: every stage takes an empty table; repeated rows are rows of their own; further columns
pass through. What a stage does with nulls, empty and very long texts stands with it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portico.llm import minhash, packing, quality, secrets
from portico.llm.common import remove, shared_dir, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and keep most of their words, without the lines above the limits.

    A null or empty text has no words and goes; a null source is a host of its own; a null doc_id is
    judged like any other. n_chars is brought up to date. Texts are read whole.
    """
    clean = quality.judge(docs).filter("kept").withColumn("text", F.col("cleaned"))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id.

    Null and empty texts link with nothing and stay, and so do rows with a null doc_id; rows that
    share a doc_id are one document and stay or go together.
    """
    return minhash.deduplicate(docs).select(*docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark and n_chars brought up to date.

    A null text stays null, its n_chars too. The model is trained on at most ``secrets.TRAIN_DOCUMENTS``
    of docs that are labelled as good.
    """
    model = secrets.train(docs, table(spark, sf_dir, "labels"))
    clean = secrets.redact(docs, model)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces of sequences of 1024 tokens; a null text is an empty one and gives its final id."""
    return packing.pack(docs, public_tokenizers.path(packing.VOCABULARY), added=True)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("secret_scans", secret_scans), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    path, docs, before = shared_dir(spark), table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{name}")
        remove(spark, *before)
        docs, before = spark.read.parquet(f"{path}/{name}"), [f"{path}/{name}"]
    return docs


#: Token ids are beyond SQL; the tests hold the rows against a brute-force version.
ORACLE_SQL = None
