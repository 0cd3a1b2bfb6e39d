"""The corpus pipeline: language, near duplicates, secrets, mixture, packs.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last
return the columns of `documents`. Nulls and empty tables pass through as each operator defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm._common import durable, table
from tallyloom.llm.language_id import keep_identified, learn, training_rows
from tallyloom.llm.mixture import take_mixture
from tallyloom.llm.packing import pack, token_lengths
from tallyloom.llm.secret_scan import redact
from tallyloom.llm.simhash import drop_near


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language (null, or no letter) go."""
    return keep_identified(docs, learn(training_rows(docs)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest doc_id."""
    return drop_near(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become a mark; every document stays."""
    return redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    return take_mixture(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document (and repeat) in length buckets and batches."""
    return pack(token_lengths(docs))


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mixture", mix_sources),
    ("packing", pack_documents),
]

#: The connected components and the learned profiles can't be put in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
