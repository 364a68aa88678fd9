"""Corpus preparation in five stages; each writes Parquet that the next one reads.

Defined cases, for every stage: a null text is an empty one; a very long text is judged whole; rows without doc_id and different texts
under one doc_id are judged each by itself; columns beyond those of documents, whatever their names, are kept; an empty table passes as
an empty table. An empty text fails the quality rules. Each stage's module says the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sondage.llm import probminhash, pu_quality, rule_ledger, speculative_bpe, template_decontam
from sondage.sources import durable, read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what fails none of the rules of the policy; repeated rows stay or go together."""
    return rule_ledger.filter_documents(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what scores 0.5 or more; without labels every score is 0.5 and all rows stay."""
    return pu_quality.filter_documents(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each class, the one with the least doc_id (of its texts the one with the least hash); rows without doc_id stay."""
    return probminhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop every row that holds a benchmark item; an empty benchmark drops none."""
    return template_decontam.remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (packed little-endian unsigned 32-bit), n_tokens, ids_sha256, decoded_sha256 of each row."""
    return speculative_bpe.encode_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

#: Neither the classifier nor the shingles nor the tokens can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
