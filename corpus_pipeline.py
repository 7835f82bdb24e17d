"""A corpus pipeline: quality classifier, near-duplicate removal, secret masking, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the
columns of ``docs``; the last returns the pieces of the mixed documents with their place in sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maskwell.llm import dartminhash, mixing, packing, rule_ensemble, secrets
from maskwell.llm.common import stage, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, learnt from ``labels``, scores 0.7 or more."""
    return rule_ensemble.good_documents(docs, table(spark, sf_dir, "labels"))


def drop_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return dartminhash.without_duplicates(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with secrets, those in decoded layers too, masked."""
    return secrets.without_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights takes them."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents with their place in sequences."""
    return packing.packed_documents(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", drop_duplicates),
    ("secret scans", mask_secrets),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Signatures, decoding and tokenizers are beyond SQL; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, f"stage{k}")
    return docs
