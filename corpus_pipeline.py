"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and returns a DataFrame that the next one reads from Parquet."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidepool.llm import bpe, exact_dedup, langid, mixing, simhash
from tidepool.llm.queries import EPOCHS, MIXTURE, RANKS, language_model
from tidepool.session import shared_folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of their own texts and languages doesn't reject."""
    return langid.keep_known(docs, language_model(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, with the operator's shingles and bit distance."""
    return simhash.drop_near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents emitted by the rates that meet the target weights of the domains of the labels table."""
    labels = mixing.label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixing.mix(docs, labels, MIXTURE, EPOCHS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document and the proof that they decode to its text."""
    return bpe.round_trip(docs, bpe.read_ranks(spark, RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("language ID", language_id), ("exact dedup", exact_copies), ("SimHash near-dedup", near_copies),
    ("mixing to target weights", mixture), ("BPE encoding", encoding),
]
#: The stages' models and fingerprints have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
