"""Corpus pipeline: raw documents to the encoded training mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and reread as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import read_table, saved, ship_package
from tessera.llm.mixing import mixed_documents
from tessera.llm.piece_codec import encode_texts
from tessera.llm.queries import tokenizer_path
from tessera.llm.secret_scans import redact_secrets
from tessera.llm.simhash_dedup import keep_one
from tessera.llm.toxicity import drop_toxic, fit_toxicity

#: Strings that an encoding worker remembers: it outlives its stage, and the
#: memory is needed by the next job's stages.
ENCODE_MEMO = 50_000


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model does not reject."""
    ship_package(spark)
    return drop_toxic(docs, fit_toxicity(docs, read_table(spark, sf_dir, "labels")))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    ship_package(spark)
    return keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked, character counts as they are now."""
    masked = redact_secrets(docs)
    return masked.withColumn("n_chars", F.coalesce(
        F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every reading of a document, in training order."""
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids, token counts and digests of every reading."""
    ship_package(spark)
    return encode_texts(docs, tokenizer_path(), memo=ENCODE_MEMO, with_ids=True)


STAGES = [
    ("toxicity", toxicity),
    ("simhash_dedup", simhash_dedup),
    ("secret_scans", secrets),
    ("mixing", mixing),
    ("sentencepiece", encode),
]

#: Learned scores and bit distances have no SQL form; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
