"""The registered queries: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import read_table
from tessera.llm.fingerprints import fingerprint_edits
from tessera.llm.license_scans import scan_licenses
from tessera.llm.merkle import verify_tampering
from tessera.llm.mixing import mix
from tessera.llm.phrase_mining import mine_phrases
from tessera.llm.piece_codec import encode_texts
from tessera.llm.quality_rules import judge_quality
from tessera.llm.registry import query
from tessera.llm.secret_scans import scan_secrets
from tessera.llm.simhash_dedup import near_duplicates
from tessera.llm.substring_dedup import remove_repeats
from tessera.llm.token_counts import length_histogram, with_lengths
from tessera.llm.toxicity import fit_toxicity, score_toxicity
from tessera.llm.warc import round_trip


def tokenizer_path() -> str:
    """Vocabulary of the SentencePiece queries."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op1_secret_scans")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read_table(spark, sf_dir, "documents"))


@query("op2_quality_rules")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(read_table(spark, sf_dir, "documents"))


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, read_table(spark, sf_dir, "labels")))


@query("op4_sentencepiece")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(read_table(spark, sf_dir, "documents"), tokenizer_path())


@query("op5_document_fingerprints")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(read_table(spark, sf_dir, "documents"))


@query("op6_simhash_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


@query("op7_license_scans")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))


@query("op8_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    return length_histogram(with_lengths(
        docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


@query("op9_mixing_sources")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"))


@query("op10_warc")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "pages"))


@query("op11_phrase_mining")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(read_table(spark, sf_dir, "documents"))


@query("op12_substring_dedup")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"))


@query("op13_merkle_manifest")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify_tampering(read_table(spark, sf_dir, "documents"))
