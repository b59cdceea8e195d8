"""One query per operator with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from chatloom.llm import line_dedup
from chatloom.llm.decontaminate import contaminated
from chatloom.llm.quality_rules import BASE, judged
from chatloom.llm.secrets import scan_secrets
from chatloom.llm.sentencepiece_codec import encoding_summary
from chatloom.llm.simhash_dedup import near_duplicate_summary
from chatloom.llm.suffix_dedup import removed_repeats
from chatloom.llm.token_alignment import token_alignment
from chatloom.llm.token_counts import token_counts
from chatloom.llm.token_files import token_file_round_trip
from chatloom.llm.toxicity import scored_documents
from chatloom.llm.warc import archive_round_trip
from chatloom.llm.whitening import whitened_embeddings
from chatloom.session import ready

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
MAX_TOKENS = 4096
END_ID = 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_summary(table(spark, sf_dir, "documents"), PIECES)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_summary(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select("doc_id", *BASE, "base_failed", "kept", "quality", "votes")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_repeats(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = archive_round_trip(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_round_trip(table(spark, sf_dir, "documents"), WORDS, END_ID)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), PIECES, MAX_TOKENS)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_summary(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment(table(spark, sf_dir, "documents"), BYTES, PIECES, (RANKS, public_tokenizers.PATTERN))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_embeddings(table(spark, sf_dir, "embeddings"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_warc": op5_warc,
    "op6_secrets": op6_secrets,
    "op7_token_files": op7_token_files,
    "op8_token_counts": op8_token_counts,
    "op9_decontaminate": op9_decontaminate,
    "op10_simhash_dedup": op10_simhash_dedup,
    "op11_token_alignment": op11_token_alignment,
    "op12_whitening": op12_whitening,
    "op13_toxicity": op13_toxicity,
}

ORACLE: dict[str, str] = {"op2_line_dedup": line_dedup.ORACLE}
