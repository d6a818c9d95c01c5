"""One query per operator, over the whole of its table, with production parameters."""

from __future__ import annotations

import public_tokenizers as tokenizers_at
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import fingerprints, language, minhash, packing, quality, rules, simhash, tokens, toxicity, urls, variants, vectors
from tidemark.llm.common import table
from tidemark.llm.oracles import ORACLES  # noqa: F401


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokenizers_at.path("piece_bpe_32k.model"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(table(spark, sf_dir, "documents"), tokenizers_at.path("byte_bpe_multi_50k.tiktoken"), tokenizers_at.PATTERN)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Verdict, host and path of each rule.
RULES = """
allow com/
block example.com/en/
allow www.example.com/en/
block net/es/
block net/fr/
"""


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"), urls.parse(RULES))


def pieces_of(docs: DataFrame) -> DataFrame:
    """The pieces that are packed, by the byte-level vocabulary of 50,257 entries."""
    return tokens.token_pieces(docs, tokenizers_at.path("byte_bpe_50k.json"), tokenizers_at.path("byte_bpe_50k.tiktoken"), tokenizers_at.PATTERN)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(pieces_of(table(spark, sf_dir, "documents")))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_id(table(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.vector_codes(table(spark, sf_dir, "embeddings"))


_ALL = (
    op1_token_counts, op2_minhash_near_dedup, op3_byte_bpe, op4_quality_rules, op5_quality_classifier, op6_url_filters, op7_best_fit_packing,
    op8_language_id, op9_fingerprints, op10_toxicity, op11_simhash_near_dedup, op12_spelling_variants, op13_vector_codes,
)
QUERIES = {f.__name__: f for f in _ALL}
