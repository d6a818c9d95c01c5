"""The corpus pipeline: language ID, quality rules, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all that the stage before kept. Stages but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import language, minhash, packing, rules
from tidemark.llm.common import checkpointed, table
from tidemark.llm.queries import pieces_of

#: Documents whose language has less probability than this are rejected, as are those without letters: it must be likelier
#: than all others together. Of held-out texts, four of the five that are read wrongly lie under it, and 0.2 % of the others.
LEAST_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that the network knows, by its prediction; those without letters and unsure ones go.

    Null and empty texts go; a null doc_id and repeated rows change nothing; an empty table stays empty; other columns stay."""
    return language.known_rows(docs, language.learned(docs, 4, 2), LEAST_SCORE)


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. Null and empty texts go; null ids, repeated rows, empty tables and other columns
    as in the stage before."""
    return rules.kept_rows(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest doc_id, of each group of near-duplicates of similarity 0.8 or more; of repeated rows one.
    Documents with a null doc_id stay, and so do null and empty texts, one of each doc_id. An empty table stays empty."""
    return minhash.kept_rows(docs, percent=80)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document's pieces, with their sequences and offsets; a null or empty text is one token. Null ids and repeated
    rows are packed like others; an empty table gives no rows; columns of docs other than doc_id are left out."""
    return packing.packed(pieces_of(docs))


STAGES = [("language_id", language_stage), ("quality_rules", rules_stage), ("near_dedup", dedup_stage), ("packing", packing_stage)]

#: Classifiers, signatures and tokenizers can't be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
