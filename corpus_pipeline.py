"""A corpus pipeline: quality rules, language ID, near duplicates, benchmark decontamination, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept; `run` writes each stage's rows as Parquet to the
cluster's shared folder and reads them again for the next, so a lost executor costs one stage at most.

In every stage a null text counts as an empty one, a null doc_id is an id like any other, an empty table gives an empty table, and columns
beyond doc_id and text pass through untouched whatever their names (lang is read where the language is learned; packing returns pieces).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyrail.llm import decontam, langid, packing, quality, simhash
from tallyrail.llm.common import stored, table
from tallyrail.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the production policy rejects; repeated rows are judged alike and all stay or go."""
    return quality.keep(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; the languages are learned from the labelled ones among `docs`.

    Empty texts go, and so does every document where none is labelled. Equally small encodings have no margin and go too.
    """
    return langid.keep(docs, langid.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of fingerprints within three bits the document with the smallest doc_id; null ids come last.

    Of rows that share the id, the one with the smallest hash of its text stays, and one row of repeated ones. Texts without words link.
    """
    return simhash.keep(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark phrase; repeated rows all stay or go, an empty benchmark rejects nothing."""
    return decontam.keep(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids, one row per piece; repeated rows are packed once each, an empty text is its closing id alone."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", pack),
]

#: Compression sizes, fingerprints and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
