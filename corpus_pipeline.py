"""The corpus pipeline: from raw documents to packed token sequences.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns the rows it keeps, with the columns
of ``documents``; the last returns the packed pieces. Stages are written as Parquet and read again, so each is computed once.

Defined results, of all stages: extra columns are kept up to packing, whatever their names; an empty table gives an empty one; copies, ties
and rows that repeat an id are judged row by row, but near duplicates are told by id. What a stage makes of nulls is said at the stage. The
base rules of the quality rules hold here as well, so short documents go, clean ones too.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vellum.llm import language_id, packing, quality_rules, simhash_tiles
from vellum.llm.common import materialise, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, null and empty texts among them, and those whose language is told with a score under a half.

    Rows with a null language are not learned from, and judged like others; if no row has a language, nothing can be told, and all go."""
    return language_id.keep_documents(docs, language_id.fit(language_id.learnable(docs)))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents by the base rules, null and empty texts among them, and those whose lines fail for most of their text."""
    return quality_rules.keep_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of linked SimHash fingerprints, and one row of it.

    Rows without an id link with nothing, and all of them stay. Of rows that repeat an id all texts count for links, and one with the least text stays."""
    return simhash_tiles.keep_first(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenises and packs what is left; a null text, which no stage before lets through, would be empty."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", identify_language),
    ("quality", apply_quality_rules),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack_sequences),
]

#: Neither the learned language model nor tokenisation can be put into SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
