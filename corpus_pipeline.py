"""Corpus pipeline over ``documents``: STAGES in order, each written as
Parquet and reread as the next stage's input."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from recordfold.llm import bpe_codec, common, mixing, pii, quality, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates stays."""
    return simhash.keep_one(docs, shingle=4, max_bits=4)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is masked."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, and its ``position`` in the mix:
    the mixing stage's order, from the files it was written to."""
    return bpe_codec.encoded(common.in_file_order(docs, "position"), public_tokenizers.path("word_bpe_49k.json"), ("position",))


STAGES = [("quality_rules", quality_rules), ("simhash_neardup", near_duplicates), ("pii", personal_data),
          ("source_mix", mix_sources), ("bpe_codec", encode)]

#: SimHash components and BPE merges can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; every stage's table is written to the shared folder."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
