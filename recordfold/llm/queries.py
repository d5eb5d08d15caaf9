"""Registered queries of the training-data operators, one per operator, each
over the whole ``documents`` table with the production parameters."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordfold.llm import common, fill_middle_sql, hard_negatives_sql, quality_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@register("op7_simhash_neardup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordfold.llm import simhash
    return simhash.near_duplicates(common.documents(spark, sf_dir), shingle=4, max_bits=4) \
        .select("doc_id", "fingerprint", "component_id")


@register("op3_quality_rules", quality_sql.oracle())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordfold.llm import quality
    return quality.quality_report(common.documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@register("op10_pii")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordfold.llm import pii
    return pii.report(common.documents(spark, sf_dir)).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "scores")


@register("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from recordfold.llm import token_counts
    return token_counts.token_counts(common.documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


@register("op8_bpe_codec")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from recordfold.llm import bpe_codec
    return bpe_codec.digests(common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@register("op9_source_mix")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordfold.llm import mixing
    return mixing.positions(common.documents(spark, sf_dir)).select(
        "doc_id", F.col("src").alias("source"), "block", "slot", "position")


@register("op6_token_records")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from recordfold.llm import records
    from recordfold.session import scratch_path
    files, index = scratch_path(spark, "records"), scratch_path(spark, "records-index")
    records.write_records(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), files, end_id=2)
    records.write_index(spark, files, index)
    return records.read_index(spark, index).select("doc_id", "start", "n_tokens", "ids_crc32")


@register("op1_fingerprints")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordfold.llm import minhash
    return minhash.fingerprints(common.documents(spark, sf_dir))


@register("op2_license_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordfold.llm import licenses
    return licenses.scan(common.documents(spark, sf_dir), any_start=True)


@register("op5_lm_scores")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordfold.llm import ngram
    return ngram.train_and_score(common.documents(spark, sf_dir))


@register("op11_hard_negatives", hard_negatives_sql.oracle())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordfold.llm import hard_negatives
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(v.withColumn("label", moved))


@register("op13_fill_middle", fill_middle_sql.oracle())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordfold.llm import fill_middle
    return fill_middle.digests(common.documents(spark, sf_dir))


@register("op12_secrets")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordfold.llm import secrets
    return secrets.report(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")
