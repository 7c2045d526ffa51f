"""The registered queries of the training-data operators, with production parameters; their DuckDB SQL is in `oracles`."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stringloom.llm import bpe_codec, decontam, exact_dedup, filter_audit, langid, lm_score, packing, pii, simhash, token_count, toxicity, url_filter, vector_codes
from stringloom.llm.common import documents, fold, table
from stringloom.llm.oracles import ORACLES as ORACLES


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_count.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [pii.count(F.col("base"), kind).cast("long").alias(f"n_{kind}") for kind in pii.PATTERNS]
    base, spans = pii.written(F.col("base")), pii.written(F.col("spans"))
    return pii.find(documents(spark, sf_dir)).select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(documents(spark, sf_dir))


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    both = bpe_codec.encode(documents(spark, sf_dir), vocabulary, decoded=True, pattern=public_tokenizers.PATTERN)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "n_split")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    known = docs.where(F.coalesce(fold("doc_id", 4), F.lit(-1)) != 2)
    return langid.learn_and_identify(known, docs, "doc_id", "text", (F.coalesce(fold("doc_id", 4), F.lit(-1)) == 2).alias("held_out"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).withColumn("purity", F.round("purity", 9))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return lm_score.score(documents(spark, sf_dir), crc % 10 == 0, (F.floor(crc / 10) % lm_score.ROUNDS).cast("int"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = documents(spark, sf_dir), F.coalesce(fold("doc_id", 5), F.lit(-1)) == 0
    values, bias = toxicity.learn(docs.where(~held_out), table(spark, sf_dir, "labels").where(~held_out))
    scored = toxicity.score(docs, values, bias, "doc_id", "text", held_out.alias("held_out"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    return packing.pack_documents(documents(spark, sf_dir), vocabulary, ranks, public_tokenizers.PATTERN)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


_OPERATORS = (
    op1_token_counts, op2_pii, op3_exact_dedup, op4_bpe_codec, op5_language_id, op6_url_filter, op7_decontamination, op8_lm_score, op9_simhash, op10_toxicity,
    op11_vector_codes, op12_packing, op13_filter_audit,
)
QUERIES = {f.__name__: f for f in _OPERATORS}
