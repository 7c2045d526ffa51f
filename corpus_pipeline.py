"""The corpus pipeline: each stage reads what its predecessor wrote and keeps the rows of `documents` that pass."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stringloom.llm import bpe_codec, decontam, exact_dedup, langid, simhash
from stringloom.llm.common import fold, table
from stringloom.tables import settled, stash

#: Texts in no known language, and those whose language is less sure than this, are rejected.
LEAST_SCORE = 0.25


#: Words of a shingle of the near-duplicate stage; its links are those of operator 9.
SHINGLE = 5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told. Mixed documents stay, under the language with the largest share. Texts that
    are null, empty or without letters go."""
    known = docs.where(F.coalesce(fold("doc_id", 4), F.lit(-1)) != 2)
    found = langid.learn_and_identify(known, docs, "doc_id", "text", F.struct(*docs.columns).alias("document"))
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("document.*")


def _numbered(docs: DataFrame) -> DataFrame:
    """With `key`: the doc_id, then the row's number, so that rows with one doc_id can be told apart. The numbers are written
    with the rows: another reading, split otherwise, would number them anew."""
    return stash(docs.select(F.struct("doc_id", F.monotonically_increasing_id().alias("row")).alias("key"), F.struct(*docs.columns).alias("document")), "numbered")


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal without white space: the longest, of equals that with the smallest
    doc_id, of repeated rows one. Null and empty texts are one group."""
    rows = _numbered(docs)
    kept = exact_dedup.duplicates(rows.select("key", "document.text"), "key").where("kept").select(F.col("doc_id").alias("key"))
    return _having(rows, kept)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the smallest doc_id, of each group of texts whose fingerprints link. Null and empty texts have one
    fingerprint and are one group."""
    rows = _numbered(docs)
    kept = simhash.near_duplicates(rows.select("key", "document.text"), "key", words=SHINGLE).where("doc_id = component_id").select(F.col("doc_id").alias("key"))
    return _having(rows, kept)


def _having(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The documents that were kept. Their numbers grow with the documents, so both sides are shuffled at every size."""
    kept = stash(kept.select("key.row"), "kept").hint("shuffle_merge")
    return rows.select(F.col("key.row").alias("row"), "document").join(kept, "row", "left_semi").select("document.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; null and empty texts hold none."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): the ids as little-endian unsigned 32-bit integers, and the digest of the
    bytes that they decode to. Null and empty texts have no ids."""
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    both = bpe_codec.encode(docs, vocabulary, decoded=True, pattern=public_tokenizers.PATTERN)
    return both.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("bpe_tokens", bpe_tokens),
]

#: Mixtures, fingerprints and tokens are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read by the next. What a stage writes on its way goes when its
    result is there."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(lambda: stage(spark, docs, sf_dir), name)  # noqa: B023
    return STAGES[-1][1](spark, docs, sf_dir)
