"""What several operators share: input columns, written intermediate tables, frequent keys."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stringloom.tables import settled as settled
from stringloom.tables import stash as stash  # what the operators write goes where all tables go

#: Rows of one Arrow batch that goes to Python; whole documents can be long.
ARROW_ROWS = 256

#: Code points of white space in the contracts: space and U+0009 to U+000D.
WHITE_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_rows(spark: SparkSession) -> None:
    """No more than ARROW_ROWS whole documents in a batch for Python."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


@contextmanager
def rows_per_batch(spark: SparkSession, n: int):
    """Batches of `n` short rows for the jobs that run within."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """(doc_id, text, more...), a null text being empty. All other columns go, so their names cannot clash."""
    bound_rows(df.sparkSession)
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more)


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def count_keys(df: DataFrame, gather: Callable[[Counter, pa.RecordBatch], None], most: int = 300_000, most_bytes: int = 256 << 20) -> DataFrame:
    """(key, n): how often each key occurs. `gather` adds the keys of a batch, strings or their UTF-8 bytes, to a counter;
    each task hands its counter on when it has `most` keys or has read `most_bytes`, which its keys cannot exceed, so
    little is shuffled and memory is bounded."""

    def run(batches):
        found: Counter = Counter()
        size = 0
        for batch in batches:
            gather(found, batch)
            size += batch.nbytes
            if len(found) > most or size > most_bytes:
                yield _counted(found)
                found.clear()
                size = 0
        if found:
            yield _counted(found)

    return df.mapInArrow(run, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _counted(found: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["key", "n"])


#: Bytes of the longest key that tasks hold; longer ones are joined like rare ones.
LONGEST = 128


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The most frequent keys of (key, n), at most `most` of them and none of more than LONGEST bytes: all whose count
    reaches a threshold that a histogram of the counts gives. The histogram has at most some hundred rows, whatever the
    input."""
    counts = counts.where(F.octet_length("key") <= LONGEST)
    level = F.floor(F.log2("n") * 16).cast("int")
    sizes = counts.groupBy(level.alias("level")).agg(F.count("*").alias("keys")).orderBy(F.desc("level")).collect()
    total, least = 0, None
    for row in sizes:
        total += row.keys
        if total > most:
            break
        least = row.level
    return counts.where(level >= least) if least is not None else counts.limit(0)
