"""Token counts without ids: pieces are counted once for each distinct pre-token of the corpus."""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Callable
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stringloom.llm.common import count_keys, frequent, stash, texts

#: Pre-tokens whose counts every task holds: some megabytes, whatever the input. The others are joined.
HELD = 1 << 18

#: Characters from here on can be classed otherwise by another Unicode version; texts with them are split by the library.
STABLE = "ɐ"


def load(vocabulary: str):
    """The tokenizer of a .json file with its own handling of special strings."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@cache
def splitter_of(vocabulary: str, pattern: str) -> Callable[[str], tuple[list[str], int]]:
    """The splitter of a vocabulary, made once in each Python worker."""
    return splitter(load(vocabulary), pattern)


def splitter(tokenizer, pattern: str) -> Callable[[str], tuple[list[str], int]]:
    """A function from text to its pre-tokens and the number of special strings in it, each of which is one token."""
    added = tokenizer.get_added_tokens_decoder().values()
    if tokenizer.normalizer is not None or any(x.single_word or x.lstrip or x.rstrip for x in added):
        raise ValueError("only tokenizers without a normalizer and with plain special strings can be counted by pre-token")
    special = regex.compile("|".join(regex.escape(x.content) for x in sorted(added, key=lambda x: -len(x.content)))) if added else None
    words, beyond = regex.compile(pattern), regex.compile(f"[^\\x00-{chr(ord(STABLE) - 1)}]")

    def plain(text: str) -> list[str]:
        if text.isascii() or not beyond.search(text):
            return words.findall(text)
        return [text[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def split(text: str) -> tuple[list[str], int]:
        if special is None or not special.search(text):
            return plain(text), 0
        parts = special.split(text)
        return [x for part in parts for x in plain(part)], len(parts) - 1

    return split


def count_tokens(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", held: int = HELD) -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens as the tokenizer of `vocabulary` gives for the whole text.

    `pattern` is the pre-token pattern of that vocabulary. The corpus is read twice. First every distinct pre-token is
    gathered with its frequency and tokenized once. Then each document's pre-token frequencies meet these counts: those
    of the `held` most frequent pre-tokens in the task itself, the rest by a join, so no frequent key is shuffled.

    Null and empty texts count no tokens; repeated rows and ids give a row each; a null id stays null; an empty table
    gives no rows; other columns are not carried."""
    rows = texts(df, id_col, text_col)

    def pretokens(found, batch):
        split = splitter_of(vocabulary, pattern)
        for text in batch.column(1).to_pylist():
            found.update(split(text)[0])

    def tokenize(batches):
        tokenizer = load(vocabulary)
        for batch in batches:
            pieces = batch.column(0).to_pylist()
            n = [len(x.ids) for x in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["key", "n", "pieces"])

    known = stash(count_keys(rows, pretokens).mapInArrow(tokenize, "key string, n long, pieces long"), "pretokens")
    top = frequent(known, held)
    shared = df.sparkSession.sparkContext.broadcast({r.key: r.pieces for r in top.select("key", "pieces").toLocalIterator()})

    def frequencies(batches):
        split, counts = splitter_of(vocabulary, pattern), shared.value
        for batch in batches:
            n_bytes, sums, keys, times = [], [], [], []
            for text in batch.column(2).to_pylist():
                pieces, total = split(text)
                own, other = Counter(pieces), []
                for piece, n in own.items():
                    count = counts.get(piece)
                    if count is None:
                        other.append(piece)
                    else:
                        total += n * count
                n_bytes.append(len(text) if text.isascii() else len(text.encode()))
                sums.append(total)
                keys.append(other)
                times.append([own[x] for x in other])
            columns = [pa.array(n_bytes, pa.int64()), pa.array(sums, pa.int64()), pa.array(keys, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["row", "doc_id", "n_bytes", "held", "keys", "times"])

    out = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", df.schema[id_col].dataType)])
    for name, kind in (("n_bytes", T.LongType()), ("held", T.LongType()), ("keys", T.ArrayType(T.StringType())), ("times", T.ArrayType(T.LongType()))):
        out.add(name, kind)
    docs = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(frequencies, out)
    # One row for each pre-token that is not held; the first row of a document also brings what the task has summed. A
    # document without such pre-tokens has one row, under a key that no pre-token can equal: digits after NUL.
    pairs = docs.select("row", "doc_id", "n_bytes", "held", "times", F.posexplode_outer("keys").alias("i", "key")).select(
        "row",
        "doc_id",
        F.when(F.coalesce("i", F.lit(0)) == 0, F.col("n_bytes")).alias("n_bytes"),
        F.when(F.coalesce("i", F.lit(0)) == 0, F.col("held")).alias("held"),
        F.coalesce("key", F.concat(F.lit("\0"), (F.col("row") % 100_003).cast("string"))).alias("key"),
        F.when(F.col("key").isNotNull(), F.get("times", F.col("i"))).alias("times"),
    )
    rare = known.join(top.select("key"), "key", "left_anti") if held else known
    return (
        pairs.join(rare.select("key", "pieces"), "key", "left")
        .groupBy("row", "doc_id")
        .agg(F.sum("n_bytes").alias("n_bytes"), (F.sum("held") + F.coalesce(F.sum(F.col("times") * F.col("pieces")), F.lit(0))).alias("n_tokens"))
        .drop("row")
    )
