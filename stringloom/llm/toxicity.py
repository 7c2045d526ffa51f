"""Toxicity: a linear classifier over character n-grams that are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stringloom.llm.common import stash, texts

#: Slots that n-grams of these lengths (in bytes) are hashed to.
BITS, LENGTHS = 19, (3, 4, 5)
SLOTS = 1 << BITS
#: Added to the documents of a class with an n-gram.
SMOOTH = 1.0
#: Ratios within so many standard errors of zero count as zero; the others are moved towards it by as much.
ERRORS = 3.0
#: Labelled documents of each class, at most, on which the weights are fitted. The ratios come from all of them.
FIT_ROWS = 6000
#: Passes over these, step size, and pull of the weights towards zero.
EPOCHS, RATE, PULL = 12, 0.2, 1e-5

#: ASCII letters to lower case, other ASCII to space; bytes of other characters stay.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


class Features:
    """The slots of the n-grams in a text, each once, in order. White space, digits and punctuation are one space."""

    def __init__(self):
        self.mark = np.zeros(SLOTS, bool)

    def __call__(self, text: str) -> np.ndarray:
        raw = np.frombuffer(b" " + b" ".join(text.encode("utf-8", "replace").translate(LETTERS).split()) + b" ", np.uint8).astype(np.uint32)
        rolled = raw
        for n in range(2, max(LENGTHS) + 1):
            if len(raw) < n:
                break
            rolled = rolled[:-1] * np.uint32(0x01000193) ^ raw[n - 1 :]
            if n in LENGTHS:
                self.mark[((rolled * np.uint32(0x9E3779B1)) ^ np.uint32(n * 0x5BD1E995 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)] = True
        found = np.flatnonzero(self.mark)
        self.mark[found] = False
        return found


def labelled(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(doc_id, text, label 0 or 1) of the documents with a label. The labels are a table that grows with the documents, so
    both sides are shuffled at every size."""
    return texts(df, id_col, text_col).join(marks(labels, id_col, label_col).hint("shuffle_merge"), "doc_id")


def marks(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """(doc_id, label 0 or 1); of several labels of a document the largest counts, and a null one does not."""
    return labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg((F.max(label_col) > 0).cast("int").alias("label"))


def ratios(rows: DataFrame) -> tuple[np.ndarray, tuple[int, int]]:
    """(log-count ratio of each slot, documents of each class) from all of (doc_id, text, label). Tasks add up their
    counts; at most SLOTS rows reach the driver, whatever the input."""

    def count(batches):
        features, found, docs = Features(), np.zeros((2, SLOTS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found[label, features(text)] += 1
                docs[label] += 1
        slots = np.flatnonzero(found.any(axis=0))
        for some in (slots[i : i + 50_000] for i in range(0, len(slots), 50_000)):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[0, some]), pa.array(found[1, some])], ["slot", "n0", "n1"])
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array(docs[:1]), pa.array(docs[1:])], ["slot", "n0", "n1"])

    sums = rows.select("text", "label").mapInArrow(count, "slot long, n0 long, n1 long").groupBy("slot").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    slot, n0, n1 = (sums.column(x).to_numpy().astype(np.int64) for x in ("slot", "n0", "n1"))
    docs = (int(n0[slot < 0].sum()), int(n1[slot < 0].sum()))
    out, own = np.zeros(SLOTS), slot >= 0
    a, b = n1[own] + SMOOTH, n0[own] + SMOOTH
    ratio = np.log(a / (docs[1] + 2 * SMOOTH)) - np.log(b / (docs[0] + 2 * SMOOTH))
    out[slot[own]] = np.sign(ratio) * np.maximum(0, np.abs(ratio) - ERRORS * np.sqrt(1 / a + 1 / b))
    return out, docs


def bounded(rows: DataFrame, most: int) -> Column:
    """A condition on (doc_id, label) that the `most` rows of each label with the smallest hashes of their ids meet, or all of
    a label with no more. The class's size gives a hash below which a few more than `most` lie; only these reach the driver."""
    place, take = F.xxhash64("doc_id", F.lit(17)), F.lit(False)
    for label, n in rows.groupBy("label").count().collect():  # two labels
        own, expected, first = F.col("label") == label, most + 8 * math.sqrt(most) + 8, []
        while n > most and len(first) <= most:
            edge = min((1 << 63) - 1, int(expected / n * 2.0**64) - (1 << 63))
            first = sorted(x.place for x in rows.where(own & (place <= edge)).select(place.alias("place")).collect())
            expected *= 2
        take = take | (own & (place < first[most]) if n > most else own)
    return take


def fit(sample: DataFrame, ratio: np.ndarray, docs: tuple[int, int]) -> tuple[np.ndarray, float]:
    """(weight of each slot, intercept) of a logistic regression on the scaled features, by stochastic gradient descent in
    one task over the bounded sample. Other tasks find the features first: the one that fits gets slots, each text's at
    most SLOTS, however long it is. The intercept is moved from the sample's balance of classes to that of `docs`."""
    shared = sample.sparkSession.sparkContext.broadcast(ratio)

    def find(batches):
        scale, features = shared.value, Features()
        for batch in batches:
            slots = [own[scale[own] != 0].astype(np.int32) for own in map(features, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(slots, pa.list_(pa.int32())), batch.column(2)], ["doc_id", "slots", "label"])

    def train(batches):
        scale, seen, marks = shared.value, [], []
        for batch in batches:
            column = batch.column(0)
            flat, ends = column.flatten().to_numpy(), np.cumsum(column.value_lengths().to_numpy())
            seen += np.split(flat, ends[:-1]) if len(ends) else []
            marks += batch.column(1).to_pylist()
        weights, squares, bias, bias_squares = np.zeros(SLOTS), np.full(SLOTS, 1e-6), 0.0, 1e-6
        order = np.random.default_rng(7)
        for _ in range(EPOCHS if len(set(marks)) == 2 else 0):
            for i in order.permutation(len(seen)):
                own, x = seen[i], scale[seen[i]]
                miss = 1 / (1 + np.exp(-np.clip(bias + x @ weights[own], -30, 30))) - marks[i]
                slope = miss * x + PULL * weights[own]
                squares[own] += slope**2
                weights[own] -= RATE * slope / np.sqrt(squares[own])
                bias_squares += miss**2
                bias -= RATE * miss / np.sqrt(bias_squares)
        if marks and sum(marks) not in (0, len(marks)):
            bias += np.log(docs[1] / docs[0]) - np.log(sum(marks) / (len(marks) - sum(marks)))
        used = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(weights[used], bias))], ["slot", "weight"])

    # In the order of the ids, so that the fit is the same each time.
    kind = T.StructType([sample.schema["doc_id"], T.StructField("slots", T.ArrayType(T.IntegerType())), T.StructField("label", T.IntegerType())])
    few = sample.select("doc_id", "text", "label").mapInArrow(find, kind)
    found = few.repartition(1).sortWithinPartitions("doc_id", "slots").select("slots", "label").mapInArrow(train, "slot long, weight double").toArrow()
    slot, weight = found.column("slot").to_numpy(), found.column("weight").to_numpy()
    out = np.zeros(SLOTS)
    out[slot[slot >= 0]] = weight[slot >= 0]
    return out, float(weight[slot < 0].sum())


def learn(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = FIT_ROWS) -> tuple[np.ndarray, float]:
    """(value of each slot, intercept) from the documents and their labels: ratios from all of them, weights from at most
    `most` of each class. Only the ids of those few are broadcast."""
    ratio, docs = ratios(labelled(df, labels, id_col, text_col, label_col))
    if not all(docs):  # nothing to tell apart: the one class there is, or none
        return np.zeros(SLOTS, np.float32), 0.0 if docs == (0, 0) else 4.0 if docs[1] else -4.0
    candidates = stash(marks(labels, id_col, label_col), "marks")
    few = candidates.where(bounded(candidates, most))
    weights, bias = fit(texts(df, id_col, text_col).join(F.broadcast(few), "doc_id"), ratio, docs)
    return (weights * ratio).astype(np.float32), bias


def score(df: DataFrame, values: np.ndarray, bias: float, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """One row per input row: doc_id, `more`, score (0 to 1). Null and empty texts have the score of a text without any
    n-gram. Repeated rows and ids give a row each; an empty table gives no rows; texts are taken whole."""
    shared = df.sparkSession.sparkContext.broadcast(values)
    rows = texts(df, id_col, text_col, *more)
    schema = T.StructType([rows.schema.fields[0], *rows.schema.fields[2:], T.StructField("score", T.DoubleType())])

    def run(batches):
        own, features = shared.value, Features()
        for batch in batches:
            sums = np.array([own[features(x)].sum(dtype=np.float64) for x in batch.column(1).to_pylist()]) + bias
            found = 1 / (1 + np.exp(-np.clip(sums, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(i) for i in range(2, batch.num_columns)), pa.array(found)], schema.names)

    return rows.mapInArrow(run, schema)
