"""How quality filters interact: what each removes at each place of every order of them, and its share over all orders."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stringloom.llm.common import texts

#: What separates words, in a character class.
SPACE = r" \t-\r"
#: Counts of a cell at a step of an order.
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def text_failures(text: Column, words: Column) -> dict[str, Column]:
    """The conditions under which filters that see one text remove it, by the filters' letters."""
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, good, toxic, n): documents by what they fail, bit i of `mask` being the filter at place i of ABCDE, and by
    their labels. E, a text that stands under a smaller id, is told from the smallest id of each text, by its SHA-256; rows
    are counted before they meet, by id for the labels and then by text, so copies are never one group of rows.

    Null texts are empty; null parts are the empty string; a null id has no smaller one and no label; an id with several
    label rows is good or toxic if one of them says so."""
    found = text_failures(F.col("text"), F.col("words"))
    bits = sum((F.when(condition, 1 << i).otherwise(0) for i, condition in enumerate(found.values())), F.lit(0))
    facts = texts(docs, id_col, text_col, F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    facts = facts.withColumn("words", words_of(F.col("text"))).select("doc_id", "part", bits.alias("mask"), F.sha2(F.col("text"), 256).alias("digest"))
    once = facts.groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n"))
    said = labels.groupBy(F.col("doc_id")).agg(F.max(F.coalesce((F.col("quality") == 1), F.lit(False))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1), F.lit(False))).alias("toxic"))
    no = F.lit(False)
    labelled = once.join(said, "doc_id", "left").select("doc_id", "part", "mask", "digest", "n", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    # All rows of a text with equal part and labels at once: how many, the smallest id, and how many have it.
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    copies = labelled.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), least.alias("least"))
    smallest = F.min("least.doc_id").over(Window.partitionBy("digest"))
    first = F.when(F.col("least.doc_id") == smallest, F.col("least.n")).otherwise(0) + F.col("nameless")
    both = copies.withColumn("first", first).select("part", "mask", "good", "toxic", F.explode(F.array(
        F.struct(F.lit(0).alias("again"), F.col("first").alias("m")), F.struct(F.lit(1 << len(found)).alias("again"), (F.col("n") - F.col("first")).alias("m")),
    )).alias("x"))
    return both.where("x.m > 0").groupBy("part", (F.col("mask") + F.col("x.again")).alias("mask"), "good", "toxic").agg(F.sum("x.m").alias("n"))


def interactions(cells: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) from the cells of
    `failures`: a row for each part, order of the filters and step of it.

    Each cell is folded across the array of all orders: along an order it is kept until the first filter that it fails, which
    removes it, and every later one that it fails is redundant. That gives a struct for each order and step, weighted with
    the cell's documents, and structs at equal places are summed; tasks sum their own first. A part has at most 2^filters
    times four cells, however many documents there are. An empty table gives no rows."""
    orders = ["".join(p) for p in permutations(filters)]
    listed = F.array(*(F.array(*(F.lit(filters.index(f)) for f in o)) for o in orders))
    n, zero = F.col("n"), F.lit(0).cast("long")
    weighted = lambda condition, w=n: F.when(condition, w).otherwise(zero)
    good, toxic = F.col("good"), F.col("toxic")

    def along(order: Column) -> Column:
        """The fold of one order: an array of its steps, and whether the cell is gone."""
        step_type = "array<struct<" + ",".join(f"{m}:bigint" for m in MEASURES) + ">>"

        def step(state: Column, f: Column) -> Column:
            bit = F.call_function("shiftleft", F.lit(1), f)
            fails, gone = F.col("mask").bitwiseAND(bit) != 0, state["gone"]
            now = fails & ~gone
            own = F.struct(
                weighted(~gone & ~fails).alias("kept"), weighted(now).alias("removed"), weighted(fails & gone).alias("redundant"),
                weighted(F.col("mask") == bit).alias("unique_fails"), weighted(now & good).alias("good_lost"), weighted(now & toxic).alias("toxic_lost"),
            )
            return F.struct((gone | fails).alias("gone"), F.concat(state["steps"], F.array(own)).alias("steps"))

        start = F.struct(F.lit(False).alias("gone"), F.array().cast(step_type).alias("steps"))
        return F.aggregate(order, start, step, lambda state: state["steps"])

    folded = cells.select("part", F.posexplode(F.flatten(F.transform(listed, along))).alias("place", "x"))
    summed = folded.groupBy("part", "place").agg(*(F.sum(f"x.{m}").alias(m) for m in MEASURES))
    steps, at = len(filters), F.col("place")
    order = F.element_at(F.array(*(F.lit(o) for o in orders)), (F.floor(at / steps) + 1).cast("int"))
    out = summed.select("part", order.alias("filter_order"), (at % steps + 1).cast("int").alias("step"), *MEASURES)
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", letter)))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What the five filters do to `docs` (doc_id, text, lang) in all orders, with `labels` (doc_id, quality, toxic). Other
    columns are not carried."""
    return interactions(failures(docs, labels))
