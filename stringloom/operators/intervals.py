"""Points in intervals, over tables: equality joins on power-of-two bins, sweeps over sorted borders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a page.
PAGE = 4096


def _level(begin: Column, end: Column) -> Column:
    """The least k for which 2^k covers the length."""
    size = end - begin - 1
    return F.when(size <= 0, 0).otherwise(F.length(F.bin(size)))


def _bin(at: Column, level: Column) -> Column:
    return F.call_function("shiftright", at, level)


def containing(points: DataFrame, intervals: DataFrame, by: list[str], at: str = "at", begin: str = "start", end: str = "end") -> DataFrame:
    """Each row of `points` with each row of `intervals` that has equal `by` and holds it, begin <= at < end; the columns of both. A
    point in no interval is left out, as are null places and empty intervals.

    An interval lies in at most two bins of the power of two that covers its length, and a point in one bin of each power that
    occurs, so the join is by equality at every size and length, and adds no pair but those that share a bin. The powers that
    occur are at most 64 numbers, found by an aggregate of the plan itself. Both sides are shuffled at every size: rows that a few MB
    of Parquet hold can be more than the driver has room for."""
    held = intervals.where(F.col(end) > F.col(begin)).withColumn("level", _level(F.col(begin), F.col(end)))
    used = held.agg(F.coalesce(F.collect_set("level"), F.array().cast("array<int>"))).scalar()
    last = F.col(end) - 1
    bins = F.array_distinct(F.array(_bin(F.col(begin), F.col("level")), _bin(last, F.col("level"))))
    held = held.withColumn("bin", F.explode(bins))
    dealt = points.where(F.col(at).isNotNull()).withColumn("level", F.explode(used)).withColumn("bin", _bin(F.col(at), F.col("level")))
    both = dealt.join(held.hint("shuffle_merge"), [*by, "level", "bin"]).where((F.col(at) >= F.col(begin)) & (F.col(at) < F.col(end)))
    return both.drop("level", "bin")


def first_containing(points: DataFrame, intervals: DataFrame, by: list[str], order: list[str], at: str = "at", begin: str = "start", end: str = "end") -> DataFrame:
    """Each different (by, at) of `points` with the first interval, by `order`, that holds it: (by, at, first), where `first` has the
    columns of `intervals` that are not in `by`. Equal points are joined once, and tasks keep the first of their own."""
    rest = [c for c in intervals.columns if c not in by]
    hits = containing(points.select(*by, at).distinct(), intervals, by, at, begin, end)
    return hits.groupBy(*by, at).agg(F.min_by(F.struct(*rest), F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(order)))).alias("first"))


def permission_map(sections: DataFrame, by: list[str], page: int = PAGE) -> DataFrame:
    """(by, start, end, executable, writable): which pages are mapped with which rights, from sections (virtual_address, file_size,
    executable, writable) that can overlap. A page has the rights of all sections that touch it; adjacent pages with the same
    rights are one row.

    A sweep over the borders: how many sections are open, can be executed or written after each border is a running sum, so no
    page becomes a row, however large a section is. Sections without bytes map nothing. Addresses are compared as unsigned
    numbers would be within one half of the address space; a section that reaches over its end is cut there."""
    some = sections.where(F.col("file_size") > 0)
    begin = F.col("virtual_address") - F.pmod("virtual_address", F.lit(page))
    most = F.lit((1 << 63) - page)
    past = F.coalesce(F.try_add("virtual_address", F.col("file_size")), most)
    end = F.when(past > most - page, most).otherwise(past + F.pmod(-past, F.lit(page)))
    cut = some.select(*by, begin.alias("begin"), end.alias("end"), F.col("executable").cast("int").alias("x"), F.col("writable").cast("int").alias("w"))
    border = lambda sign: F.struct(F.col("begin" if sign > 0 else "end").alias("at"), F.lit(sign).alias("n"), (sign * F.col("x")).alias("x"), (sign * F.col("w")).alias("w"))
    borders = cut.select(*by, F.explode(F.array(border(1), border(-1))).alias("b")).groupBy(*by, F.col("b.at").alias("start")).agg(*(F.sum(f"b.{c}").alias(c) for c in "nxw"))
    along = Window.partitionBy(*by).orderBy("start")
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = borders.select(*by, "start", F.lead("start").over(along).alias("end"), *(F.sum(c).over(so_far).alias(c) for c in "nxw"))
    pieces = pieces.where("n > 0 and end is not null").select(*by, "start", "end", (F.col("x") > 0).alias("executable"), (F.col("w") > 0).alias("writable"))
    goes_on = (F.lag("end").over(along) == F.col("start")) & (F.lag("executable").over(along) == F.col("executable")) & (F.lag("writable").over(along) == F.col("writable"))
    runs = pieces.withColumn("begins", F.when(goes_on, 0).otherwise(1)).withColumn("run", F.sum("begins").over(so_far))
    return runs.groupBy(*by, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("executable").alias("executable"), F.first("writable").alias("writable")).drop("run")


def bytes_at(addresses: DataFrame, sections: DataFrame, contents: DataFrame, length: int, by: list[str]) -> DataFrame:
    """(by, address, section, bytes): up to `length` bytes from each of the different `addresses` (by, address), as far as the first
    section that holds it (by idx) goes; addresses in no section, or whose bytes the input does not have, are left out. `contents`
    is (input_id, content). Sections are found by an interval join; then the addresses of an input travel to its content as one
    list, so no content is copied for each address. A list is at most as long as the input has addresses."""
    at = F.col("address")
    held = sections.where(F.col("file_size") > 0).select(*by, "idx", "file_offset", F.col("virtual_address").alias("start"), F.coalesce(F.try_add("virtual_address", F.col("file_size")), F.lit((1 << 63) - 1)).alias("end"), F.col("name").alias("section"))
    place = first_containing(addresses, held, by, ["idx"], "address").select(*by, "address", "first.section", (at - F.col("first.start") + F.col("first.file_offset")).alias("offset"), F.least(F.lit(length), F.col("first.end") - at).cast("int").alias("n"))
    asked = place.groupBy("input_id").agg(F.collect_list(F.struct(*(c for c in place.columns if c != "input_id"))).alias("asked"))
    both = asked.join(contents.select("input_id", "content"), "input_id")
    fits = F.filter("asked", lambda a: (a["offset"] >= 0) & (a["offset"] + a["n"] <= F.octet_length("content")))
    own = lambda a: F.struct(*(a[c].alias(c) for c in place.columns if c not in ("input_id", "offset", "n")), F.substring("content", (a["offset"] + 1).cast("int"), a["n"]).alias("bytes"))
    return both.select("input_id", F.explode(F.transform(fits, own)).alias("a")).select("input_id", "a.*").select(*by, "address", "section", "bytes")
