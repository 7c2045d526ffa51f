"""Results as documents, lines and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stringloom.operators.strings import order_columns
from stringloom.plans.extract import Result

VERSION = "1"
#: Sections of a report in their order, with the kinds of each. Fixed values.
REPORT = (
    ("static strings", ("static_ascii", "static_utf16_le", "static_utf8", "static_utf16_be")),
    ("base64 strings", ("base64",)),
    ("language strings", ("go", "rust")),
    ("decoded strings", ("decoded",)),
    ("stack strings", ("stack",)),
    ("tight strings", ("tight",)),
)
#: Of these, those whose strings belong to functions.
OF_CODE = ("decoded strings", "stack strings", "tight strings")


def record() -> Column:
    """A string as it is written: empty fields are left out."""
    location = F.struct("location.offset", "location.address", "location.section", "location.function_va", "location.source_va", F.when(F.col("location.xrefs") > 0, F.col("location.xrefs")).alias("xrefs"))
    tags = F.when(F.size("analysis.tags") > 0, F.col("analysis.tags"))
    filled = tags.isNotNull() | F.col("analysis.trigram_score").isNotNull() | F.col("analysis.decoded_offset").isNotNull()
    analysis = F.when(filled, F.struct(tags.alias("tags"), "analysis.trigram_score", "analysis.decoded_offset", "analysis.source_length"))
    return F.struct("value", "kind", "encoding", location.alias("location"), analysis.alias("analysis"))


def json_lines(result: Result) -> DataFrame:
    """(input_id, line): one record for each string."""
    return result.strings.select("input_id", F.to_json(record()).alias("line"))


def json_documents(result: Result) -> DataFrame:
    """(input_id, document): all of an input in one document, its strings in order. Only for inputs whose strings fit a row;
    `json_lines` has no such bound."""
    keyed = result.strings.withColumn("offset", F.col("location.offset")).select("input_id", F.struct(*(c.alias(f"k{i}") for i, c in enumerate(order_columns())), record().alias("record")).alias("s"))
    listed = keyed.groupBy("input_id").agg(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["record"]).alias("strings"))
    warned = result.warnings.groupBy("input_id").agg(F.array_sort(F.collect_list("warning")).alias("warnings"))
    whole = result.inputs.join(listed, "input_id", "left").join(warned, "input_id", "left")
    head = F.struct("format", "arch", "bits", "size", "language")
    more = []
    if result.candidates is not None:
        own = F.struct((-F.col("score")).alias("k"), "va", "name", "score", "recovered_strings", "tags")
        ranked = result.candidates.groupBy("input_id").agg(F.transform(F.array_sort(F.collect_list(own)), lambda x: x.dropFields("k")).alias("candidates"))
        whole, more = whole.join(ranked, "input_id", "left"), ["candidates"]
    return whole.select("input_id", F.to_json(F.struct(F.lit(VERSION).alias("version"), head.alias("input"), F.coalesce("strings", F.array().cast(listed.schema["strings"].dataType)).alias("strings"), *more, "warnings")).alias("document"))


def _hex(c: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(c), 16, "0")))


def report(result: Result, quiet: bool = False, by_function: bool = False, brief: bool = False) -> DataFrame:
    """(input_id, part, function, place, value, line): a report for reading, in the order of these columns. It begins with the
    input, has a section for each group of kinds, its strings by address or else offset, and ends with the warnings.
    `quiet` leaves out all but strings; `brief` leaves out static, Base64 and language strings and begins with the candidates;
    `by_function` puts strings of code under their functions."""
    lines = []
    none = lambda c=None: F.lit(c).cast("long")

    def add(df: DataFrame, part: Column | int, line: Column, function: Column | None = None, place: Column | None = None, value: Column | None = None):
        part = F.lit(part) if isinstance(part, int) else part
        at = [none() if x is None else x for x in (function, place)]
        lines.append(df.select("input_id", part.cast("int").alias("part"), at[0].alias("function"), at[1].alias("place"), (F.lit(None).cast("string") if value is None else value).alias("value"), line.alias("line")))

    part, label, of_code = F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(False)
    for i, (name, kinds) in enumerate(REPORT):
        hit = F.col("kind").isin(*kinds)
        part, label, of_code = F.when(hit, 2 + i).otherwise(part), F.when(hit, name).otherwise(label), of_code | (hit if name in OF_CODE else F.lit(False))
    at = F.coalesce("location.address", "location.offset")
    own = F.coalesce("location.function_va", "location.address", F.lit(0))
    s = result.strings.withColumns({"part": part, "label": label, "of_code": of_code, "at": at, "own": own})
    s = s.where("of_code") if brief else s
    score = F.when(F.col("analysis.trigram_score").isNotNull(), F.format_string("  [score=%.3f]", "analysis.trigram_score")).otherwise("")
    tags = F.array_join(F.transform(F.coalesce("analysis.tags", F.array().cast("array<string>")), lambda t: F.concat(F.lit(" #"), t)), "")
    decoded = F.when(F.col("analysis.decoded_offset").isNotNull(), F.concat(F.lit(" [decoded+0x"), F.lower(F.hex("analysis.decoded_offset")), F.lit("]"))).otherwise("")
    notes = F.concat(score, tags, decoded)
    grouped = F.lit(by_function) & F.col("of_code")
    add(s, F.col("part"), F.when(grouped, F.concat(F.lit("    "), F.col("value"), notes)).otherwise(F.concat(_hex(F.col("at")), F.lit("  "), F.col("value"), notes)), F.when(grouped, F.col("own")), F.col("at"), F.col("value"))
    named = result.candidates if result.candidates is not None else None
    bracket = F.when(F.size("tags") > 0, F.concat(F.lit("  ["), F.array_join("tags", ", "), F.lit("]"))).otherwise("")
    if by_function:
        heads = s.where("of_code").groupBy("input_id", "part", "own").agg(F.count("*").alias("n"))
        title = F.concat(F.lit("  function "), _hex(F.col("own")))
        if named is not None:
            heads = heads.join(named.select("input_id", F.col("va").alias("own"), "name", "tags"), ["input_id", "own"], "left")
            title = F.concat(title, F.coalesce(F.concat(F.lit("  "), F.col("name")), F.lit("")), F.coalesce(bracket, F.lit("")))
        add(heads, F.col("part"), F.concat(title, F.lit("  ("), F.col("n"), F.lit(" strings)")), F.col("own"))
    if not quiet:
        i = result.inputs
        add(i, 0, F.concat(F.lit("stringloom: format="), F.col("format"), F.lit(", size="), F.col("size"), F.lit(" bytes")), place=none(0))
        add(i.where("arch is not null"), 0, F.concat(F.lit("       arch="), F.col("arch"), F.lit(", bits="), F.coalesce("bits", F.lit(0))), place=none(1))
        add(i.where("language is not null"), 0, F.concat(F.lit("       language="), F.col("language")), place=none(2))
        counts = s.groupBy("input_id", "part", "label").agg(F.count("*").alias("n"))
        add(counts, F.col("part"), F.concat(F.lit("=== "), F.col("label"), F.lit(" ("), F.col("n"), F.lit(") ===")))
        add(result.warnings.select("input_id").distinct(), 9, F.lit("warnings:"))
        add(result.warnings, 9, F.concat(F.lit("  - "), F.col("warning")), place=none(0), value=F.col("warning"))
        if brief and named is not None:
            add(named.groupBy("input_id").agg(F.count("*").alias("n")), 1, F.concat(F.lit("=== decoder candidates ("), F.col("n"), F.lit(") ===")))
            line = F.concat(F.lit("  "), _hex(F.col("va")), F.format_string("  score=%.2f", "score"), F.lit("  recovered="), F.col("recovered_strings"), F.lit("  "), F.coalesce("name", F.lit("")), F.coalesce(bracket, F.lit("")))
            add(named, 1, line, place=F.rank().over(Window.partitionBy("input_id").orderBy(F.desc("score"), "va")).cast("long"))
    return reduce(DataFrame.unionByName, lines)


#: The order of a report's lines.
REPORT_ORDER = ("input_id", "part", "function", "place", "value")


def write_lines(result: Result, path: str) -> None:
    """Records in order: inputs one after the other, in each by offset, kind and place. Spark sorts by ranges, so an input of
    any size spreads over tasks."""
    ordered = result.strings.withColumn("offset", F.col("location.offset")).orderBy("input_id", *order_columns())
    ordered.select(F.to_json(record()).alias("line")).write.text(path)


def write_documents(result: Result, path: str) -> None:
    json_documents(result).select("document").write.text(path)


def write_report(result: Result, path: str, **forms: bool) -> None:
    report(result, **forms).orderBy(*REPORT_ORDER).select("line").write.text(path)
