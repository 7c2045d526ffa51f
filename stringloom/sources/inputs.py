"""Inputs as (input_id, content), and the trigram model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str) -> DataFrame:
    """Every file under a path, whole; an empty file is an empty input."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("input_id"), "content")


def table(df: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """Rows of any table with a text or binary column; null content is empty."""
    content = F.col(content_col)
    if dict(df.dtypes)[content_col] == "string":
        content = F.encode(content, "UTF-8")
    return df.select(F.col(id_col).cast("string").alias("input_id"), F.coalesce(content, F.lit(b"")).alias("content"))


def trigram_model(lines: DataFrame) -> DataFrame:
    """(gram, n, lowercase) from lines (value) of tab-separated characters and counts; comments start with `#`, and one of them
    can say that the model is of lower-case text. `[^]` and `[$]`, the beginning and the end, become U+0080 and U+0081;
    counts are at least 1 and repeated grams add up. A malformed line fails the job with its text."""
    code = lambda c: F.when(c == "[^]", "\u0080").when(c == "[$]", "\u0081").when(c == "[SP]", " ").when(c == "[HT]", "\t").otherwise(c)
    parts = F.split("value", "\t")
    rows = lines.where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    marks = F.transform(F.slice(parts, 1, 3), code)
    good = (F.size(parts) == 4) & F.forall(marks, lambda c: F.length(c) == 1) & F.get(parts, F.lit(3)).rlike("^[0-9]+$")
    checked = F.when(good, F.array_join(marks, "")).otherwise(F.raise_error(F.concat(F.lit("malformed model line: "), F.col("value"))))
    counts = rows.select(checked.alias("gram"), F.greatest(F.get(parts, F.lit(3)).cast("long"), F.lit(1)).alias("n")).groupBy("gram").agg(F.sum("n").alias("n"))
    says = lines.agg(F.coalesce(F.bool_or(F.col("value").startswith("#") & F.col("value").contains("Model Type: lowercase")), F.lit(False)))
    return counts.withColumn("lowercase", says.scalar())
