"""The scans as a table function for SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import SparkSession

from stringloom.functions import extractors


def register(spark: SparkSession, name: str = "extract_strings") -> None:
    """`SELECT * FROM inputs, LATERAL extract_strings(content)`; see `extractors.register`, which does so for every extractor."""
    extractors.register(spark, replace(extractors.STRINGS, name=name), prefix="")
