"""Files as they arrive: the scans are stateless, so a stream of files is extracted with the same operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stringloom.operators import strings
from stringloom.plans.extract import examined
from stringloom.schema import Options

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def new_files(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """(input_id, content) of the files that appear under `path`, at most `per_trigger` at a time."""
    stream = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("maxFilesPerTrigger", per_trigger).load(path)
    return stream.select(F.col("path").alias("input_id"), "content")


def static_strings(inputs: DataFrame, options: Options = Options()) -> DataFrame:
    """Strings of each input as it comes. Duplicates and order need a whole input and belong to what reads the result."""
    return strings.located(examined(inputs, options))
