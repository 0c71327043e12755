"""Uploads that land in a folder: each file once, and none over the limit is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the largest upload in bytes.
LIMIT = 500 * 1024 * 1024
SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arrivals(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """A stream of the files in ``folder`` that no earlier run with the query's checkpoint has seen."""
    return spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", glob).load(folder)


def accepted(files: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(path, length, content) within the limit. The filter goes to the source, which does not open other files; empty files
    never leave it."""
    return files.where(F.col("length") <= limit).select("path", "length", "content")


def refused(files: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(path, length, reason) of files over the limit; contents are not read."""
    return files.where(F.col("length") > limit).select("path", "length", F.lit("too_large").alias("reason"))
