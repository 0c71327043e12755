"""Shared helpers: projecting inputs, intermediate tables, folds, joins that hot keys do not skew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..tables import discard, materialize, shared_folder  # noqa: F401  the operators take them from here


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (long) and the text (null: empty), so that other columns cannot clash with an operator's own.

    Ids are whole numbers (or null); a column of another type is refused at once.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"ids must be whole numbers, {id_col} is {docs.schema[id_col].dataType.simpleString()}")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def text_hash(text: Column) -> Column:
    """Names a text (null: empty) beside its id, where rows of one id have different texts."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, but those whose id and text ``gone`` (doc_id, text_hash) names. A null id
    names nothing; other columns may have any names."""
    names = gone.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    return docs.join(names, (docs[id_col].cast("long") == names["gone_id"]) & (text_hash(docs[text_col]) == names["gone_hash"]), "left_anti")


def held_out(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text (a null id: the empty text, which is held out) leaves no remainder."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0


def join_unique(big: DataFrame, small: DataFrame, keys: list[str], rows: int, sizes: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """``big`` (a table of ``rows`` rows) joined with ``small``, whose keys are unique, without a task per hot key.

    Keys that hold more than 1/(4 * partitions) of big's rows, so at most 4 * partitions of them, are joined by a
    broadcast of their few rows; the others by a shuffle. sizes: (keys, n) of big, if they are known; keys that small does
    not hold may be left out of it. how: ``inner`` or ``left``.
    """
    parts = partitions(big.sparkSession)
    sizes = big.groupBy(*keys).agg(F.count("*").alias("n")) if sizes is None else sizes
    hot = sizes.where(F.col("n") > max(64, rows // (4 * parts))).select(*keys)
    own = materialize(small.join(F.broadcast(hot), keys, "left_semi"))  # at most 4 * partitions rows
    if own.isEmpty():
        return big.join(small, keys, how)
    names = F.broadcast(own.select(*keys))
    return big.join(F.broadcast(own), keys).unionByName(big.join(names, keys, "left_anti").join(small, keys, how))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
