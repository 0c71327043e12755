"""Exact dedup by content sort.

Rows are range-partitioned between sampled splitters over the content's order key (its first bytes, then a hash of the
whole), sorted externally inside each partition so that equal texts are adjacent, and neighbouring rows are compared on
the full text. A text held by more than 1/(2 * partitions) of the rows is hot: its rows also carry a salt in the sort key,
are settled per salt first, and a row for each text and salt settles the group by the text's sha256. All of it is
DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import id_text, partitions

#: Bytes of the text in the order key; what follows is ordered by the hash, so shared openings do not pile up.
ORDER_BYTES = 32


def _settled(base: DataFrame, keep: str) -> DataFrame:
    """base (doc_id, text and whatever else) with keep_id, group_size and text_sha256."""
    parts = partitions(base.sparkSession)
    base = base.withColumn("hash", F.xxhash64("text"))
    least = max(64, -(-base.count() // (2 * parts)))
    # at most 2 * parts rows by the threshold's definition, so the broadcast is bounded
    hot = F.broadcast(base.groupBy("hash").agg(F.count("*").alias("rows")).where(F.col("rows") >= least).select("hash", F.lit(True).alias("hot")))
    best = F.min if keep == "smallest" else F.max

    def neighbours(rows: DataFrame, by: list[str]) -> DataFrame:
        """Equal texts are neighbours within the sorted range partitions; the window compares neighbours on the full text."""
        group = W.partitionBy(*by)
        out = rows.withColumns({"keep_id": best("doc_id").over(group), "group_size": F.count("*").over(group)})
        return out.withColumn("text_sha256", F.sha2("text", 256)).drop("hash", "hot", "order")

    marked = base.join(hot, "hash", "left").withColumn("order", F.substring(F.encode("text", "utf-8"), 1, ORDER_BYTES))
    cold = marked.where(F.col("hot").isNull()).repartitionByRange(F.col("order"), F.col("hash"))
    cold = neighbours(cold, ["order", "hash", "text"])
    salted = marked.where(F.col("hot")).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))
    salted = neighbours(salted.repartitionByRange(F.col("order"), F.col("hash"), F.col("salt")), ["order", "hash", "salt", "text"])
    one = salted.select("text_sha256", "salt", F.col("keep_id").alias("best"), F.col("group_size").alias("size")).distinct()  # of a text and salt, combined in each task
    winners = one.groupBy("text_sha256").agg(best("best").alias("keep_id"), F.sum("size").alias("group_size"))
    # a row for each hot text, so as few as ``hot`` has
    warm = salted.drop("keep_id", "group_size", "salt").join(F.broadcast(winners), "text_sha256")
    return cold.unionByName(warm)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=None, keep: str = "smallest") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    docs: any DataFrame with a whole-number id and a text; other columns are ignored, whatever their names. normalise: a
    Column -> Column applied to the text before comparison (None: texts as they are). keep: ``smallest`` or ``largest``
    id of equal texts. Null text equals the empty text. A null id never wins over another; a group of only null ids keeps
    them all (keep_id null, kept true). Repeated rows are rows of their group; those with the winning id are all kept.
    Very long texts are sorted whole, as single rows. An empty table gives an empty result.
    """
    base = id_text(docs, id_col, text_col)
    if normalise is not None:
        base = base.withColumn("text", F.coalesce(normalise(F.col("text")), F.lit("")))
    out = _settled(base, keep).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The input rows that exact_duplicates() keeps, with all their columns, which travel beside the text in a struct, so
    that no name can clash and the text is shuffled once."""
    base = id_text(docs, id_col, text_col).schema  # refuses ids that are no whole numbers
    others = [c for c in docs.columns if c != text_col]
    row = F.struct(F.lit(0).alias("_"), *[docs[c].alias(f"c{i}") for i, c in enumerate(others)])
    every = docs.select(docs[id_col].cast(base["doc_id"].dataType).alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), docs[text_col].isNull().alias("no_text"), row.alias("row"))
    kept = _settled(every, keep).where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    text = F.when(~F.col("no_text"), F.col("text")).cast(docs.schema[text_col].dataType)
    return kept.select(*[text.alias(c) if c == text_col else F.col(f"row.c{others.index(c)}").alias(c) for c in docs.columns])
