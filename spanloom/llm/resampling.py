"""Importance resampling towards a target's distribution of hashed word n-grams.

Texts go through Arrow kernels, a chunk of rows at a time: ascii_lower, split_pattern_regex, list_flatten and
dictionary_encode. Indices into the dictionary, shifted by one, two, ... places within a row, form the n-grams; the distinct
ones of a chunk are hashed once (crc32 of a longer n-gram continues that of its beginning), and take brings the buckets back
to all places. One pass sums the buckets of source and target; their log ratios, one for each bucket, are the gains. A
second pass takes each feature's gain and reduces them by row. Rows are then drawn without replacement: Gumbel noise, a
function of the id, is added to the weight, and the highest scores are ranked by range partitions and their counts.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, materialize
from .textkit import chunks, lean, text_bytes

BUCKETS, ORDER = 10_000, 2
#: Bytes of a chunk of texts.
CHUNK = 1 << 22
#: What cuts words: ASCII other than digits and small letters (capitals are small by then).
CUTS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def features(texts: pa.Array, order: int = ORDER, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each row, row of each feature, bucket of each feature); features are all runs of 1 to ``order`` words."""
    split = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=CUTS)
    row, word = pc.list_parent_indices(split).to_numpy(), pc.list_flatten(split)
    there = pc.not_equal(word, "")
    row, encoded = row[there.to_numpy(zero_copy_only=False)], pc.dictionary_encode(word.filter(there))
    names, index = [w.encode() for w in encoded.dictionary.to_pylist()], encoded.indices.to_numpy().astype(np.int64)
    begun = [zlib.crc32(w) for w in names]  # of the distinct n-grams so far, and each place's n-gram
    rows, found = [row], [pa.array(begun, pa.uint32()).take(pa.array(index)).to_numpy()]
    gram = index
    for n in range(1, order):
        whole = np.flatnonzero(row[n:] == row[: len(row) - n])
        pairs, gram_of = np.unique(gram[whole] * max(len(names), 1) + index[whole + n], return_inverse=True)
        spaced = [zlib.crc32(b" ", c) for c in begun]
        begun = [zlib.crc32(names[j], spaced[i]) for i, j in zip((pairs // max(len(names), 1)).tolist(), (pairs % max(len(names), 1)).tolist(), strict=True)]
        rows.append(row[whole])
        found.append(pa.array(begun, pa.uint32()).take(pa.array(gram_of)).to_numpy())
        gram = np.zeros(len(index), np.int64)
        gram[whole] = gram_of
    words = np.bincount(row, minlength=len(texts))
    return words, np.concatenate(rows), (np.concatenate(found) % buckets).astype(np.int64)


def _parts(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of runs of about ``CHUNK`` bytes."""
    for i, j in chunks(text_bytes(column)[1], CHUNK):
        yield i, column.slice(i, j - i)


def bucket_counts(texts: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all ``texts`` (column text) fall in each bucket; ``buckets`` numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, part in _parts(batch.column("text")):
                total += np.bincount(features(part, order, buckets)[2], minlength=buckets)
        own = np.flatnonzero(total)
        yield pa.record_batch([pa.array(own), pa.array(total[own])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(lean(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * the log ratio of a bucket's share in the target and in the source, one added to each count)."""
    n, s, t = len(source), int(source.sum()), int(target.sum())
    ratio = [float((y + 1) * (s + n)) / float((x + 1) * (t + n)) for x, y in zip(source.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, n_features, weight (the floored mean of the features' gains; none: 0) for every row of (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # a number for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, part in _parts(batch.column("text")):
                words, row, bucket = features(part, order, len(shared.value))
                taken = shared.value.take(bucket)
                by_row = np.argsort(row, kind="stable")
                n = np.bincount(row, minlength=len(part))
                filled = np.flatnonzero(n)
                weight = np.zeros(len(part), np.int64)
                if len(filled):
                    weight[filled] = np.add.reduceat(taken[by_row], (np.cumsum(n) - n)[filled]) // n[filled]
                yield pa.record_batch([batch.column("doc_id").slice(i, len(part)), pa.array(words), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.mapInArrow(lean(run), "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, floored: a function of seed and id (a null id: the empty text)."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h.cast("double") + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(scored: DataFrame, order: list[Column]) -> DataFrame:
    """``scored`` with ``rank`` 1, 2, 3, ... in the given order; no task holds more than a range of the rows."""
    names = scored.columns
    sorted_rows = materialize(scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    part, nth = F.shiftright("place", 33), F.col("place") % F.lit(1 << 33) + 1
    sizes = sorted_rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()  # a row for each partition
    ahead, seen = [], 0
    for part_id, n in sorted((r["part"], r["n"]) for r in sizes):
        ahead.append((part_id, seen))
        seen += n
    before = sorted_rows.sparkSession.createDataFrame(ahead, "part long, ahead long")
    return sorted_rows.withColumn("part", part).join(F.broadcast(before), "part").select(*names, (F.col("ahead") + nth).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, order: int = ORDER, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank (null: not drawn) for every row of ``docs``.

    floor(percent/100 of the rows with ``least_words`` words or more) are drawn, those with the highest scores, ties to the
    smaller doc_id. Null and empty texts have no features and weight 0; a null id is drawn like others, ahead of equal
    scores, with the noise of the empty text; rows that share an id share its noise and are drawn each for itself; very
    long texts are read whole, as one chunk; other columns are ignored, whatever their names. An empty target leaves
    weights that tell only how rare the features are; an empty ``docs`` gives an empty result.
    """
    base = id_text(docs, id_col, text_col)
    aim = target.select(F.coalesce(F.col(target_col).cast("string"), F.lit("")).alias("text"))
    gain = gains(bucket_counts(base, order, buckets), bucket_counts(aim, order, buckets))
    scored = materialize(weights(base, gain, order).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    enough = F.col("n_words") >= least_words
    draw = scored.where(enough).count() * percent // 100
    # rows of one score and id have the same place in the order; whatever their order, their ranks are the same numbers
    salt = F.xxhash64("n_features", "weight", F.monotonically_increasing_id())
    drawn = ranked(scored.where(enough).withColumn("salt", salt), [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("salt")])
    rank = F.when(F.col("rank") <= draw, F.col("rank"))
    columns = ["doc_id", "n_features", "weight", "score"]
    return drawn.select(*columns, rank.alias("rank")).unionByName(scored.where(~enough).select(*columns, F.lit(None).cast("long").alias("rank")))
